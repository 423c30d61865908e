"""The vertex loess against a brute-force numpy evaluation of the same
definition, and exactness on quadratic data."""
import math

import numpy as np
import pytest

from retentio.operators.smooth import loess_trend


def brute(x, y, span=0.75, cell=0.2):
    order = np.argsort(x)
    xs = x[order]
    n = len(xs)
    q = int(math.floor(n * span))
    fc = int(math.floor(n * span * cell))
    splits = []

    def rec(lo, hi):
        if hi - lo + 1 <= fc:
            return
        m = (lo + hi) // 2
        splits.append((xs[m] + xs[m + 1]) / 2)
        rec(lo, m)
        rec(m + 1, hi)

    rec(0, n - 1)
    mu = 0.005 * (xs[-1] - xs[0])
    verts = sorted(set([xs[0] - mu, xs[-1] + mu] + splits))
    fits = []
    for v in verts:
        d = np.abs(x - v)
        h = np.sort(d)[q - 1]
        sel = d < h
        u = (x[sel] - v) / h
        w = (1 - np.abs(u) ** 3) ** 3
        A = np.vstack([np.ones_like(u), u, u * u]).T
        coef = np.linalg.lstsq(A * np.sqrt(w)[:, None], y[sel] * np.sqrt(w), rcond=None)[0]
        fits.append((v, coef[0], coef[1] / h))
    out = {}
    for xi in x:
        for (va, fa, sa), (vb, fb, sb) in zip(fits, fits[1:]):
            if va <= xi <= vb:
                t = (xi - va) / (vb - va)
                wd = vb - va
                out[xi] = ((2 * t**3 - 3 * t**2 + 1) * fa + (t**3 - 2 * t**2 + t) * wd * sa
                           + (-2 * t**3 + 3 * t**2) * fb + (t**3 - t**2) * wd * sb)
                break
    return out


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.arange(0, 400, 2, dtype=float)
    y = 50 + 10 * np.sin(x / 40) + rng.normal(0, 3, len(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r.x: r.trend for r in loess_trend(df, "x", "y").collect()}
    want = brute(x, y)
    assert len(got) == len(x)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-3)


def test_quadratic_is_reproduced(spark):
    x = np.arange(0, 300, dtype=float)
    y = 3 + 0.5 * x - 0.002 * x * x
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r.x: r.trend for r in loess_trend(df, "x", "y").collect()}
    for a, b in zip(x, y):
        assert got[a] == pytest.approx(b, abs=2e-4)
