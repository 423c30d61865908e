"""Locally weighted quadratic regression (loess) trend of a series.

Evaluating the local fit at every point would pair each point with its
``span * n`` nearest neighbours - all pairs, for the usual span 0.75.  The
fit is instead computed exactly at a small set of vertices and interpolated
between them, the way loess surfaces are usually evaluated:

1. vertices: the ends of the data range (widened by ``margin``) and the
   median split points of a 1-D k-d tree whose leaves hold at most
   ``floor(n * span * cell)`` points - so the vertex count is about
   ``2 / (span * cell)``, independent of n;
2. at each vertex v, the bandwidth is the q-th smallest distance
   ``|x - v|`` (q = floor(span * n)), found with the exact distributed
   order statistic; points inside it get tricube weights and one grouped
   aggregation returns the weighted moments of every vertex;
3. a 3x3 weighted least-squares solve per vertex gives the local value and
   slope; each point's trend is the cubic Hermite interpolation between the
   two vertices around it.

Each series point is paired with the vertex list (bounded size, held as
literals in the plan) by an ``explode``, not a join, and the interpolation
cell is found by comparing against the sorted vertex literals, so the work
is linear in the series length with no join at all.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.operators.quantiles import order_statistics
from retentio.session import checkpoint_root

# Fixed values of the smoother.
DEFAULT_SPAN = 0.75
DEFAULT_CELL = 0.2
BOX_MARGIN = 0.005


def _split_ranks(n: int, fc: int) -> list[tuple[int, int]]:
    """(m, m + 1) rank pairs of the median splits of a k-d tree over n sorted
    points whose leaves hold at most ``fc`` points."""
    out, stack = [], [(0, n - 1)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo + 1 <= max(fc, 1):
            continue
        m = (lo + hi) // 2
        out.append((m, m + 1))
        stack.extend([(lo, m), (m + 1, hi)])
    return sorted(out)


def _local_fit(mom: dict[str, float], degree: int) -> tuple[float, float]:
    """Value and slope (in u units) of the weighted polynomial fit at u = 0."""
    k = degree + 1
    a = np.array([[mom[f"s{i + j}"] for j in range(k)] for i in range(k)], dtype=float)
    b = np.array([mom[f"t{i}"] for i in range(k)], dtype=float)
    coef = np.linalg.lstsq(a, b, rcond=None)[0]
    return float(coef[0]), float(coef[1]) if k > 1 else 0.0


def loess_vertices(series: DataFrame, x: str, y: str, span: float = DEFAULT_SPAN,
                   degree: int = 2, cell: float = DEFAULT_CELL) -> list[tuple[float, float, float]]:
    """``[(vertex, value, slope)]`` of the local fits, sorted by vertex."""
    spark = series.sparkSession
    pts = (series.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
                 .filter(F.col("x").isNotNull() & F.col("y").isNotNull()))
    # The passes below re-read the series several times; cut its lineage once
    # (reliable checkpoint in the shared folder) instead of recomputing it.
    checkpoint_root(spark)
    pts = pts.checkpoint(eager=True)
    st = pts.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n, lo, hi = int(st["n"]), float(st["lo"]), float(st["hi"])
    if n == 0:
        return []
    q = max(int(math.floor(n * span)), degree + 1)
    q = min(q, n)
    fc = int(math.floor(n * span * cell))
    pairs = _split_ranks(n, fc)
    ranks = sorted({r for p in pairs for r in p})
    xs = pts.select(F.lit("x").alias("k"), "x")
    stats = order_statistics(xs, {"x": ranks}) if ranks else {}
    mu = BOX_MARGIN * max(hi - lo, 1e-10 * max(abs(lo), abs(hi)) + 1e-30)
    verts = sorted({lo - mu, hi + mu} | {(stats[("x", a)] + stats[("x", b)]) / 2 for a, b in pairs})
    vlist = F.array(*[F.struct(F.lit(i).alias("vid"), F.lit(float(v)).alias("v"))
                      for i, v in enumerate(verts)])
    dist = (pts.select("x", "y", F.explode(vlist).alias("__v"))
               .select(F.col("__v.vid").alias("vid"), F.col("__v.v").alias("v"), "x", "y")
               .withColumn("d", F.abs(F.col("x") - F.col("v"))))
    # Bandwidth per vertex: q-th smallest distance (exact, distributed).
    dl = dist.select(F.col("vid").cast("string").alias("k"), F.col("d").alias("x"))
    hq = order_statistics(dl, {str(i): [q - 1] for i in range(len(verts))})
    # Where a share ``span`` of all points lies on one x, the bandwidth would be
    # 0: the smallest positive one is taken, so the tied points alone decide.
    tiny = 1e-9 * max(hi - lo, 1e-10 * max(abs(lo), abs(hi)) + 1e-30)
    hs = F.array(*[F.lit(max(float(hq[(str(i), q - 1)]), tiny)) for i in range(len(verts))])
    u = (F.col("x") - F.col("v")) / F.col("h")
    w = F.pow(1 - F.pow(F.abs(u), 3), 3)
    near = (dist.withColumn("h", F.element_at(hs, F.col("vid") + 1))
                .filter(F.col("d") < F.col("h"))
                .select("vid", "h", u.alias("u"), w.alias("w"), "y"))
    aggs = [F.sum(F.col("w") * F.pow(F.col("u"), i)).alias(f"s{i}") for i in range(2 * degree + 1)]
    aggs += [F.sum(F.col("w") * F.pow(F.col("u"), i) * F.col("y")).alias(f"t{i}")
             for i in range(degree + 1)]
    moms = {r["vid"]: r.asDict() for r in near.groupBy("vid").agg(F.first("h").alias("h"), *aggs).collect()}
    out = []
    for vid, v in enumerate(verts):
        m = moms.get(vid)
        if m is None:
            continue
        val, slope_u = _local_fit(m, degree)
        out.append((v, val, slope_u / m["h"]))
    return out


def loess_trend(series: DataFrame, x: str, y: str, span: float = DEFAULT_SPAN, degree: int = 2,
                cell: float = DEFAULT_CELL, digits: int = 4) -> DataFrame:
    """``series`` plus ``trend``: the loess curve at each point, rounded."""
    verts = loess_vertices(series, x, y, span, degree, cell)
    xv = F.col(x).cast("double")
    if len(verts) < 2:
        return series.withColumn("trend", F.lit(None).cast("double"))
    # Cell index: how many interior vertices lie at or below x (vertex 0 is
    # below every point), so cell i spans [v_i, v_(i+1)].
    idx = F.lit(0)
    for v, _, _ in verts[1:-1]:
        idx = idx + F.when(xv >= F.lit(float(v)), 1).otherwise(0)
    idx = idx + 1                                   # element_at is 1-based

    def pick(values):
        return F.element_at(F.array(*[F.lit(float(z)) for z in values]), idx)

    va, vb = pick([a[0] for a in verts[:-1]]), pick([b[0] for b in verts[1:]])
    fa, fb = pick([a[1] for a in verts[:-1]]), pick([b[1] for b in verts[1:]])
    sa, sb = pick([a[2] for a in verts[:-1]]), pick([b[2] for b in verts[1:]])
    width = vb - va
    t = (xv - va) / width
    h00 = 2 * t ** 3 - 3 * t ** 2 + 1
    h10 = t ** 3 - 2 * t ** 2 + t
    h01 = -2 * t ** 3 + 3 * t ** 2
    h11 = t ** 3 - t ** 2
    val = h00 * fa + h10 * width * sa + h01 * fb + h11 * width * sb
    return series.withColumn("trend", F.round(val, digits))
