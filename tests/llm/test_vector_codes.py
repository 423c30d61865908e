"""Vector codes against plain distances and a sequential version."""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pytest

from retentio.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def _plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, label, code, error) in id order and the digest, by nested loops."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    dim = max((len(v) for _, v, _ in kept), default=0)
    length = -(-dim // parts)
    whole = [[math.floor(1024 * x) for x in v] + [0] * (length * parts - len(v)) for _, v, _ in kept]
    cut = [[w[p * length:(p + 1) * length] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign(part, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[part]))

    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(assign(p, c[p])[1], []).append(c[p])
            for k, members in groups.items():
                new[p][k] = [sum(col) // len(members) for col in zip(*members)]
        books = new
    out = []
    for (i, _, lab), c in zip(kept, cut):
        best = [assign(p, c[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def _check(spark, rows, **kw):
    got = vc.encode_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), **kw).collect()
    want, digest = _plain(rows, **kw)
    key = lambda t: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in t)
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in got), key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in got} <= {digest}
    total = {}
    for _, lab, _, e in want:
        total[lab] = total.get(lab, 0) + e
    assert all(r.label_error == total[r.label] for r in got)


def test_sequency_order_of_the_transform():
    h = vc.hadamard(16)
    changes = (h[:, 1:] != h[:, :-1]).sum(axis=1)
    assert changes.tolist() == list(range(16))
    assert (h @ h.T == 16 * np.eye(16, dtype=int)).all()


@pytest.mark.parametrize("length", [1, 2, 3, 7, 16])
@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_entries(length, kind):
    rng = np.random.default_rng(length)
    rows = rng.integers(-900, 900, (400, length)) // 7 * 7
    entries = rng.integers(-900, 900, (50, length)) // 7 * 7
    entries[9] = entries[3]  # equal entries: the lower index
    rows[:20] = entries[9]
    d = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    got = vc.nearest_entries(rows.astype(kind), entries.astype(kind))
    assert got.index.tolist() == d.argmin(axis=1).tolist()
    assert got.error.tolist() == d.min(axis=1).tolist()


def test_entries_are_eliminated_early():
    rng = np.random.default_rng(1)
    rows = np.cumsum(rng.integers(-40, 41, (2000, 16)), axis=1)
    got = vc.nearest_entries(rows, rows[:256])
    assert got.terms < 0.4 * 2000 * 256 * 16


def test_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=12) / 3).tolist(), None if k % 7 == 0 else k % 3) for k in range(300)]
    rows += [(k, rows[0][1], 1) for k in range(400, 450)]  # ties and repeated vectors
    rows += [(5, rows[5][1], 2), (5, rows[6][1], 2), (None, rows[7][1], None), (None, None, 1), (900, [0.1] * 11 + [None], 1),
             (901, [float("nan")] * 12, 1), (902, [float("inf")] + [0.0] * 11, 1), (903, [], 1), (904, [0.25] * 3, 1)]
    _check(spark, rows, entries=20, rounds=3)


def test_fewer_rows_than_entries_and_a_dimension_that_parts_do_not_divide(spark):
    _check(spark, [(k, [k / 7, -k / 3, 0.5, 2.0, -1.0], None) for k in range(9)])


def test_components_of_any_size(spark):
    rows = [(k, [1e30 * k, -3e38, 1.5, k * 0.1, 1e9], 0) for k in range(30)]
    got = vc.encode_vectors(spark.createDataFrame(rows, SCHEMA), entries=8).collect()
    want, digest = _plain(rows, entries=8)
    assert {(r.vec_id, r.code, r.error) for r in got} == {(i, c, e if e < 2 ** 63 else None) for i, _, c, e in want}
    assert {r.codebooks_sha256 for r in got} == {digest}


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1), (2, [], None)]])
def test_nothing_to_encode(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as code", "2 as error", "3 as v", "4 as label_error")
    got = vc.encode_vectors(df).collect()
    assert [(r.vec_id, r.code, r.error) for r in sorted(got)] == [(i, "00" * 4, 0) for i, v, _ in rows if v is not None]


def test_entries_fit_two_digits(spark):
    with pytest.raises(ValueError):
        vc.encode_vectors(spark.createDataFrame([], SCHEMA), entries=257)
