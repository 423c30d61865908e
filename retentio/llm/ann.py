"""Nearest neighbours by cosine through low-dimensional stable projections.

Unit vectors are projected to ``DIMS`` dimensions by Gaussian (2-stable)
directions, and a kd-tree over the projections hands out leaves in order of
their projected distance to the query.  Points of a leaf are verified on the
original vectors.  The projected squared distance of a pair over its true one
is chi-squared with ``DIMS`` degrees, so the search of a tree stops once no
point at the current k-th distance would, with probability ``CONFIDENCE``,
project as far away as the next leaf.

Distribution: equal vectors are merged first, keeping the k + 1 smallest ids
(all that any answer can use), so copies cost nothing.  A top kd-tree, fitted
on the projections of a sample of about ``SAMPLE`` vectors (chosen by hash, at
most twice as many), deals every vector into a cell of about ``CELL`` vectors;
the boxes of the cells, at most ``2 ** DEPTH`` for each vector length, are all
that is broadcast.  A cell that the sample got wrong (near copies) is split by
hash into blocks of about ``BLOCK`` vectors, each with a tree of its own.

The search goes by rounds: a query meets the nearest cell, then the next 7,
56, 448, ... in order of the projected distance to their boxes, and leaves as
soon as the next cell fails the same chi-squared test at its k-th distance so
far.  A task holds one block and at most about ``CHUNK`` of the queries that
reach it, so a block is copied as often as queries need it, and not at all if
none does.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of different lengths never meet; ties go to
the smaller id; repeated rows of one id count once; extra columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import materialise

DIMS, LEAF = 8, 64
CONFIDENCE = 0.95
#: Upper CONFIDENCE point of chi-squared with DIMS degrees of freedom.
STOP = 15.507
CELL, BLOCK, CHUNK = 4_096, 16_384, 16_384
SAMPLE, DEPTH = 65_536, 12
#: Each round of the search reaches this many times as many cells.
WIDER = 8
SEED = 20


def _smallest_ids(keep: int):
    """Per batch: at most ``keep`` smallest ids of each vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            seen: dict[bytes, int] = {}
            take = []
            raw = batch.column("v")
            flat, ends = np.asarray(raw.values), np.asarray(raw.offsets)
            for i in sorted(range(len(ids)), key=ids.__getitem__):
                key = flat[ends[i]:ends[i + 1]].tobytes()
                if seen.setdefault(key, 0) < keep:
                    seen[key] += 1
                    take.append(i)
            yield batch.take(pa.array(take, pa.int64()))
    return run


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists("embedding", lambda x: x != 0)
    return rows.select("vec_id", "embedding").filter(good & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v"))


@lru_cache(maxsize=16)
def directions(dim: int) -> np.ndarray:
    """The stable directions for vectors of ``dim`` components."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, DIMS))


class TopTree:
    """Splits of projections into ``2 ** depth`` cells, in heap order."""

    def __init__(self, low: np.ndarray, depth: int):
        self.depth = depth
        self.axes = np.zeros(2 ** depth - 1, int)
        self.cuts = np.zeros(2 ** depth - 1)
        parts = [low]
        for node in range(2 ** depth - 1):
            x = parts[node]
            if len(x):
                axis = int(np.ptp(x, axis=0).argmax())
                self.axes[node], self.cuts[node] = axis, np.median(x[:, axis])
            right = x[:, self.axes[node]] >= self.cuts[node]
            parts += [x[~right], x[right]]

    def cells(self, low: np.ndarray) -> np.ndarray:
        node = np.zeros(len(low), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (low[np.arange(len(low)), self.axes[node]] >= self.cuts[node])
        return node - (2 ** self.depth - 1)


class Boxes(NamedTuple):
    """Cells of one vector length that hold vectors, with the bounds of their projections."""
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Index(NamedTuple):
    """The dealt vectors, their cells (one row each) and the boxes by vector length."""
    vectors: DataFrame
    cells: DataFrame
    boxes: Broadcast
    most: int


class Tree:
    """kd-tree over projections: points in leaf order and the leaves' boxes."""

    def __init__(self, unit: np.ndarray):
        self.directions = directions(unit.shape[1])
        low = unit @ self.directions
        leaves, stack = [], [np.arange(len(unit))]
        while stack:
            at = stack.pop()
            if len(at) <= LEAF:
                leaves.append(at)
                continue
            x = low[at]
            axis = int(np.ptp(x, axis=0).argmax())
            half = len(at) // 2
            parts = np.argpartition(x[:, axis], half)
            stack += [at[parts[half:]], at[parts[:half]]]
        self.order = np.concatenate(leaves)
        self.ends = np.cumsum([len(x) for x in leaves])
        self.low = np.array([low[x].min(axis=0) for x in leaves])
        self.high = np.array([low[x].max(axis=0) for x in leaves])
        self.unit = unit[self.order]

    def search(self, q: np.ndarray, k: int, bound: float = np.inf) -> np.ndarray:
        """Positions (in the given vectors) of the verified points that may be among the k nearest;
        ``bound``: squared distance of the k-th found elsewhere."""
        p = q @ self.directions
        out = np.maximum(0, np.maximum(self.low - p, p - self.high))
        far = (out * out).sum(axis=1)
        order = np.argsort(far, kind="stable")
        found, dist, done, step = [], [], 0, 4
        kth = bound
        while done < len(order) and not far[order[done]] > STOP * kth:
            for leaf in order[done:done + step]:
                b = self.ends[leaf - 1] if leaf else 0
                e = self.ends[leaf]
                found.append(np.arange(b, e))
                dist.append(np.maximum(0, 2 - 2 * (self.unit[b:e] @ q)))
            done += step
            step *= 2
            d = np.concatenate(dist)
            if len(d) >= k:
                kth = min(bound, np.partition(d, k - 1)[k - 1] + 1e-12)  # ties at the k-th place stay in
                keep = d <= kth
                found, dist = [np.concatenate(found)[keep]], [d[keep]]
        return self.order[np.concatenate(found)] if found else np.zeros(0, int)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, projections of the unit vectors) of a batch."""
    flat, ends = np.asarray(column.values), np.asarray(column.offsets)
    sizes = np.diff(ends)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        x = flat[ends[at][:, None] + np.arange(dim)]
        yield dim, at, (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ directions(dim)


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, _, low in _by_length(batch.column("v")):
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(low), pa.int32()), pa.array(low.tolist(), pa.list_(pa.float64()))],
                                             ["dim", "low"])


def _deal(trees: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, low in _by_length(batch.column("v")):
                tree = trees.value.get(dim)
                cell = np.zeros(len(low), int) if tree is None else tree.cells(low)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("v").take(take), batch.column("ids").take(take), pa.array([dim] * len(low), pa.int32()),
                     pa.array(cell, pa.int32()), pa.array(low.tolist(), pa.list_(pa.float64()))], ["v", "ids", "dim", "cell", "low"])
    return run


def build_index(vectors: DataFrame, cell: int = CELL, block: int = BLOCK, sample: int = SAMPLE) -> Index:
    """``vectors`` (v, ids; different v) dealt into the cells of top trees.

    Vector lengths that the sample misses are one cell each, without a box."""
    spark = vectors.sparkSession
    n = vectors.count()
    chosen = vectors if n <= sample else vectors.filter(F.pmod(F.xxhash64(F.lit(SEED), "v"), F.lit(n)) < sample)
    points: dict[int, list] = {}
    for r in chosen.select("v").mapInArrow(_project, "dim int, low array<double>").limit(2 * sample).toLocalIterator():
        points.setdefault(r.dim, []).append(r.low)
    trees = {}
    for dim, low in points.items():
        wanted = min(len(low) / 2, len(low) * max(1, n / sample) / cell)
        trees[dim] = TopTree(np.array(low), min(DEPTH, max(0, int(np.ceil(np.log2(wanted))))))
    schema = "v array<double>, ids array<long>, dim int, cell int, low array<double>"
    dealt = materialise(vectors.mapInArrow(_deal(spark.sparkContext.broadcast(trees)), schema), "dealt")
    ends = [f(F.col("low")[a]).alias(f"{f.__name__}{a}") for f in (F.min, F.max) for a in range(DIMS)]
    cells = materialise(dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), *ends), "cells")
    known: dict[int, list] = {}
    for r in cells.join(spark.createDataFrame([(d,) for d in trees], "dim int"), "dim").toLocalIterator():
        known.setdefault(r.dim, []).append((r.cell, [r[f"min{a}"] for a in range(DIMS)], [r[f"max{a}"] for a in range(DIMS)]))
    boxes = {d: Boxes(*map(np.array, zip(*rows))) for d, rows in known.items()}
    return Index(dealt.select("v", "ids", "dim", "cell"), cells.select("dim", "cell", "blocks"), spark.sparkContext.broadcast(boxes),
                 max((len(b.cell) for b in boxes.values()), default=1))


def _visits(boxes: Broadcast, begin: int, end: int):
    """The cells a query has still to meet among its ``begin``-th to ``end``-th nearest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kth = np.asarray(batch.column("kth"))
            take, dims, cells = [], [], []
            for dim, at, low in _by_length(batch.column("v")):
                box = boxes.value.get(dim)
                for i, p in zip(at.tolist(), low):
                    if box is None:
                        near = np.zeros(1 if begin == 0 else 0, int)
                    else:
                        out = np.maximum(0, np.maximum(box.low - p, p - box.high))
                        far = (out * out).sum(axis=1)
                        order = np.argsort(far, kind="stable")[begin:end]
                        near = box.cell[order[~(far[order] > STOP * kth[i])]]
                    take += [i] * len(near)
                    dims += [dim] * len(near)
                    cells += near.tolist()
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows), batch.column("v").take(rows), batch.column("kth").take(rows),
                                              pa.array(dims, pa.int32()), pa.array(cells, pa.int32())], ["vec_id", "v", "kth", "dim", "cell"])
    return run


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        rows: tuple[list, list, list] = ([], [], [])
        if block.num_rows and queries.num_rows:
            x, qs = _matrix(block["v"]), _matrix(queries["v"])
            norm = np.sqrt((x * x).sum(axis=1))
            tree = Tree(x / norm[:, None])
            ids = block["ids"].to_pylist()
            for qid, q, kth in zip(queries["vec_id"].to_pylist(), qs, queries["kth"].to_pylist()):
                qn = np.sqrt((q * q).sum())
                at = tree.search(q / qn, k + 1, kth)  # one more: the query itself may be among them
                score = (x[at] * q).sum(axis=1) / (norm[at] * qn)
                best = sorted((-s, i) for s, j in zip(score.tolist(), at.tolist()) for i in ids[j] if i != qid)[:k]
                for s, i in best:
                    rows[0].append(qid), rows[1].append(i), rows[2].append(-s)
        return pa.Table.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema)], schema=schema)
    return run


def search(index: Index, queries: DataFrame, k: int, chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """query_id, rank, vec_id, score of ``queries`` (vec_id, v); and how many
    meetings of a query with a cell it took."""
    hits_schema = "query_id long, vec_id long, score double"
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found: list[DataFrame] = []
    state = queries.withColumn("kth", F.lit(float("inf")))
    met, begin, end = 0, 0, 1
    while True:
        visits = state.mapInArrow(_visits(index.boxes, begin, end), "vec_id long, v array<double>, kth double, dim int, cell int")
        asked = materialise(visits.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).join(index.cells, ["dim", "cell"])
                                  .withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")), "asked")
        now = asked.agg(F.sum("n")).first()[0] or 0
        if now or not found:
            left = index.vectors.join(asked, ["dim", "cell"]).select(
                "v", "ids", "dim", "cell", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"),
                F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
            right = visits.join(asked, ["dim", "cell"]).select(
                "vec_id", "v", "kth", "dim", "cell", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"),
                F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
            keys = ["dim", "cell", "block", "chunk"]
            found.append(materialise(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), hits_schema), "hits"))
        met += now
        top = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
            .select("query_id", "rank", "vec_id", "score")
        if not now or end >= index.most:
            return top, met
        # ties at the k-th place stay in
        last = top.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (2 - 2 * F.col("score") + 1e-9).alias("last"))
        state = materialise(queries.join(last, "vec_id", "left").select("vec_id", "v", F.coalesce("last", F.lit(float("inf"))).alias("kth")), "state")
        begin, end = end, end * WIDER


def nearest(rows: DataFrame, every: int = 50, k: int = 5, cell: int = CELL, block: int = BLOCK, chunk: int = CHUNK,
            sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id ``every`` divides."""
    all_rows = usable(rows)
    merged = materialise(
        all_rows.mapInArrow(_smallest_ids(k + 1), "vec_id long, v array<double>").groupBy("v")
                .agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids")), "vectors")
    queries = materialise(all_rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "queries")
    return search(build_index(merged, cell, block, sample), queries, k, chunk)[0]
