"""Near-duplicate documents by consistent weighted sampling.

Documents are multisets of five-word shingles weighted by tf * idf.  Improved
consistent weighted sampling (Ioffe) draws ``BANDS * ROWS`` samples, each equal
for two documents with the probability of their weighted Jaccard similarity;
documents that agree on all rows of a band share a bucket.  Links are verified
on the exact weighted Jaccard similarity of the whole texts, at ``THRESHOLD``.

Document frequencies are counted over all documents in a hashed table of fixed
width (a sketch; its mean load, the noise of a cell, is subtracted, and is
0.2 % of the documents at 500 shingles a document, whatever their number).
idf = ln(1 + 1 / max(share of documents, MIN_SHARE)): only what more than 5 %
of all documents hold weighs less.  (A steeper idf would make the members of a
large group of copies dissimilar by raising the weight of their few edits over
the text that they share.)

No bucket is expanded into its pairs.
1. Each bucket compares its members with one of them, the most central (whose
   shingles are most frequent on average), and verified links are contracted
   to components.
2. Buckets that still hold several components are finished exactly: a pair at
   the threshold must share a shingle of both prefixes (the rarest shingles up
   to the weight that the threshold lets them miss), and behind the first one
   there must be weight enough in both.  Prefix shingles whose
   documents are all in one component are dropped; the others give the pairs
   between components, which are verified too.  So the bulk of a group of
   copies costs one comparison each, and texts whose own edits outweigh the
   threshold (the usual members of a large group that stay apart) meet nobody.

Equal texts are merged before all this and share a class.

Defined results: null texts are equal to each other, and so are empty ones; a
text without words is in a class with equal texts only; texts under five words
are one shingle; a null doc_id is the smallest; repeated rows share a class;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import ASCII_SPACE, join_on, materialise, with_row_key
from retentio.llm.components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 2
MIN_SHARE = 0.05
CELL_BITS, PIECES = 18, 16
CHUNK = 1 << 14  # shingles worked on at a time
_C1, _C2, _C3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_LOW = np.uint32(0xFFFF)


_IN_WORD = np.ones(256, bool)
_IN_WORD[list(ASCII_SPACE)] = False
_POWERS = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, np.uint64))


def _mix(z: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    z = (z ^ (z >> np.uint64(30))) * _C1
    z = (z ^ (z >> np.uint64(27))) * _C2
    return z ^ (z >> np.uint64(31))


def _mix32(z: np.ndarray) -> np.ndarray:
    return ((z * _C3) >> np.uint64(32)).astype(np.uint32)


def _unit(x: np.ndarray) -> np.ndarray:
    """16-bit numbers as uniforms in (0, 1)."""
    return (x.astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -16)


_SEEDS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _C3)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash for each word (polynomial in its bytes, then mixed)."""
    codes = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(_IN_WORD[codes])
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    within = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return _mix(np.add.reduceat((codes[at] + np.uint64(1)) * _POWERS[within & 4095], first))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles and their counts."""
    h = word_hashes((text or "").lower().encode("utf-8", "replace"))
    n = len(h)
    if not n:
        return h, np.zeros(0, np.int64)
    size = min(WORDS, n)
    s = h[:n - size + 1].copy()
    for k in range(1, size):
        s = s * _C3 + h[k:n - size + 1 + k]
    s = np.sort(_mix(s))
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[first], np.diff(np.append(first, len(s)))


class Frequencies:
    """Document frequencies in hashed cells, and the weights they give."""

    def __init__(self, cells: np.ndarray, n_docs: int):
        self.cells, self.n_docs = cells, max(1, n_docs)
        self.noise = cells.sum() / len(cells)

    def count(self, h: np.ndarray) -> np.ndarray:
        return self.cells[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]

    def weights(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        share = np.clip((self.count(h) - self.noise) / self.n_docs, MIN_SHARE, 1.0)
        return tf * np.log1p(1 / share)


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells, n = np.zeros(1 << CELL_BITS, np.int32), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            texts = batch.column("text").slice(at, 256).to_pylist()
            n += len(texts)
            held = np.concatenate([shingles(t)[0] for t in texts])
            cells += np.bincount((held >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells)).astype(np.int32)
    if n:
        parts = [p.tobytes() for p in cells.reshape(PIECES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary()),
                                          pa.array([n] + [0] * (PIECES - 1), pa.int64())], ["piece", "cells", "n"])


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    n = 0
    for batch in batches:
        for piece, raw, more in zip(*(batch.column(c).to_pylist() for c in ("piece", "cells", "n"))):
            total[piece] = total.get(piece, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
            n += more
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary()),
                                          pa.array([n] + [0] * (len(total) - 1), pa.int64())], ["piece", "cells", "n"])


def count_frequencies(docs: DataFrame) -> Frequencies:
    """One pass over all texts; the driver gets the fixed table (2 MB)."""
    kind = "piece int, cells binary, n long"
    parts = docs.select("text").mapInArrow(_count_cells, kind).repartition(PIECES, "piece").mapInArrow(_add_cells, kind).collect()
    cells = np.zeros((PIECES, (1 << CELL_BITS) // PIECES), np.int64)
    for r in parts:
        cells[r["piece"]] += np.frombuffer(r["cells"], np.int64)
    return Frequencies(cells.reshape(-1), sum(r["n"] for r in parts))


def weighted_samples(h: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Samples of consecutive weighted sets, one row per set.  The randomness of
    an element depends on its hash and the number of the sample alone."""
    lw = np.log(w).astype(np.float32)
    lens = np.diff(np.append(starts, len(h)))
    out = np.empty((len(starts), len(_SEEDS)), np.uint64)
    for k, seed in enumerate(_SEEDS):
        z = _mix(h ^ seed)
        u = z.view(np.uint32).reshape(-1, 2)
        v = _mix32(z)
        # Gamma(2, 1) variables are -ln of a product of two uniforms
        r = -np.log(_unit(u[:, 0] >> np.uint32(16)) * _unit(u[:, 0] & _LOW))
        c = -np.log(_unit(u[:, 1] >> np.uint32(16)) * _unit(u[:, 1] & _LOW))
        beta = v.astype(np.float32) * np.float32(2.0 ** -32)
        t = np.floor(lw / r + beta)
        la = np.log(c) - r * (t - beta + 1)
        least = np.minimum.reduceat(la, starts)
        at = np.flatnonzero(la == np.repeat(least, lens))
        at = at[np.searchsorted(at, starts)]  # the first of equals: hashes are sorted
        out[:, k] = _mix(h[at] * _C1 + t[at].astype(np.int64).view(np.uint64))
    return out


def bands_of(samples: np.ndarray) -> np.ndarray:
    """Bucket of each band, as signed 64-bit."""
    s = samples.reshape(len(samples), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _C2, s.shape[:2]).copy()
    for k in range(ROWS):
        h = _mix(h * _C3 + s[:, :, k])
    return h.view(np.int64)


def _signatures(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq: Frequencies = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bands: list = [[]] * part.num_rows
                central = [0.0] * part.num_rows
                group: list[tuple[int, np.ndarray, np.ndarray]] = []
                waiting = 0

                def flush():
                    if group:
                        sizes = [len(h) for _, h, _ in group]
                        starts = np.concatenate(([0], np.cumsum(sizes[:-1]))).astype(np.int64)
                        got = bands_of(weighted_samples(np.concatenate([g[1] for g in group]), np.concatenate([g[2] for g in group]), starts))
                        for (k, _, _), b in zip(group, got):
                            bands[k] = b
                        group.clear()

                for k, text in enumerate(part.column("text").to_pylist()):
                    h, tf = shingles(text)
                    if len(h):
                        central[k] = float(np.log1p(freq.count(h)).mean())
                        group.append((k, h, freq.weights(h, tf)))
                        waiting += len(h)
                        if waiting >= CHUNK:
                            flush()
                            waiting = 0
                flush()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("__id", "t1", "t2")), pa.array(central, pa.float64()),
                                                  pa.array(bands, pa.list_(pa.int64()))], ["__id", "t1", "t2", "central", "bands"])
    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def _verify(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq: Frequencies = shared.value
        seen: OrderedDict[int, tuple] = OrderedDict()  # texts met lately

        def weighted(tid: int, text: str):
            if tid not in seen:
                h, tf = shingles(text)
                seen[tid] = (h, freq.weights(h, tf))
                if len(seen) > 64:
                    seen.popitem(last=False)
            else:
                seen.move_to_end(tid)
            return seen[tid]

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cols = batch.slice(at, 64).to_pydict()
                sims = [similarity(weighted(a, x), weighted(b, y)) for a, b, x, y in zip(cols["a"], cols["b"], cols["text_a"], cols["text_b"])]
                good = [k for k, s in enumerate(sims) if s >= threshold]
                yield pa.RecordBatch.from_arrays([pa.array([cols["a"][k] for k in good], pa.int64()), pa.array([cols["b"][k] for k in good], pa.int64()),
                                                  pa.array([sims[k] for k in good], pa.float64())], ["a", "b", "similarity"])
    return run


def prefix(h: np.ndarray, w: np.ndarray, rank: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the prefix: in order of rank (rarest first, then hash) those
    from which on at least ``threshold`` of the weight is left; and that weight."""
    order = np.lexsort((h, rank))
    left = np.cumsum(w[order][::-1])[::-1]
    keep = left >= threshold * w.sum() * (1 - 1e-9)
    return h[order][keep], left[keep]


def _prefixes(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq: Frequencies = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                which, tokens, total, behind = [], [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    h, tf = shingles(text)
                    w = freq.weights(h, tf)
                    p, left = prefix(h, w, freq.count(h), threshold)
                    which.append(np.full(len(p), k)), tokens.append(p.view(np.int64))
                    total.append(np.full(len(p), w.sum())), behind.append(left)
                take = pa.array(np.concatenate(which), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in ("tid", "root")), pa.array(np.concatenate(tokens), pa.int64()),
                                                  pa.array(np.concatenate(total), pa.float64()), pa.array(np.concatenate(behind), pa.float64())],
                                                 ["tid", "root", "token", "total", "behind"])
    return run


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Rows per Arrow batch for the jobs run inside: texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def token_sides(tokens: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The two sides (tid, root, token, total, behind, lane) of the join on prefix tokens.

    Of a link the lighter text has at least ``2 t / (1 + t)`` of its own weight
    behind the first shared token, so only such rows are on the index side; a
    token without one is gone before the join.  Texts of one root need no
    pair: of the root with most texts at a token, rows of the index side meet
    the other roots only (lane 1), while all others meet every row (lane 0).
    """
    share = threshold / (1 + threshold) * (1 - 1e-9)
    rows = tokens.withColumn("strong", F.col("behind") >= share * (2 * F.col("total")))
    roots = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"), F.max("strong").alias("strong"))
    mains = roots.groupBy("token").agg(F.count(F.lit(1)).alias("n_roots"), F.max("strong").alias("any"), F.max_by("root", F.struct("n", "root")).alias("main")) \
                 .filter("n_roots > 1 and any").select("token", "main")
    rows = rows.join(mains, "token").withColumn("is_main", F.col("root") == F.col("main"))
    cols = ["tid", "root", "token", "total", "behind"]
    index = rows.filter("strong").select(*cols, F.col("is_main").cast("int").alias("lane"))
    probe = rows.select(*cols, F.explode(F.when(F.col("is_main"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("lane"))
    return index, probe


def candidate_pairs(index: DataFrame, probe: DataFrame, threshold: float) -> DataFrame:
    """Different (a, b) of different roots that may be links, a the lighter.

    At the first token that a pair shares, all it has in common lies behind."""
    x, y = (d.select("token", "lane", *[F.col(c).alias(f"{c}_{k}") for c in ("tid", "root", "total", "behind")]) for d, k in ((index, "a"), (probe, "b")))
    lighter = F.struct("total_a", "tid_a") < F.struct("total_b", "tid_b")
    needed = threshold / (1 + threshold) * (1 - 1e-9) * (F.col("total_a") + F.col("total_b"))
    return x.join(y, ["token", "lane"]).filter(lighter & (F.col("root_a") != F.col("root_b")) & (F.least("behind_a", "behind_b") >= needed)) \
            .select(F.col("tid_a").alias("a"), F.col("tid_b").alias("b")).distinct()


def _links(pairs: DataFrame, texts: DataFrame, shared, threshold: float, name: str) -> DataFrame:
    a = texts.select(F.col("tid").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("tid").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return materialise(both.mapInArrow(_verify(shared, threshold), "a long, b long, similarity double"), name)


def find_links(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: __id, t1, t2; texts: tid, t1, t2, rep; links between texts: a, b, similarity)."""
    spark = docs.sparkSession
    rows = with_row_key(docs.select("doc_id", "text")).select(
        "__id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), F.col("text")).alias("t2"), F.col("text").cast("string").alias("text"))
    with arrow_batches(spark, 1000):
        shared = spark.sparkContext.broadcast(count_frequencies(rows))  # fixed size
        signed = materialise(rows.mapInArrow(_signatures(shared), "__id long, t1 long, t2 long, central double, bands array<long>"), "signed")
        texts = materialise(signed.groupBy("t1", "t2").agg(F.min("__id").alias("rep"), F.first("central").alias("central"), F.first("bands").alias("bands"))
                                  .withColumn("tid", F.monotonically_increasing_id()), "texts")
        in_bucket = texts.select("tid", "central", F.explode("bands").alias("bucket"))
        buckets = materialise(in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max_by("tid", F.struct("central", "tid")).alias("leader"))
                                       .filter("n > 1").select("bucket", "leader"), "buckets")
        members = materialise(in_bucket.select("tid", "bucket").join(buckets, "bucket"), "members")
        pairs = materialise(members.filter("tid <> leader").select(F.col("tid").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
        wanted = members.select("tid").distinct().join(texts.select("tid", "t1", "t2", F.col("rep").alias("__id")), "tid")
        near = materialise(rows.join(wanted, ["t1", "t2", "__id"]).dropDuplicates(["t1", "t2", "__id"]).select("tid", "text"), "near-texts")
        links = _links(pairs, near, shared, threshold, "links")
        # what is left: buckets with several components
        root = components(links).withColumnRenamed("node", "tid")
        rooted = materialise(members.select("tid").distinct().join(root, "tid", "left").select("tid", F.coalesce("root", "tid").alias("root")), "rooted")
        mixed = members.join(rooted, "tid").groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket")
        unfinished = members.join(mixed, "bucket").select("tid").distinct().join(rooted, "tid")
        tokens = materialise(near.join(unfinished, "tid").select("tid", "root", "text").mapInArrow(
            _prefixes(shared, threshold), "tid long, root long, token long, total double, behind double"), "tokens")
        index, probe = (materialise(x, n) for x, n in zip(token_sides(tokens, threshold), ("index-tokens", "probe-tokens")))
        more = candidate_pairs(index, probe, threshold)
        done = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = materialise(more.join(done, ["a", "b"], "left_anti"), "more-pairs")
        rest = _links(more, near, shared, threshold, "more-links")
    return signed.select("__id", "t1", "t2"), texts.select("tid", "t1", "t2", "rep"), links.union(rest)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of the class),
    representative, and the row key (__id, t1, t2)."""
    signed, texts, links = find_links(docs, threshold)
    root = components(links.select("a", "b")).withColumnRenamed("node", "tid")
    t = texts.join(root, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    t = materialise(t, "classes")
    least = t.groupBy("root").agg(F.min(F.struct("rep", "tid")).alias("first"))
    t = t.join(least, "root").select("t1", "t2", "rep", F.col("first.rep").alias("class"), (F.col("tid") == F.col("first.tid")).alias("leads"))
    out = join_on(signed, t, ["t1", "t2"])
    null_id = F.lit(-(2 ** 63)).cast("bigint")
    return out.select(F.nullif("__id", null_id).alias("doc_id"), F.nullif("class", null_id).alias("class_id"),
                      (F.col("leads") & (F.col("__id") == F.col("rep"))).alias("representative"), "__id", "t1", "t2")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of ``docs``, all columns."""
    keep = near_duplicates(docs, threshold).filter("representative").select("__id", "t1", "t2").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", "text")
    rows = with_row_key(rows).select("__doc", "__id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), F.col("text")).alias("t2"))
    return rows.join(keep, ["__id", "t1", "t2"], "left_semi").dropDuplicates(["__id", "t1", "t2"]).select("__doc.*")
