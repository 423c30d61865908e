"""Quality rules: per-document counts and cross-document line frequency.

Normalised lines are hashed, distinct documents per (host, hash) are counted,
lines above the limit are removed and documents that this depletes are
rejected.  The host of a document is its ``source``.  A line is over the limit
when more than ``min_docs`` documents of the host hold it, however many
documents the host has.  A document is a doc_id with its text: repeated rows
count once, copies under other ids count each.  A document is depleted when
less than ``min_left`` of its words are left.

Shape: one Python pass mints narrow rows (counts, hashes and word counts per
distinct line); everything after is grouped counting with map-side partial
aggregation and joins that AQE can split.  Text is read again only by
``clean_documents``.

Defined results: null text has no words (and is rejected by the base rule);
a null source is a host of its own; repeated rows are judged alike; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import ASCII_SPACE, join_on, materialise, with_row_key

SYMBOLS = b"#*$%&|<>"
MIN_DOCS = 10
MIN_LEFT = 0.3
_NOT_COUNTED = ASCII_SPACE + bytes(range(0x80, 0xC0))  # UTF-8 continuation bytes
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    grams = (h[:-2] * _M1 + h[1:-1]) * _M2 + h[2:]
    order = np.argsort(grams, kind="stable")
    equal = grams[order][1:] == grams[order][:-1]
    if not equal.any():
        return 0
    hit = np.zeros(len(words), bool)
    at = np.concatenate([order[1:][equal], order[:-1][equal]])
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def line_hash(line: bytes) -> int | None:
    """Signed 64-bit hash of the lower-cased line with runs of space as one."""
    words = line.split()
    if not words:
        return None
    return xxhash.xxh3_64_intdigest(b" ".join(words).lower()) - 2 ** 63


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            cols: list[list] = [[] for _ in range(7)]
            for raw in part.column("__raw").to_pylist():
                raw = raw or b""
                words = raw.split()
                seen: set[bytes] = set()
                dup, lines = 0, {}
                for line in raw.split(b"\n"):
                    h = line_hash(line)
                    if h is None:
                        continue
                    lines[h] = lines.get(h, 0) + len(line.split())
                    dup += line in seen
                    seen.add(line)
                for col, v in zip(cols, (len(words), len(raw.translate(None, _NOT_COUNTED)),
                                         len(raw) - len(raw.translate(None, SYMBOLS)), dup,
                                         repeated_words(words), list(lines), list(lines.values()))):
                    col.append(v)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__lines", "__line_words"]
            old = [c for c in part.schema.names if c != "__raw"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in old), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                             [*old, *names])


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> tuple[DataFrame, DataFrame]:
    """(verdicts: one row per input row; lines over the limit: __host, h)."""
    rows = with_row_key(docs.select("doc_id", "text", "source"))
    base = rows.select("doc_id", "__id", "__th", F.col("source").alias("__host"), F.col("text").cast("binary").alias("__raw"))
    kind = base.schema["doc_id"].dataType.simpleString()
    counts = materialise(base.mapInArrow(
        _measure, f"doc_id {kind}, __id long, __th long, __host string, n_words long, word_chars long, n_symbols long, "
                  "n_dup_lines long, n_repeat_words long, __lines array<long>, __line_words array<long>"
    ).withColumn("__row", F.monotonically_increasing_id()), "quality")
    each = counts.select("__row", "__id", "__th", "__host", F.explode(F.arrays_zip("__lines", "__line_words")).alias("x")) \
                 .select("__row", "__id", "__th", "__host", F.col("x.__lines").alias("h"), F.col("x.__line_words").alias("w"))
    over = each.groupBy("__host", "h").agg(F.count_distinct("__id", "__th").alias("n")).filter(F.col("n") > min_docs).select("__host", "h")
    gone = join_on(each, over, ["__host", "h"]).groupBy("__row").agg(F.sum("w").alias("n_removed_words"))
    out = counts.join(gone, "__row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return out.select("doc_id", "__id", "__th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "n_removed_words", failed.alias("base_failed"),
                      (~failed & (left >= min_left * F.col("n_words"))).alias("kept")), over


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the base counts, ``n_removed_words``, ``base_failed``, ``kept``."""
    return judge(docs, **limits)[0].drop("__id", "__th")


def _strip_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = []
            for raw, over in zip(part.column("__raw").to_pylist(), part.column("__over").to_pylist()):
                if raw is not None and over:
                    out = set(over)
                    raw = b"\n".join(x for x in raw.split(b"\n") if line_hash(x) not in out)
                texts.append(raw)
            old = [c for c in part.schema.names if c not in ("__raw", "__over")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in old), pa.array(texts, pa.binary())], [*old, "__text"])


def clean_documents(docs: DataFrame, **limits) -> DataFrame:
    """The kept rows of ``docs``, all columns, without the lines over the limit."""
    verdicts, over = judge(docs, **limits)
    over = materialise(over, "over")
    # the row travels as one struct, so its columns cannot clash with those made here
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__doc")
    rows = with_row_key(docs.select(rest, "doc_id", "text", "source")) \
        .select("__doc", "__id", "__th", F.col("source").alias("__host"), F.col("text").cast("binary").alias("__raw"))
    kept = verdicts.filter("kept").select("__id", "__th").dropDuplicates()
    rows = rows.join(kept, ["__id", "__th"], "left_semi")
    lines = rows.select("__id", "__th", "__host", "__raw").mapInArrow(_line_rows, "__id long, __th long, __host string, h long")
    hit = join_on(lines, over, ["__host", "h"]).groupBy("__id", "__th").agg(F.collect_set("h").alias("__over"))
    both = rows.join(hit, ["__id", "__th"], "left").select("__doc", "__raw", "__over")
    out = both.mapInArrow(_strip_lines, f"__doc {both.schema['__doc'].dataType.simpleString()}, __text binary")
    return out.select(*[(F.col("__text").cast("string") if c == "text" else F.col("__doc").getField(c)).alias(c) for c in docs.columns])


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            where, hs = [], []
            for k, raw in enumerate(part.column("__raw").to_pylist()):
                found = {line_hash(x) for x in (raw or b"").split(b"\n")} - {None}
                where += [k] * len(found)
                hs += found
            take = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in ("__id", "__th", "__host")), pa.array(hs, pa.int64())],
                                             ["__id", "__th", "__host", "h"])
