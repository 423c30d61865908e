"""Line dedup: explode normalised lines, hash, count distinct documents per
hash, drop lines over the threshold and reassemble the rest by position.

Only a 128-bit hash per line is shuffled for counting.  The lines that go are
gathered per document (at most its own lines), and the text is cut and
joined again where it is read, so a line that a third of all documents share
never meets in one task: counts are pre-aggregated and the join back is
between the hash's rows and one row (AQE splits a skewed side).

Defined results: null text counts as empty, an empty text is one empty line;
a null doc_id is the smallest one; repeated rows of one doc_id are one
document and lose the same lines; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import ASCII_SPACE, materialise, with_row_key

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the normalised line, None for a line too short to be judged."""
    key = line.strip(ASCII_SPACE).lower()  # bytes.lower() is A-Z only
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, ths, hs = [], [], []
                for i, th, raw in zip(*(part.column(c).to_pylist() for c in ("__id", "__th", "__raw"))):
                    found = {line_key(x, min_chars) for x in (raw or b"").split(b"\n")} - {None}
                    ids += [i] * len(found)
                    ths += [th] * len(found)
                    hs += sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(hs, pa.binary())],
                    ["__id", "__th", "h"])
    return run


def _cut(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, gone, texts, digests = [], [], [], []
                for raw, drop in zip(part.column("__raw").to_pylist(), part.column("__drop").to_pylist()):
                    raw = raw or b""
                    lines = raw.split(b"\n")
                    n.append(len(lines))
                    if drop:
                        out = set(drop)
                        kept = [x for x in lines if line_key(x, min_chars) not in out]
                        gone.append(len(lines) - len(kept))
                        raw = b"\n".join(kept)
                    else:
                        gone.append(0)
                    texts.append(raw)
                    digests.append(sha256(raw).hexdigest())
                new = {"n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(gone, pa.int64()),
                       "kept_text": pa.array(texts, pa.binary()), "kept_sha256": pa.array(digests, pa.string())}
                old = [c for c in part.schema.names if c not in ("__raw", "__drop")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in old), *new.values()], [*old, *new])
    return run


def dedup_lines(docs: DataFrame, keep: list[str] | None = None, min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, with_text: bool = True) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id unless named) plus ``n_lines``,
    ``n_dropped``, ``kept_text`` and ``kept_sha256``.

    A key of at least ``min_chars`` code points in at least ``min_docs``
    documents stays in the largest doc_id only.
    """
    keep = keep or ["doc_id"]
    # the kept columns travel as one struct, so they cannot clash with those made here
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__doc")
    rows = with_row_key(docs.select(kept, "doc_id", "text")).select("__doc", "__id", "__th", F.col("text").cast("binary").alias("__raw"))
    lines = materialise(rows.select("__id", "__th", "__raw").mapInArrow(_hashes(min_chars), "__id long, __th long, h binary"), "lines")
    # written, so that both sides of the join are plain exchanges and AQE can split a hot hash
    often = materialise(lines.groupBy("h").agg(F.count_distinct("__id").alias("n"), F.max("__id").alias("last"))
                             .filter(F.col("n") >= min_docs).select("h", "last"), "often")
    drop = (lines.join(often, "h").filter(F.col("__id") < F.col("last"))
                 .groupBy("__id", "__th").agg(F.collect_set("h").alias("__drop")))
    both = rows.join(drop, ["__id", "__th"], "left").select("__doc", "__raw", "__drop")
    out = both.mapInArrow(_cut(min_chars), f"__doc {both.schema['__doc'].dataType.simpleString()}, "
                          "n_lines long, n_dropped long, kept_text binary, kept_sha256 string")
    texts = [F.col("kept_text").cast("string").alias("kept_text")] if with_text else []
    return out.select(*[F.col("__doc").getField(c).alias(c) for c in keep], "n_lines", "n_dropped", *texts, "kept_sha256")
