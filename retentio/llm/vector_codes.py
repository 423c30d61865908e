"""Vector code compression: product codes learned by rounds of assignment and
floor means, all in integers.

Nearest entries are found on Walsh-Hadamard coefficients.  Parts and entries
are padded with zeros to a power of two P and transformed once, with the rows
of the transform in sequency order (by sign changes), where most of the
energy of smooth or large differences comes first.  The squared differences
of the coefficients sum to P times the squared distance, so every running sum
is a lower bound: an entry goes as soon as its sum exceeds P times the best
distance known for its part, and those that reach the end are compared
exactly.  Ties go to the lower index.  No floating point takes part.

A round is one pass over the written integer vectors: every task sums its
parts per entry and sends at most (parts x entries) rows on; the codebooks
(parts x entries x length integers, a documented bound) are the only thing
that reaches the driver and every task.

Defined results: rows whose vector is null or holds a null or non-finite
component are dropped; the others all have one dimension, the largest among
them, to which shorter vectors are padded with zeros, as is a dimension that
the parts do not divide; an empty vector is all zeros.  With fewer kept rows
than entries there are as many entries as rows.  A null vec_id is the
smallest id; rows of one vec_id are ordered by their components.  Components
beyond 24 bits are worked on as unbounded integers; an error beyond a long is
null.  Null labels are one label.  An empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.llm.common import NULL_ID, join_on, materialise

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Coefficients summed between two eliminations.
STEP = 2
#: Part rows compared at once (times the entries: the widest table of a task).
BLOCK_ROWS = 2048
#: Components up to this size keep every sum of a transform within 63 bits.
PLAIN_BITS = 24
LONG = 2 ** 63


# ------------------------------------------------------------ the transform --
def hadamard(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows by sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    changes = (h[:, 1:] != h[:, :-1]).sum(axis=1)
    return h[np.argsort(changes, kind="stable")]


def padded(length: int) -> int:
    return 1 << max(0, length - 1).bit_length()


def transformed(rows: np.ndarray) -> np.ndarray:
    """Coefficients of each row, padded with zeros, in sequency order."""
    size = padded(rows.shape[1])
    wide = np.zeros((len(rows), size), rows.dtype)
    wide[:, :rows.shape[1]] = rows
    return wide @ hadamard(size).T.astype(rows.dtype)


@dataclass
class Assigned:
    index: np.ndarray  # nearest entry of each row
    error: np.ndarray  # its squared distance
    terms: int         # squared differences that were summed


def nearest_entries(rows: np.ndarray, entries: np.ndarray) -> Assigned:
    """The nearest entry of each row, ties to the lower index; whole numbers in and out."""
    x, c = transformed(rows), transformed(entries)
    n, size = x.shape
    k = len(c)
    every = np.arange(n)
    # first coefficients of all entries; the one that begins best gives the first bound
    total = reduce(np.add, ((x[:, None, s] - c[None, :, s]) ** 2 for s in range(min(STEP, size))))
    guess = total.argmin(axis=1)
    gap = x - c[guess]
    bound = (gap * gap).sum(axis=1)
    terms = n * k * min(STEP, size) + n * size
    row, entry = np.nonzero(total <= bound[:, None])
    total = total[row, entry]
    for at in range(STEP, size, STEP):
        cols = slice(at, min(at + STEP, size))
        gap = x[row, cols] - c[entry, cols]
        total = total + (gap * gap).sum(axis=1)
        terms += gap.size
        held = total <= bound[row]
        row, entry, total = row[held], entry[held], total[held]
    # rows ascend and entries ascend within a row: the first of the smallest is the lowest index
    first = np.searchsorted(row, every)
    least = np.minimum.reduceat(total, first)
    ties = np.flatnonzero(total == least[row])
    best = ties[np.searchsorted(row[ties], every)]
    return Assigned(entry[best], least // size, terms)


# ------------------------------------------------------------ whole vectors --
def whole_vector(vector: list, dim: int) -> list[int]:
    """floor(SCALE * x) of every component, padded to ``dim``."""
    return [floor(SCALE * x) for x in vector] + [0] * (dim - len(vector))


def as_array(rows: list[list[int]], dim: int) -> np.ndarray:
    """Integer rows; as unbounded integers where 63 bits might not hold their sums."""
    if any(abs(v) >> PLAIN_BITS for r in rows for v in r):
        return np.array(rows, object).reshape(len(rows), dim)
    return np.array(rows, np.int64).reshape(len(rows), dim)


def _plain_whole(column: pa.Array, dim: int) -> np.ndarray | None:
    """The same for a whole column at once, where all its vectors have ``dim``
    components of ordinary size (a product by a power of two is exact)."""
    flat = np.asarray(column.flatten().cast(pa.float64()))
    if len(flat) != len(column) * dim:
        return None
    scaled = np.floor(flat * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 2.0 ** PLAIN_BITS:
        return None
    lengths = np.diff(np.asarray(column.offsets))
    return scaled.astype(np.int64).reshape(len(column), dim) if (lengths == dim).all() else None


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if dim and pa.types.is_floating(column.type.value_type):
        fast = _plain_whole(column, dim)
        if fast is not None:
            return fast
    return as_array([whole_vector(v, dim) for v in column.to_pylist()], dim)


# -------------------------------------------------------------- the codebook --
@dataclass
class Codebooks:
    """Entries of every part: ``books[part]`` is a list of integer lists."""
    books: list[list[list[int]]]
    dim: int

    @property
    def length(self) -> int:
        return self.dim // max(1, len(self.books))

    def arrays(self) -> list[np.ndarray]:
        return [as_array(b, self.length) for b in self.books]

    def digest(self) -> str:
        """By part, entry and position within the part."""
        return sha256(",".join(str(v) for b in self.books for e in b for v in e).encode()).hexdigest()


def _assign(whole: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, Assigned]]:
    """(part, its rows, their entries) for blocks of rows."""
    length = books[0].shape[1]
    for part, book in enumerate(books):
        rows = whole[:, part * length:(part + 1) * length]
        if rows.dtype != book.dtype:
            rows, book = rows.astype(object), book.astype(object)
        if not length:
            yield part, rows, Assigned(np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), 0)
            continue
        done = [nearest_entries(rows[at:at + BLOCK_ROWS], book) for at in range(0, len(rows), BLOCK_ROWS)]
        yield part, rows, Assigned(np.concatenate([d.index for d in done]), np.concatenate([d.error for d in done]), sum(d.terms for d in done))


_SUM_SCHEMA = "part int, entry int, n long, total array<string>"  # whole numbers of any length, as text
_SUM_TYPES = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.string()))])


def _sums(books: Codebooks):
    """Per task: rows and component sums of every entry that has any."""
    k = max((len(b) for b in books.books), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = books.arrays()
        counts = np.zeros((len(arrays), k), np.int64)
        totals = np.zeros((len(arrays), k, books.length), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, rows, got in _assign(_matrix(batch.column("v"), books.dim), arrays):
                held = np.zeros((k, books.length), rows.dtype)
                np.add.at(held, got.index, rows)
                totals[part] = totals[part] + held.astype(object)
                counts[part] += np.bincount(got.index, minlength=k)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()),
            pa.array([[str(v) for v in totals[p, e]] for p, e in zip(part, entry)], pa.list_(pa.string()))], schema=_SUM_TYPES)
    return run


def _merge(key: tuple, group: pa.Table) -> pa.Table:
    """The sums of one entry from all tasks (one row a task)."""
    totals = [sum(map(int, column)) for column in zip(*group["total"].to_pylist())]
    n = sum(group["n"].to_pylist())
    return pa.Table.from_arrays([pa.array([v.as_py()], f.type) for v, f in zip(key, _SUM_TYPES)]
                                + [pa.array([n], pa.int64()), pa.array([[str(v) for v in totals]], pa.list_(pa.string()))], schema=_SUM_TYPES)


def _codes(books: Codebooks):
    names = ["vec_id", "label", "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = books.arrays()
        for batch in batches:
            if not batch.num_rows:
                continue
            index, error = [], np.zeros(batch.num_rows, object)
            for _, _, got in _assign(_matrix(batch.column("v"), books.dim), arrays):
                index.append(got.index)
                error = error + got.error.astype(object)
            code = ["".join(f"{i:02x}" for i in row) for row in zip(*(i.tolist() for i in index))]
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()),
                pa.array([int(e) if e < LONG else None for e in error], pa.int64())], names)
    return run


# ---------------------------------------------------------------- the operator --
def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and v of the rows whose vector can be encoded."""
    floating = isinstance(rows.schema["embedding"].dataType.elementType, (T.FloatType, T.DoubleType))

    def good(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) if floating else x.isNotNull()

    return rows.filter(F.col("embedding").isNotNull() & F.forall("embedding", good)).select("vec_id", "label", F.col("embedding").alias("v"))


def first_codebooks(kept: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the smallest ids (at most ``entries`` rows reach the driver)."""
    number = F.coalesce(F.col("vec_id"), F.lit(NULL_ID))
    last = kept.select(number.alias("n")).orderBy("n").limit(entries).agg(F.max("n")).head()[0]  # ids alone, then the few vectors
    first = [] if last is None else kept.filter(number <= last).orderBy(number, "v").limit(entries).select("v").collect()
    rows = [whole_vector(list(r["v"]), dim) for r in first]
    length = dim // parts
    return Codebooks([[r[p * length:(p + 1) * length] for r in rows] for p in range(parts)], dim)


def round_of(kept: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one more round."""
    sums = kept.select("v").mapInArrow(_sums(books), _SUM_SCHEMA)
    out = [[list(e) for e in b] for b in books.books]
    for r in sums.groupBy("part", "entry").applyInArrow(_merge, _SUM_SCHEMA).collect():  # at most parts x entries rows
        out[r["part"]][r["entry"]] = [int(t) // r["n"] for t in r["total"]]
    return Codebooks(out, books.dim)


def learn_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    longest = kept.agg(F.max(F.size("v"))).head()[0] or 0
    books = first_codebooks(kept, -(-longest // parts) * parts, parts, entries)
    for _ in range(rounds if books.length and books.books[0] else 0):
        books = round_of(kept, books)
    return books


def encode_vectors(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every kept row.

    ``code`` has two hexadecimal digits for each part, so ``entries`` is at most 256."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    kept = materialise(usable(rows), "whole-vectors")
    books = learn_codebooks(kept, parts, entries, rounds)
    kind = kept.schema["label"].dataType.simpleString()
    # written, so that the label's join can be split where one label holds most rows
    coded = materialise(kept.mapInArrow(_codes(books), f"vec_id long, label {kind}, code string, error long"), "codes")
    per = materialise(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    return join_on(coded, per, ["label"]).select("vec_id", "label", "code", "error", "label_error",
                                                 F.lit(books.digest()).alias("codebooks_sha256"))
