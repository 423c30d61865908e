"""Fill-in-the-middle: a text is cut into prefix, middle and suffix at unit
boundaries found in a wavelet matrix over character classes.

The texts of one chunk stand one behind the other in one wavelet matrix over
four character classes.  A unit (line, sentence, word, character) ends behind
every character of its end classes, so the boundaries before a place are the
sum of those classes' ranks.  A cut behind the k-th unit of a text is a select
where one class ends a unit, and a bisection on the summed ranks where several
do.  All texts of a chunk are counted and cut by the same vectorised queries.

Rows are worked on alone, in chunks of bounded length: nothing is shuffled,
and a lost task is simply run again.  Which places are cut is decided by a
hash of the doc_id, so reruns agree.

Defined results: a null text counts as empty, an empty text has no unit and
stays plain, as does a text that holds one of the marks; a null doc_id is
hashed as the empty string; repeated rows get equal results each; an empty
table gives an empty table; any other column of the input is ignored, or
carried under ``keep`` whatever its name; texts of any length are cut whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 texts so many are transformed, and of those so many with the suffix first.
RATE, SPM_RATE = 100, 50
#: Characters of one wavelet matrix (a longer text has its own).
CHUNK_CHARS = 1 << 21

NEWLINE, SPACE, STOP, OTHER = range(4)
#: The classes that end a unit.
UNITS = {"line": (NEWLINE,), "sentence": (NEWLINE, STOP), "word": (NEWLINE, SPACE), "char": (NEWLINE, SPACE, STOP, OTHER)}


def _class_table() -> np.ndarray:
    out = np.full(1 << 16, OTHER, np.uint8)
    for marks, kind in ((".!?。！？", STOP), (" \t\x0b\x0c\r　", SPACE), ("\n", NEWLINE)):
        out[[ord(c) for c in marks]] = kind
    return out


_CLASSES = _class_table()


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return _CLASSES[np.minimum(points, len(_CLASSES) - 1)]


class BitVector:
    """Bits in words of 64 with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 - len(packed) % 8, np.uint8)]).view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th one or zero (from 0)."""
        before = self.before if bit else 64 * np.arange(len(self.before)) - self.before
        word = np.searchsorted(before, k, "right") - 1
        held = self.words[word] if bit else ~self.words[word]
        bits = np.unpackbits(held.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return 64 * word + (np.cumsum(bits, axis=1) <= (k - before[word])[:, None]).sum(axis=1)


class WaveletMatrix:
    """Ranks and selects of every class of a sequence of classes."""

    def __init__(self, classes: np.ndarray, n_classes: int = 4):
        self.levels: list[BitVector] = []
        self.shifts = range(max(1, (n_classes - 1).bit_length()) - 1, -1, -1)
        for shift in self.shifts:
            bit = (classes >> shift) & 1
            self.levels.append(BitVector(bit))
            classes = np.concatenate([classes[bit == 0], classes[bit == 1]])  # stable: zeros first

    def _down(self, kind: int, at: np.ndarray) -> np.ndarray:
        for shift, level in zip(self.shifts, self.levels):
            ones = level.rank(at)
            at = level.zeros + ones if (kind >> shift) & 1 else at - ones
        return at

    def rank(self, kind: int, at: np.ndarray) -> np.ndarray:
        """How often ``kind`` stands before each place."""
        return self._down(kind, at) - self._down(kind, np.zeros_like(at))

    def select(self, kind: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th ``kind`` (from 0; it must be there)."""
        at = self._down(kind, np.zeros_like(k)) + k
        for shift, level in zip(reversed(self.shifts), reversed(self.levels)):
            bit = (kind >> shift) & 1
            at = level.select(at - level.zeros if bit else at, bit)
        return at


class Units:
    """Unit counts and cuts of the texts of one chunk."""

    def __init__(self, texts: list[str], unit: str = "line"):
        self.ends = UNITS[unit]
        classes = [char_classes(t) for t in texts]
        sizes = np.array([len(c) for c in classes], np.int64)
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        whole = np.concatenate([*classes, np.zeros(0, np.uint8)])
        self.matrix = WaveletMatrix(whole)
        self.first = self._ends_before(self.start)
        self.n_ends = self._ends_before(self.stop) - self.first
        closed = np.zeros(len(texts), bool)
        held = sizes > 0
        closed[held] = np.isin(whole[self.stop[held] - 1], self.ends)
        self.counts = self.n_ends + (held & ~closed)

    def _ends_before(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(kind, at) for kind in self.ends)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """Characters of each text's first ``units`` units."""
        at = np.where(units > self.n_ends, self.stop, self.start)
        inside = (units > 0) & (units <= self.n_ends)
        goal = (self.first + units)[inside]
        if len(self.ends) == 1:
            at[inside] = self.matrix.select(self.ends[0], goal - 1) + 1
        elif inside.any():
            lo, hi = self.start[inside], self.stop[inside]  # fewer than goal ends before lo, goal before hi
            while (hi - lo > 1).any():
                mid = (lo + hi) >> 1
                enough = self._ends_before(mid) >= goal
                lo, hi = np.where(enough, lo, mid), np.where(enough, mid, hi)
            at[inside] = hi
        return at - self.start


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers that depend on the seed and the doc_id alone."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def render(prefix: str, middle: str, suffix: str, form: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(one):
        raise ValueError(f"an output of form {form} begins with {one}")
    first, rest = output[len(one):].split(two, 1)
    second, middle = rest.split(MIDDLE, 1)
    return first + middle + second if form == "psm" else second + middle + first


def transform(ids: list[int | None], texts: list[str], unit: str = "line", seed: int = SEED,
              rate: int = RATE, spm_rate: int = SPM_RATE) -> dict[str, list]:
    """The transformed texts of one chunk, column by column."""
    units = Units(texts, unit)
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    one, two = h[:, 0] % (units.counts + 1), h[:, 1] % (units.counts + 1)
    first, second = units.cut(np.minimum(one, two)), units.cut(np.maximum(one, two))
    out: dict[str, list] = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")}
    for text, n, a, b, (h3, h4) in zip(texts, units.counts.tolist(), first.tolist(), second.tolist(), h[:, 2:].tolist()):
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
            form, output = "plain", text
        else:
            form = "spm" if h4 % 100 < spm_rate else "psm"
            output = render(text[:a], text[a:b], text[b:], form)
        plain = form == "plain"
        for name, value in zip(out, (n, form, None if plain else a, None if plain else b - a, output,
                                     sha256(output.encode()).hexdigest(), sha256(restore(output, form).encode()).hexdigest())):
            out[name].append(value)
    return out


_TYPES = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(),
          "output": pa.string(), "output_sha256": pa.string(), "restored_sha256": pa.string()}


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows whose texts together are about CHUNK_CHARS long: (first row, texts)."""
    first, texts, size = 0, [], 0
    for at, text in enumerate(batch.column("__text")):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK_CHARS:
            yield first, texts
            first, texts, size = at + 1, [], 0
    if texts:
        yield first, texts


def _run(unit: str, seed: int, rate: int, spm_rate: int, with_text: bool):
    names = [c for c in _TYPES if with_text or c != "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch):
                part = batch.slice(first, len(texts))
                made = transform(part.column("__id").to_pylist(), texts, unit, seed, rate, spm_rate)
                yield pa.RecordBatch.from_arrays([part.column("__doc"), *(pa.array(made[c], _TYPES[c]) for c in names)], ["__doc", *names])
    return run


def fill_in_middle(docs: DataFrame, keep: list[str] | None = None, unit: str = "line", seed: int = SEED,
                   rate: int = RATE, spm_rate: int = SPM_RATE, with_text: bool = True) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id unless named) plus ``n`` (units),
    ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (null
    if plain), ``output`` and the digests of the output and of the text
    rebuilt from it."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    keep = keep or ["doc_id"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__doc"),
                       F.col("doc_id").cast("bigint").alias("__id"), F.col("text").alias("__text"))
    types = {pa.int64(): "long", pa.string(): "string"}
    made = ", ".join(f"{c} {types[t]}" for c, t in _TYPES.items() if with_text or c != "output")
    out = rows.mapInArrow(_run(unit, seed, rate, spm_rate, with_text), f"__doc {rows.schema['__doc'].dataType.simpleString()}, {made}")
    return out.select(*[F.col("__doc").getField(c).alias(c) for c in keep], *[c for c in _TYPES if with_text or c != "output"])
