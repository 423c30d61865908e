"""Secret scan: fixed patterns plus a randomness test battery.

Patterns find assignments, access keys and long hex runs.  The battery looks
at every other run of 16 or more token characters: an encoding is inferred
(digits, hex, letters of one case, base36 of one case, base64), and under it
three tests ask whether the run could be random: chi-squared uniformity over
the alphabet, runs above and below its middle, and lag-1 serial correlation.
Fisher's method combines them into one p-value, which is large for random
strings and small for words.

How often text looks that random depends on its length and on the encoding.
So the letters of every document's neighbouring words (long runs left out) are
joined and cut from end to end into reference strings whose lengths go
through the bands' least lengths in turn, each written in every encoding
(hex: as character codes; digits: the alphabet cut into ten).  Strings of a
fixed list of common words count with them, with the same weight for a table
of any size.  The share of reference strings that
look at least as random is a run's p-value against "this is text", and
Benjamini-Hochberg over all runs of the corpus decides which are reported.
The counts behind both are a table of encodings by bands by score bins, whose
size is fixed.

Defined results: null text is empty; spans are in code points; repeated rows
are scanned each; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import materialise

# The kinds in their order, and the patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 6, 20, 24, 16
#: Lower ends of the length bands, and score bins per band.
BANDS, BINS = (16, 20, 24, 32, 48, 64, 96, 128, 192, 256), 64
FALSE_DISCOVERY = 0.05
#: Reference strings that the fixed words give for each encoding and band.
FIXED = 20_000

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_DIGITS, _LOWER26 = b"0123456789", b"abcdefghijklmnopqrstuvwxyz"
_LOWER36, _UPPER36 = b"0123456789abcdefghijklmnopqrstuvwxyz", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE64 = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_URLSAFE = bytes.maketrans(b"-_", b"+/")
#: Symbols of each encoding; the two cases of hex and base36 count as one.
SIZES = (10, 16, 26, 36, 64)
_NOT_LETTERS = bytes(set(range(256)) - set(_LOWER26) - set(_LOWER26.upper()))
_AS_LOWER = bytes.maketrans(_LOWER26.upper(), _LOWER26)
COMMON = b"""the of and to in is that it was for on are with as his they be at one have this from or had by hot but some what there we
can out other were all your when up use word how said an each she which do their time if will way about many then them would write
like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than
call first people may down side been now find any new work part take get place made live where after back little only round man
year came show every good me give our under name very through just form much great think say help low line before turn cause same
mean differ move right boy old too does tell sentence set three want air well also play small end put home read hand port large
und der die das nicht ein eine ist mit von auf dem sich auch werden haben oder wenn nur noch nach wird bei aus durch zwischen
les des est pour dans une que qui sur pas plus avec tout faire sont mais comme nous vous leur sans deux entre encore toujours
los las del por con para una como pero sus este entre cuando muy sin sobre ser tiene todo esta desde nos durante siempre""".split()


def long_runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(begin, end) of the runs of True of at least that length."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist()))


def base_spans(raw: bytes, codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, kind, end) of the fixed patterns, in bytes."""
    out = []
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if len(m[1]) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= MIN_ACCESS]
    out += [(b, 2, e) for b, e in long_runs(_HEX[codes], MIN_HEX)]
    return sorted(out)


def _chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees > x), by Wilson and Hilferty's cube root."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def alphabet(token: bytes) -> bytes:
    """Symbols of the inferred encoding, in order of value."""
    chars = set(token)
    if chars <= set(_DIGITS):
        return _DIGITS
    if is_word(token):
        return _LOWER26
    digits = chars & set(b"0123456789")
    if digits and chars <= set(_LOWER36[:16]):
        return _LOWER36[:16]
    if digits and chars <= set(_UPPER36[:16]):
        return _UPPER36[:16]
    if chars <= set(_LOWER36):
        return _LOWER36
    if chars <= set(_UPPER36):
        return _UPPER36
    return _BASE64


def randomness(token: bytes) -> float:
    """Combined p-value of the battery under the inferred encoding."""
    token = token.rstrip(b"=")
    symbols = alphabet(token)
    if symbols is _LOWER26:
        token = token.lower()
    if symbols is _BASE64:
        token = token.translate(_URLSAFE).replace(b"=", b"")
    value = {c: v for v, c in enumerate(symbols)}
    x = [value[c] for c in token]
    n, a = len(x), len(symbols)
    if n < 8:
        return 0.0
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    uniform = _chi2_tail(max(1e-9, a / n * sum(c * c for c in counts.values()) - n), a - 1)
    above = [v * 2 >= a for v in x]
    n1 = sum(above)
    n2 = n - n1
    if n1 and n2:
        runs = 1 + sum(p != q for p, q in zip(above, above[1:]))
        mean = 1 + 2 * n1 * n2 / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        order = math.erfc(abs(runs - mean) / math.sqrt(2 * var))
    else:
        order = 2.0 ** (1 - n)
    m = sum(x) / n
    dev = sum((v - m) ** 2 for v in x)
    r = sum((p - m) * (q - m) for p, q in zip(x, x[1:])) / dev if dev else 1.0
    serial = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, order, serial))
    half = fisher / 2  # chi-squared with 6 degrees has a closed tail
    return math.exp(-half) * (1 + half + half * half / 2) if half < 700 else 0.0


_erfc = np.frompyfunc(math.erfc, 1, 1)


def randomness_of(x: np.ndarray, a: int) -> np.ndarray:
    """``randomness`` of each row of values under an alphabet of ``a`` symbols."""
    k, n = x.shape
    tail = lambda z: _erfc(z).astype(float)
    counts = np.bincount((x + a * np.arange(k)[:, None]).ravel(), minlength=k * a).reshape(k, a)
    d = a - 1
    chi = np.maximum(1e-9, a / n * (counts * counts).sum(1) - n)
    uniform = 0.5 * tail(((chi / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)) / math.sqrt(2))
    above = x * 2 >= a
    n1 = above.sum(1)
    runs = 1 + (above[:, 1:] != above[:, :-1]).sum(1)
    mean = 1 + 2 * n1 * (n - n1) / n
    var = np.maximum(1e-9, (mean - 1) * (mean - 2) / (n - 1))
    order = np.where((n1 > 0) & (n1 < n), tail(np.abs(runs - mean) / np.sqrt(2 * var)), 2.0 ** (1 - n))
    y = x - x.mean(1, keepdims=True)
    dev = (y * y).sum(1)
    r = np.where(dev > 0, (y[:, 1:] * y[:, :-1]).sum(1) / np.where(dev > 0, dev, 1), 1.0)
    serial = tail(np.abs(r + 1 / n) * math.sqrt(n / 2))
    half = -sum(np.log(np.maximum(p, 1e-300)) for p in (uniform, order, serial))
    return np.where(half < 700, np.exp(-np.minimum(half, 700)) * (1 + half + half * half / 2), 0.0)


def encoded(letters: np.ndarray, kind: int) -> np.ndarray:
    """Rows of letters (0 to 25) as values of an encoding, of the same length."""
    if SIZES[kind] == 10:
        return letters * 10 // 26
    if SIZES[kind] == 16:  # two hex digits a letter
        code = letters[:, :(letters.shape[1] + 1) // 2] + ord("a")
        return np.stack([code >> 4, code & 15], 2).reshape(len(letters), -1)[:, :letters.shape[1]]
    return letters + {26: 0, 36: 10, 64: 26}[SIZES[kind]]


def _bin(p: float) -> int:
    return 0 if p <= 1e-8 else min(BINS - 1, int((1 + math.log10(p) / 8) * BINS))


def cell(token: bytes) -> int:
    """Encoding, band and score bin of a run; the bins are even in log p down to 1e-8."""
    token = token.rstrip(b"=")
    kind = SIZES.index(len(alphabet(token)))
    band = max(0, sum(len(token) >= b for b in BANDS) - 1)
    return (kind * len(BANDS) + band) * BINS + _bin(randomness(token))


def reference_cells(letters: np.ndarray, band: int, kind: int) -> np.ndarray:
    """Cells of reference strings, given as rows of letters."""
    p = randomness_of(encoded(letters, kind), SIZES[kind])
    bins = np.where(p <= 1e-8, 0, np.minimum(BINS - 1, ((1 + np.log10(np.maximum(p, 1e-8)) / 8) * BINS).astype(int)))
    return (kind * len(BANDS) + band) * BINS + bins


@lru_cache(maxsize=None)
def fixed_reference(kind: int, band: int) -> dict[int, int]:
    """Cells of the strings made of the common words, drawn with a fixed seed."""
    rnd, n, out = np.random.default_rng(band), BANDS[band], np.zeros(0, int)
    for _ in range(FIXED // 1000):
        stream = b"".join(COMMON[k] for k in rnd.integers(0, len(COMMON), 1000 * n))
        out = np.append(out, reference_cells(_rows(stream, n, 1000), band, kind))
    return {int(c): int(m) for c, m in zip(*np.unique(out, return_counts=True))}


def _rows(letters: bytes, n: int, most: int) -> np.ndarray:
    k = min(most, len(letters) // n)
    return np.frombuffer(letters, np.uint8, k * n).reshape(k, n).astype(np.int64) - ord("a")


def is_word(token: bytes) -> bool:
    return token.isalpha() and (token[1:].islower() or token.isupper())


def joined_letters(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """Letters of the text without its long runs, in lower case."""
    ends = [0, *(e for _, e in runs)]
    return b"".join(raw[b:e] for b, e in zip(ends, [*(b for b, _ in runs), len(raw)])).translate(_AS_LOWER, _NOT_LETTERS)


def reference_strings(letters: bytes, first: int) -> list[np.ndarray]:
    """The letters cut from end to end into strings as long as each band's
    least length, band after band from ``first`` on; rows of letters per band."""
    x = np.frombuffer(letters, np.uint8).astype(np.int64) - ord("a")
    turn = sum(BANDS)
    whole, rest = x[:len(x) // turn * turn].reshape(-1, turn), x[len(x) // turn * turn:]
    out: list[np.ndarray] = [whole[:, :0]] * len(BANDS)
    at = 0
    for k in range(len(BANDS)):
        band = (first + k) % len(BANDS)
        n = BANDS[band]
        last = rest[at:at + n]
        out[band] = np.concatenate([whole[:, at:at + n], last[None]]) if len(last) == n else whole[:, at:at + n]
        at += n
    return out


def _reference(texts: list[bytes]) -> list[dict[str, int]]:
    """Cell counts of the reference strings of some documents."""
    out = np.zeros(len(SIZES) * len(BANDS) * BINS, np.int64)
    # which band a text begins with depends on the text, so that short texts feed all of them
    cut = [reference_strings(t, crc32(t) % len(BANDS)) for t in texts]
    for band in range(len(BANDS)):
        letters = np.concatenate([c[band] for c in cut])
        for kind in range(len(SIZES)) if len(letters) else ():
            out += np.bincount(reference_cells(letters, band, kind), minlength=len(out))
    return [{"c": int(c), "n": int(out[c])} for c in np.flatnonzero(out)]


def free_runs(runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The runs that no span overlaps, in one sweep; both are sorted by begin."""
    out, k, reach = [], 0, -1
    for b, e in runs:
        while k < len(spans) and spans[k][0] < e:
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= b:
            out.append((b, e))
    return out


def code_points(codes: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in bytes as spans in code points."""
    if not spans:
        return spans
    before = np.concatenate([[0], np.cumsum((codes & 0xC0) != 0x80)])  # characters that begin before a byte
    return [(int(before[x]), k, int(before[y])) for x, k, y in spans]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("begin", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    tally = pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            base, found, cells, texts = [], [], [], []
            for raw in part.column("__raw").to_pylist():
                raw = raw or b""
                codes = np.frombuffer(raw, np.uint8)
                spans = base_spans(raw, codes)
                more, where = [], []
                runs = long_runs(_TOKEN[codes], MIN_TOKEN)
                for b, e in free_runs(runs, spans):
                    more.append((b, 3, e))
                    where.append(cell(raw[b:e]))
                texts.append(joined_letters(raw, runs))
                if not raw.isascii():
                    spans, more = code_points(codes, spans), code_points(codes, more)
                as_rows = lambda s: [{"begin": x, "kind": k, "end": y} for x, k, y in s]
                base.append(as_rows(spans)), found.append(as_rows(more)), cells.append(where)
            words = [_reference(texts), *[[]] * (part.num_rows - 1)]  # counts of the whole part, in its first row
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(base, span), pa.array(found, span),
                 pa.array(cells, pa.list_(pa.int32())), pa.array(words, tally)],
                ["doc_id", "base", "more", "cells", "words"])


def discoveries(words: dict[int, int], runs: dict[int, int], rate: float = FALSE_DISCOVERY) -> set[int]:
    """Cells whose runs are reported: Benjamini-Hochberg with p-values from the reference."""
    p: dict[int, float] = {}
    for group in {c // BINS for c in runs}:
        ref = {c: n for c, n in words.items() if c // BINS == group}
        for c, n in fixed_reference(*divmod(group, len(BANDS))).items():
            ref[c] = ref.get(c, 0) + n
        for c in runs:
            if c // BINS == group:
                p[c] = (sum(n for k, n in ref.items() if k >= c) + 1) / (sum(ref.values()) + 1)
    all_runs, seen, last = sum(runs.values()), 0, -1.0
    for value in sorted(set(p.values())):
        seen += sum(runs[c] for c in p if p[c] == value)
        if value <= rate * seen / all_runs:
            last = value
    return {c for c, v in p.items() if v <= last}


def scan_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<begin:bigint,kind:int,end:bigint>>"
    found = materialise(docs.select("doc_id", F.col("text").cast("binary").alias("__raw")).mapInArrow(
        _scan, f"doc_id {kind}, base {span}, more {span}, cells array<int>, words array<struct<c:int,n:bigint>>"), "secrets")
    count = lambda x, n: {r["c"]: r["n"] for r in found.select(F.explode(x).alias("x")).groupBy(
        (F.col("x.c") if x == "words" else F.col("x")).alias("c")).agg(n.alias("n")).collect()}  # at most 5 * 10 * BINS rows
    good = discoveries(count("words", F.sum("x.n")), count("cells", F.count(F.lit(1))), rate)
    hit = F.array(*[F.lit(c) for c in sorted(good)]).cast("array<int>")
    more = F.transform(F.filter(F.arrays_zip(F.col("more").alias("s"), F.col("cells").alias("c")),
                                lambda z: F.array_contains(hit, z["c"])), lambda z: z["s"])
    out = found.withColumn("more", more if good else F.filter("more", lambda s: F.lit(False)))
    name = F.array(*[F.lit(k) for k in KINDS])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["begin"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return out.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
                      F.size("more").cast("bigint").alias("n_random"),
                      F.sha2(written(F.array_sort("base")), 256).alias("base_sha256"),
                      written(F.array_sort(F.concat("base", "more"))).alias("spans"))
