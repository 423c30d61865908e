"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three capacities: tokens, documents and attention cost (the
sum of squared lengths).  Pieces are placed longest first; among the open
sequences that can take a piece under every constraint the one is chosen whose
weighted residual vector after placing is smallest (or, by choice, whose
residual has the largest weighted dot product with the piece).

What a piece asks of a sequence depends on its length alone, and sequences
with the same residuals are alike.  So best-fit is run on classes: the
histogram of lengths (at most ``max_tokens`` rows) against counted kinds of
open sequences.  The outcome is a small table of runs saying which sequence
and offset the r-th piece of a length goes to; each piece finds its run by its
rank among equal lengths (``rank_in``).  Texts and token ids are never
shuffled, and the work on the driver depends on the number of lengths, not on
the number of documents.

Ids are those of the tokenizer file as it is: the string of a special token in
a text gets that token's id.

Defined results: null text is empty (one piece holding id 0); only documents
longer than ``max_tokens`` are cut; repeated rows are packed each; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import join_on, materialise, rank_in

MAX_TOKENS = 2048
END_ID = 0
CACHE_WORDS = 500_000
MARKS = ".,;:!?"
TAIL = MARKS + "#$%&*<>|"  # symbols that follow a word of letters alone
#: Words of lower-case letters that stay as they are when composed (NFC) and lower-cased.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Latin letters, and the symbols behind them.
LATIN = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(TAIL)}]*)").fullmatch
BATCH_WORDS = 512
SLICE_BYTES = 2 << 20  # text whose words are looked up together


class Words:
    """A tokenizer and the ids of the words seen lately, in two generations."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab()
        self.ends_unit = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_unit[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # plain words are lower-case and composed already, and one unit each
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, word: str) -> bytes:
        return self.recent[word] if word in self.recent else self.older[word]

    def learn(self, words: set[str]) -> None:
        """Puts ``words`` among the recent ones."""
        if len(self.recent) > CACHE_WORDS:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        words = words.difference(recent)
        known = words.intersection(older)
        recent.update(zip(known, map(older.__getitem__, known)))
        words.difference_update(known)
        parts: list[tuple[str, str, str]] = []
        plain: set[str] = set(filter(PLAIN, words))
        others: set[str] = set()
        for w in words.difference(plain):
            if m := LATIN(w):
                core, marks = m.groups()
                core = core.lower()
                new = plain
            else:
                core, marks = _parted(w)
                new = others
            if core not in recent and core not in older:
                new.add(core)
            if marks and marks not in recent and marks not in older:
                others.add(marks)
            if marks or core != w:
                parts.append((w, core, marks))
        letters = [w for w in others if w.isalpha()]
        for some, encoded in ((list(plain), _encode_plain), (letters, _encode_words), (list(others.difference(letters)), _encode_words)):
            recent.update(zip(some, encoded(self, some)))
        for w, core, marks in parts:
            recent[w] = self.ids(core) + self.ids(marks) if marks else self.ids(core)


def _parted(w: str) -> tuple[str, str]:
    """A word's letters and the marks behind them, or the whole word."""
    if w.isalpha():
        core, marks = w, ""
    else:
        core = w.rstrip(TAIL)
        if not core.isalpha():  # a symbol inside a word may belong to a special token or a contraction
            core = w.rstrip(MARKS)
        marks = w[len(core):]
    if core and core.lower()[-1].isalpha():  # a capital with a dot ends in a combining mark
        return (core.lower() if core.isascii() else core), marks
    return w, ""


_tokenizers: dict[str, Words] = {}


def _tokenizer(path: str) -> Words:
    """Kept by the worker process between tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    return _tokenizers[path]


def _split(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = ids.tobytes()
    cut = (4 * ends).tolist()
    return [raw[b:e] for b, e in zip([0, *cut[:-1]], cut)]


def _encode_plain(words_of: Words, words: list[str]) -> list[bytes]:
    """Ids of words of lower-case Latin letters; many go through the tokenizer as one text."""
    out: list[bytes] = []
    for at in range(0, len(words), BATCH_WORDS):
        some = words[at:at + BATCH_WORDS]
        ids = np.array(words_of.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(words_of.ends_unit[ids]) + 1
        out += _split(ids, ends) if len(ends) == len(some) else _encode_words(words_of, some)
    return out


def _encode_words(words_of: Words, words: list[str]) -> list[bytes]:
    """Ids of each word.  Many words go through the tokenizer as one text.

    A word of letters is one unit to the tokenizer, whose last token says that
    it ends a unit; other words are told apart by the tokens' places.
    """
    out: list[bytes] = []
    for at in range(0, len(words), BATCH_WORDS):
        some = words[at:at + BATCH_WORDS]
        ends = None
        if all(map(str.isalpha, some)):
            ids = np.array(words_of.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(words_of.ends_unit[ids]) + 1
        if ends is None or len(ends) != len(some):
            e = words_of.tok.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            begins = np.cumsum([0, *(len(w) + 1 for w in some)])
            ends = np.searchsorted(np.array([b for b, _ in e.offsets], np.int64), begins[1:], "left")
        out += _split(ids, ends)
    return out


def encode(texts: list[str] | pa.Array, path: str) -> list[np.ndarray]:
    """Token ids of each text, followed by ``END_ID``.

    The tokenizer drops white space and never joins across it, lower-cases,
    and parts letters from marks.  So a text's ids are those of its words, and
    a word's those of its letters and of the marks behind them; what was seen
    lately is not encoded again.
    """
    words_of = _tokenizer(path)
    text = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    split = pc.split_pattern(pc.replace_substring(text, "\n", " "), " ")
    coded = split.flatten().dictionary_encode()
    words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    words_of.learn(set(words))
    known = list(map(words_of.recent.__getitem__, words))
    flat = np.frombuffer(b"".join(known), dtype="<u4")
    size = np.fromiter(map(len, known), np.int64, len(known)) // 4
    first, length = (np.cumsum(size) - size)[which], size[which]
    ends = np.cumsum(length)
    ids = flat[np.arange(length.sum()) + np.repeat(first - ends + length, length)]
    until = np.append(0, ends)[np.cumsum(pc.list_value_length(split).to_numpy())]
    return np.split(np.insert(ids, until, END_ID), (until + np.arange(1, len(until) + 1))[:-1])


def _pieces(path: str, max_tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("text").fill_null("")).to_numpy(), dtype=np.int64)
            begins = np.flatnonzero(np.diff(size // SLICE_BYTES, prepend=-1)).tolist()
            for at, end in zip(begins, [*begins[1:], batch.num_rows]):
                part = batch.slice(at, end - at)
                which, piece, start, length, crc, all_ids = [], [], [], [], [], []
                for k, ids in enumerate(encode(part.column("text").fill_null(""), path)):
                    for p, s in enumerate(range(0, len(ids), max_tokens)):
                        x = ids[s:s + max_tokens]
                        which.append(k), piece.append(p), start.append(s), length.append(len(x))
                        crc.append(zlib.crc32(x.tobytes()))
                        if with_ids:
                            all_ids.append(x.astype(np.int32))
                cols = [part.column("doc_id").take(pa.array(which, pa.int64()))]
                cols += [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


@dataclass
class Kind:
    """Open sequences alike: how many, their residuals, what they hold."""
    count: int
    left: np.ndarray
    holds: tuple = ()  # (length, times) in order of placing


@dataclass
class Plan:
    #: (length, first rank, pieces, first sequence, pieces a sequence, offset)
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def plan_packing(lengths: dict[int, int], max_tokens: int, max_docs: int, max_attention: int,
                 weights: tuple[float, float, float], rule: str) -> Plan:
    """Vector best-fit decreasing over the length histogram."""
    caps = np.array([max_tokens, max_docs, max_attention], float)
    w = np.array(weights, float) / caps ** 2
    kinds: dict[tuple, Kind] = {}  # by what they hold
    residuals, keys = np.zeros((0, 3)), []

    def add(count: int, left: np.ndarray, holds: tuple) -> None:
        nonlocal residuals
        if holds in kinds:
            kinds[holds].count += count
            return
        kinds[holds] = Kind(count, left, holds)
        keys.append(holds)
        residuals = np.vstack([residuals, left])

    def drop(i: int) -> None:
        nonlocal residuals
        del kinds[keys[i]]
        keys.pop(i)
        residuals = np.delete(residuals, i, axis=0)

    closed: list[Kind] = []
    for length in sorted(lengths, reverse=True):
        item, n = np.array([length, 1, length * length], float), lengths[length]
        while n:
            fits = np.flatnonzero((residuals >= item).all(axis=1)) if len(keys) else np.array([], int)
            if not len(fits):
                times = int((caps // item).min())  # alike pieces join the sequence they opened
                whole, rest = divmod(n, max(1, times))
                for count, t in ((whole, max(1, times)), (1 if rest else 0, rest)):
                    if count:
                        add(count, caps - t * item, ((length, t),))
                break
            after = residuals[fits] - item
            score = -(residuals[fits] * item * w).sum(axis=1) if rule == "dot" else (after * after * w).sum(axis=1)
            i = int(fits[score.argmin()])
            kind = kinds[keys[i]]
            times = int((kind.left // item).min())
            whole, rest = divmod(n, times)
            if whole >= kind.count:
                used, t, n = kind.count, times, n - kind.count * times
            elif whole:
                used, t, n = whole, times, n - whole * times
            else:
                used, t, n = 1, rest, 0
            left, holds = kind.left - t * item, (*kind.holds, (length, t))
            kind.count -= used
            if not kind.count:
                drop(i)
            if left[0] < 1 or left[1] < 1 or left[2] < 1:
                closed.append(Kind(used, left, holds))
            else:
                add(used, left, holds)
    plan, rank = Plan(), dict.fromkeys(lengths, 0)
    for kind in [*closed, *kinds.values()]:
        offset = 0
        for length, times in kind.holds:
            plan.runs.append((length, rank[length], kind.count * times, plan.sequences, times, offset))
            rank[length] += kind.count * times
            offset += length * times
        plan.sequences += kind.count
    return plan


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, max_docs: int | None = None,
                   max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
                   rule: str = "norm", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    The document and attention capacities default to what ``max_tokens`` alone
    allows, so they bind only when given."""
    spark: SparkSession = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    pieces = materialise(docs.select("doc_id", F.col("text").cast("string").alias("text"))
                             .mapInArrow(_pieces(tokenizer, max_tokens, with_ids), schema), "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= max_tokens rows
    plan = plan_packing(lengths, max_tokens, max_docs or max_tokens, max_attention or max_tokens ** 2, weights, rule)
    runs = spark.createDataFrame(plan.runs, "length long, first long, n long, base long, times long, at long")
    ranked = rank_in(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "packed")
    # a length has as many runs as kinds of sequences hold it; every rank is in one of them
    steps = runs.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "n", "base", "times", "at"))).alias("runs"))
    run = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["n"]))[0]
    placed = join_on(ranked, steps, ["length"]).withColumn("run", run)
    nth = F.col("rank") - F.col("run.first")
    return placed.select(*pieces.columns, (F.col("run.base") + F.floor(nth / F.col("run.times"))).cast("bigint").alias("sequence_id"),
                         (F.col("run.at") + nth % F.col("run.times") * F.col("length")).cast("bigint").alias("offset"))
