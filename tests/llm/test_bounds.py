"""Bounds that must hold whatever the tables hold: samples, whole texts, steps."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retentio.llm import quality_classifier as qc
from retentio.llm import secret_scan as ss
from retentio.llm.mixing import solve_tilts, source_targets
from retentio.llm.packing import encode
from tests.llm.helpers import docs, words


# -- secret scan ------------------------------------------------------------------
@pytest.mark.parametrize("size", [0, 15, 16, 300, 876, 877, 5000])
@pytest.mark.parametrize("first", [0, 3, 9])
def test_reference_strings_use_the_whole_text(size, first):
    rnd = random.Random(size)
    letters = bytes(rnd.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(size))
    cut = ss.reference_strings(letters, first)
    assert [c.shape[1] for c in cut if len(c)] == [n for n, c in zip(ss.BANDS, cut) if len(c)]
    want: list[list[bytes]] = [[] for _ in ss.BANDS]
    at, band = 0, first
    while True:
        n = ss.BANDS[band]
        if at + n > size - size % 876 and at + n > size:
            break
        want[band].append(letters[at:at + n])
        at, band = at + n, (band + 1) % len(ss.BANDS)
    got = [[bytes((r + ord("a")).astype(np.uint8)) for r in c] for c in cut]
    assert [sorted(g) for g in got] == [sorted(w) for w in want]
    assert size - sum(len(x) for g in got for x in g) < max(ss.BANDS)  # less than one string is left over


def test_runs_and_spans_in_one_sweep():
    rnd = random.Random(2)
    for _ in range(300):
        spans = sorted((b, 0, b + rnd.randint(1, 30)) for b in rnd.sample(range(200), rnd.randint(0, 8)))
        runs, at = [], 0
        while at < 200:
            e = at + rnd.randint(1, 20)
            runs.append((at, e))
            at = e + rnd.randint(1, 9)
        assert ss.free_runs(runs, spans) == [(b, e) for b, e in runs if not any(b < y and x < e for x, _, y in spans)]
    raw = "aé🙂b İ".encode()
    spans = [(0, 1, 3), (3, 2, 7), (8, 0, len(raw))]
    assert ss.code_points(np.frombuffer(raw, np.uint8), spans) == [(len(raw[:x].decode()), k, len(raw[:y].decode())) for x, k, y in spans]


def test_a_long_dump_of_runs_is_scanned_in_linear_time():
    import pyarrow as pa
    rnd = random.Random(5)
    lines = [f"é token={rnd.getrandbits(80):020x} {rnd.getrandbits(128):032x} {rnd.choice('XYZ')}{rnd.getrandbits(100):025d}q" for _ in range(55_000)]
    raw = "\n".join(lines).encode()
    assert len(raw) > 5_000_000
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([raw], pa.binary())], ["doc_id", "__raw"])
    start = time.process_time()
    out = list(ss._scan(iter([batch])))
    assert time.process_time() - start < 10 + 10  # the battery itself scores each run
    assert len(out[0].column("base")[0]) >= 55_000


def test_discoveries_equal_a_plain_benjamini_hochberg():
    rnd = random.Random(9)
    for _ in range(30):
        group = rnd.choice([0, 13, 27, 44])
        words_ = {group * ss.BINS + b: rnd.randint(1, 400) for b in rnd.sample(range(50), 20)}
        runs = {group * ss.BINS + b: rnd.randint(1, 5) for b in rnd.sample(range(ss.BINS), 25)}
        ref = [c for c, n in words_.items() for _ in range(n)]
        ref += [c for c, n in ss.fixed_reference(*divmod(group, len(ss.BANDS))).items() for _ in range(n)]
        every = sorted(((sum(r >= c for r in ref) + 1) / (len(ref) + 1), c) for c, n in runs.items() for _ in range(n))
        cut = max((p for k, (p, _) in enumerate(every, 1) if p <= 0.05 * k / len(every)), default=-1.0)
        assert ss.discoveries(words_, runs) == {c for p, c in every if p <= cut}


@pytest.mark.parametrize("n_text", [0, 300])
def test_keys_are_found_beside_little_and_much_text(spark, n_text):
    rnd = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = [(k, words(30, k) + " " + "".join(rnd.choice(alphabet) for _ in range(40)) + " end") for k in range(30)]
    text = [(1000 + k, words(400, k)) for k in range(n_text)]
    got = {r.doc_id: r.n_random for r in ss.scan_secrets(docs(spark, keys + text)).collect()}
    assert sum(got[k] == 1 for k, _ in keys) >= 28
    assert sum(got[k] for k, _ in text) <= 2


# -- quality classifier -----------------------------------------------------------
def test_an_id_in_many_rows_is_one_row_of_the_sample(spark):
    rows = [(7 if k % 3 == 0 else k, words(20, k)) for k in range(3000)]
    df = docs(spark, rows).repartition(6)
    labels = spark.createDataFrame([(7, 1), *[(k, 1) for k in range(100, 400)]], "doc_id long, quality int")
    got = qc.sample_rows(df, labels, 100)
    counts = {r.positive: r.n for r in got.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    assert counts[True] <= 100 and counts[False] == 100
    pos, unl = qc.training_sample(df, labels, 100)
    assert len(pos) == counts[True] and len(unl) == 100


@pytest.mark.parametrize("sample", [1, 10, 500, 5000])
def test_lowest_ids_are_those_of_a_full_sort(spark, sample):
    ids = spark.createDataFrame([(k if k % 2 else 4,) for k in range(4000)], "doc_id long").repartition(4)
    want = [r.doc_id for r in ids.distinct().orderBy(F.xxhash64("doc_id")).limit(sample).collect()]
    assert [r.doc_id for r in qc.lowest_ids(ids, sample).collect()] == want


def _plain_fit(pos, unl, prior):
    """The non-negative risk by its formula, row by row."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    x = [[*r, 1.0] for r in pos], [[*r, 1.0] for r in unl]
    w = np.zeros(len(x[0][0]))
    m = v = np.zeros(len(w))
    for t in range(1, qc.STEPS + 1):
        g_pos = sum(-(1 - sig(np.dot(r, w))) * np.array(r) for r in x[0]) / len(x[0])
        g_neg_p = sum(sig(np.dot(r, w)) * np.array(r) for r in x[0]) / len(x[0])
        g_neg_u = sum(sig(np.dot(r, w)) * np.array(r) for r in x[1]) / len(x[1])
        risk = (sum(-np.log1p(-sig(np.dot(r, w)) + 1e-12) for r in x[1]) / len(x[1])
                - prior * sum(-np.log1p(-sig(np.dot(r, w)) + 1e-12) for r in x[0]) / len(x[0]))
        g = prior * g_pos + (g_neg_u - prior * g_neg_p) if risk >= 0 else -(g_neg_u - prior * g_neg_p)
        g = g + qc.RIDGE * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g ** 2
        w = w - qc.RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


@pytest.mark.parametrize("prior", [0.2, 0.7])
def test_the_fit_minimises_the_non_negative_risk(prior):
    rng = np.random.default_rng(4)
    pos, unl = rng.normal(1, 1, (12, 3)), np.vstack([rng.normal(1, 1, (5, 3)), rng.normal(-1, 1, (15, 3))])
    assert np.allclose(qc._fit(pos, unl, prior), _plain_fit(pos, unl, prior), rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_the_prior_is_near_the_share_of_positives(share):
    rng = np.random.default_rng(int(100 * share))
    pos = rng.normal(2, 1, (4000, 2))
    unl = np.vstack([rng.normal(2, 1, (int(6000 * share), 2)), rng.normal(-2, 1, (6000 - int(6000 * share), 2))])
    got = qc.class_prior(rng.permutation(pos), rng.permutation(unl))
    assert abs(got - share) < 0.08


# -- mixing, packing --------------------------------------------------------------
def test_a_tilt_that_is_not_found_is_an_error(spark):
    sizes = spark.createDataFrame([("a", 10), ("a", 30), ("b", 400), ("b", 7)], "source string, size long")
    hist = sizes.groupBy("source", "size").agg(F.count("*").alias("count"))
    targets = source_targets(sizes)
    assert solve_tilts(hist, targets).count() == 2
    with pytest.raises(RuntimeError, match="no tilt found"):
        solve_tilts(hist, targets, tolerance=0.0, max_steps=1)


def test_words_with_a_dotted_capital():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rnd = random.Random(3)
    texts = ["İ.", "İİ,!", "xİ", "İx."] + ["".join(rnd.choice("aZİıßéΣς.,;!? 19'-") for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    bits = [*"aZİéßς.,;:!?#$%&*<>|'- 7", "<|endoftext|>", "<|startoftext|>", "\u0301", "\t"]
    texts += ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(10_000)]
    for text, got in zip(texts, encode(texts, path)):
        assert got.tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0]
