"""Sharding, mixing, packing and the shared rank."""

from __future__ import annotations

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from retentio.llm import packing as pk
from retentio.llm.common import rank_in
from retentio.llm.mixing import mix, mixed_documents
from retentio.llm.packing import pack_documents, plan_packing
from retentio.llm.sharding import _histogram, group_key, minimax_cuts, shard_documents
from tests.llm.helpers import docs, words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ROWS = [(k, words(1 + k % 50, k % 90), "abc"[k % 3]) for k in range(200)] + [
    (500, None, None), (501, None, "a"), (None, "", None), (502, "", "b"), (7, words(5, 1), "a"), (7, words(5, 1), "a"), (503, words(4000, 3), "c")]


def _minimax(sizes, n):
    def fill(cap):
        shards, left, cuts = 1, cap, []
        for k, s in enumerate(sizes):
            if s > left:
                shards, left = shards + 1, cap
                cuts.append(k)
            left -= s
        return shards, cuts

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fill(mid)[0] <= n else (mid + 1, hi)
    return lo, fill(lo)[1]


@pytest.mark.parametrize("fan", [8192, 64, 8])
@pytest.mark.parametrize("n", [1, 7, 40])
def test_capacity_and_cuts_are_the_sequential_ones(spark, fan, n):
    rng = np.random.default_rng(fan + n)
    keys = np.sort(rng.choice(2 ** 60, 600, replace=False))
    sizes = np.where(rng.random(600) < 0.03, 900, rng.integers(16, 90, 600))
    groups = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes)], "key long, size long").cache()
    cap, cuts = _minimax(sizes.tolist(), n)
    assert minimax_cuts(groups, n, fan) == (cap, [int(keys[k]) for k in cuts])


def test_clustered_keys_are_refined(spark):
    groups = spark.createDataFrame([(k, 10) for k in range(500)], "key long, size long").cache()
    assert minimax_cuts(groups, 5, 16) == (1000, [100, 200, 300, 400])
    assert len(_histogram(groups, [(-1, 2 ** 60 - 1)], 16)[0]) == 1


def test_shards(spark):
    got = shard_documents(docs(spark, ROWS, "key shard size"), 12).collect()
    assert len(got) == len(ROWS)
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 12
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({(r.key, r.shard) for r in got}) == len({r.key for r in got})
    order = sorted((r.key, r.shard) for r in got)
    assert [s for _, s in order] == sorted(s for _, s in order)
    assert docs(spark, ROWS).select(group_key("text").alias("k")).distinct().count() == len({t for _, t, _ in ROWS})


def test_empty_tables(spark):
    empty = docs(spark, [(1, "x")]).limit(0)
    assert shard_documents(empty).collect() == [] and mix(empty).collect() == [] and mixed_documents(empty).collect() == []
    assert pack_documents(empty, TOKENIZER).collect() == []


def test_rank_is_gapless_in_hot_groups(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("case when id % 3 = 0 then null else id % 4 end k", "id % 100 o", "id")
    got = collections.defaultdict(list)
    for r in rank_in(df, ["k"], ["o"], "t").collect():
        got[r.k].append((r.rank, r.o))
    for rows in got.values():
        rows.sort()
        assert [x for x, _ in rows] == list(range(len(rows))) and [o for _, o in rows] == sorted(o for _, o in rows)


def _targets(sizes: dict, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        room = total - sum(2 * sizes[s] for s in capped)
        target = {s: room * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2.0 * sizes[s] for s in capped}, **target}
        capped |= over


@pytest.mark.parametrize("rows", [ROWS, [(k, words(1 + k % 9, k), f"s{k % 7}") for k in range(60)], [(1, "a b", "x"), (2, None, "y")]])
def test_mix_meets_targets(spark, rows):
    got = mix(docs(spark, rows, "copies rate k")).collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((i, len((t or "").split())) for i, t, _ in rows)
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    target = _targets(dict(sizes))
    for r in got:
        s = source[(r.doc_id, r["size"])]
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        taken[s] += r.taken
        largest[s] = min(x for x in (largest[s] or 10 ** 9, r["size"] or 10 ** 9))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 60
    again = mix(docs(spark, rows[::-1], "copies rate k")).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rates_are_exponential_tilts(spark):
    rows = [(k, words(1 + k % 40, k), "ab"[k % 2]) for k in range(400)]
    tilt = collections.defaultdict(set)
    for r in mix(docs(spark, rows)).collect():
        if r.rate < 2 and r["size"]:
            tilt[r.source_size].add(round(float(np.log(r.rate) / r["size"]), 9))
    assert all(len(x) == 1 for x in tilt.values())


def test_mixed_documents_repeat_rows(spark):
    want = {(r.doc_id, r["size"]): r.copies for r in mix(docs(spark, ROWS[:200])).collect()}
    out = mixed_documents(docs(spark, ROWS[:200], "copies __k"))
    assert out.columns == docs(spark, ROWS, "copies __k").columns
    got = collections.Counter((r.doc_id, len((r.text or "").split())) for r in out.collect())
    assert got == collections.Counter({k: v for k, v in want.items() if v})


def test_a_document_in_a_third_of_the_rows_is_mixed_row_by_row(spark):
    hot = [(7, words(20, 1), "a")] * 300
    rest = [(100 + k, words(5 + k % 40, k), "ab"[k % 2]) for k in range(600)]
    table = docs(spark, hot + rest).withColumn("mark", F.monotonically_increasing_id())
    copies = collections.Counter((r.doc_id, r.copies) for r in mix(table).collect())
    got = collections.Counter(r.mark for r in mixed_documents(table).collect())
    ids = {r.mark: r.doc_id for r in table.collect()}
    assert collections.Counter((ids[m], got[m]) for m in ids) == copies


def test_tokens_are_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOKENIZER)
    texts = ["", " ", "Hello, world... it's 3.14!? ok", "a\tb\x1cc d e", "ÀÉ ß Σας ΣΑΣ. İstanbul, ﬁx", "<|endoftext|> <|startoftext|>x",
             "é ́a x́.", "日本語。テスト、 12345 a1b2", "don't!!! (foo) \"bar\".", "\n\n. .. ,a, b.;", words(500, 1), "x" * 3000,
             "x<|endoftext|>. <|endoftext|>|$ a<| b|> <|startoftext|><|endoftext|>\nfoo$$$<|endoftext|> <|ENDOFTEXT|> c.*** it's&&& Ö### 7%%%"]
    for cap in (300_000, 3):
        monkeypatch.setattr(pk, "CACHE_WORDS", cap)
        pk._tokenizers.clear()
        for some in (texts, texts[::-1], texts):
            for t, ids in zip(some, pk.encode(some, TOKENIZER)):
                assert ids.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0]


def test_packing_round_trip(spark):
    rows = [*ROWS, *[(1000 + k, words(200 + 37 * k, k), "a") for k in range(30)]]
    got = pack_documents(docs(spark, rows, "length rank ids"), TOKENIZER, with_ids=True).collect()
    seqs, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length <= 2048 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    for i, t, _ in rows:
        if i != 7:
            parts = sorted(pieces[i], key=lambda r: r.piece)
            assert sum((r.ids for r in parts), []) == pk.encode([t or ""], TOKENIZER)[0].tolist()
            assert [r.start for r in parts] == [2048 * k for k in range(len(parts))]
    assert len(pieces[7]) == 3
    assert len(seqs) <= -(-sum(r.length for r in got) // 2048) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, 100, 10_000), (100, 4, 10_000), (100, 100, 2_500)])
def test_plan_respects_every_capacity(rule, caps):
    rng = np.random.default_rng(1)
    lengths = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 50, 3000), return_counts=True))}
    plan = plan_packing(lengths, *caps, (1.0, 0.1, 0.1), rule)
    held = collections.defaultdict(list)
    placed = collections.Counter()
    for length, first, n, base, times, at in plan.runs:
        assert first == placed[length]
        placed[length] += n
        for r in range(n):
            held[base + r // times].append((at + r % times * length, length))
    assert placed == lengths and len(held) == plan.sequences
    for s in held.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        assert sum(n for _, n in s) <= caps[0] and len(s) <= caps[1] and sum(n * n for _, n in s) <= caps[2]
    total = sum(k * n for k, n in lengths.items())
    if caps == (100, 100, 10_000):
        assert plan.sequences <= -(-total // 100) * 1.01 + 1


def test_one_length_and_nothing():
    assert plan_packing({}, 10, 10, 100, (1, 0, 0), "norm").sequences == 0
    assert plan_packing({4: 5}, 10, 10, 100, (1, 0, 0), "norm").sequences == 3


def test_words_of_latin_letters_have_the_ids_of_the_whole_tokenizer(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOKENIZER)
    letters = [chr(c) for c in range(0x41, 0x100) if chr(c).isalpha()]
    texts = ["", " ", "\n\n", "ª º µ ÿ Ÿ ß ẞ", " ".join(letters), "".join(letters), "a é É É. É$$$ Été,%%% x<|endoftext|> don't É't",
             *(f"{c}a{d}b. {d}{c}|" for c in letters[::7] for d in letters), "ab " * 3000, "Ab cd\x1cé\x85f  g"]
    want = [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    monkeypatch.setattr(pk, "CACHE_WORDS", 300)
    for some in (1, 7, len(texts)):
        pk._tokenizers.clear()
        got = [ids.tolist() for at in range(0, len(texts), some) for ids in pk.encode(texts[at:at + some], TOKENIZER)]
        assert got == want
    plain = pk._tokenizer(TOKENIZER)
    some = sorted(filter(pk.PLAIN, {(c + d + "a" + d).lower() for c in letters for d in letters}))
    assert len(some) > 300 and pk._encode_plain(plain, some) == pk._encode_words(plain, some)
    monkeypatch.setattr(pk, "SLICE_BYTES", 64)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts) + 1)), "text": [*texts, None]})
    out = list(pk._pieces(TOKENIZER, 2048, True)([batch.slice(0, 0), batch]))
    assert len(out) > 50
    ids = collections.defaultdict(list)
    for x in out:
        for r in x.to_pylist():
            assert r["start"] == len(ids[r["doc_id"]])
            ids[r["doc_id"]] += r["ids"]
    assert [ids[k] for k in range(len(texts) + 1)] == [*want, [0]]
