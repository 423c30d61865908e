"""Chat formatting, quality classifier, nearest neighbours, entry points, pipeline."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.llm import quality_classifier as qc
from retentio.llm.ann import TopTree, build_index, nearest, search, usable
from retentio.llm.chat_format import (EVENTS, control_conversation, escape, fold_events, format_conversations, read_back, unescape)
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs, words

TURNS = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["", "\\", "\\\\", "<|end|>", "<\\|end|>", "<\\\\|x", "</s>[INST] ok [/INST]", "[\\INST]", "<<SYS>>", "<s><|turn|>", "[", "<", "é\n<|text|>\\"]


def test_escape_is_reversible_and_hides_control(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescape(F.col("e")).alias("back")).collect():
        assert r.back == r.t
        assert not any(c in r.e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_formatting_round_trip(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(NASTY)]
    rows += [(2, 0, None, None), (2, None, "user", "first"), (2, 0, "assistant", "tie b"), (2, 0, "assistant", "tie a"), (None, 1, "<|x", "y")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash")).select("conv_id", "turn", "role", "text")
    out = {r.conv_id: r for r in read_back(format_conversations(turns.union(control_conversation(spark)))).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    says = "</s>[INST] ok [/INST]"
    for conv in (1, 2, None, -7):
        own = sorted((r for r in rows if r[0] == conv), key=order) if conv != -7 else [(-7, 0, "user", says), (-7, 1, "assistant", says)]
        told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        got = out[conv]
        assert (got.n_turns, got.loss_chars) == (len(own), len(loss))
        assert got.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_fold(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", None), (1, 3, "delta", 2, None, "he"), (1, 4, "delta", 2, None, "llo"),
        (1, 5, "message", 3, "user", "old question"), (1, 6, "message", 4, "assistant", "old answer"),
        (1, 7, "regenerate", 2, None, None), (1, 8, "delta", 2, None, "new "), (1, 9, "delta", 2, None, "hello"),
        (1, 10, "message", 3, "user", "second"), (1, 11, "edit", 3, None, "second, edited"), (1, 12, "message", 4, "assistant", "end"),
        (2, 1, "message", 1, "user", "a"), (2, 2, "edit", 1, None, "b"),
    ]
    got = {(r.conv_id, r.msg): (r.role, r.text) for r in fold_events(spark.createDataFrame(log, EVENTS)).collect()}
    assert got[(1, 1)] == ("user", "hi") and got[(1, 2)][1] == "new hello" and got[(1, 3)][1] == "second, edited"
    assert got[(1, 4)] == ("assistant", "end") and got[(2, 1)][1] == "b"


def test_chat_empty(spark):
    assert read_back(format_conversations(spark.createDataFrame([], TURNS))).collect() == []


def _quality_tables(spark, n=1500):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.3
        text = words(60, k)
        rows.append((k, " ".join(w + "&&&" for w in text.split()) if bad else text))
        if rng.random() < 0.5:
            labels.append((k, 0 if bad else 1))
    return docs(spark, rows, "score quality"), spark.createDataFrame(labels, "doc_id bigint, quality int"), dict(labels)


def test_classifier_held_out(spark):
    d, labels, known = _quality_tables(spark)
    got = qc.score_quality(d, labels).collect()
    assert len(got) == 1500
    test = [(r.predicted, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert sum(p == y for p, y in test) / len(test) > 0.95
    assert 0.55 < qc.fit(d, labels)["prior"] < 0.85  # true share of positives: 0.7
    again = {r.doc_id: r.score for r in qc.score_quality(d.repartition(5), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)


def test_classifier_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    odd = docs(spark, [(1, None), (2, ""), (None, "x"), (3, "y"), (3, "y"), (4, "long " * 50_000)])
    assert {r.score for r in qc.score_quality(odd, none).collect()} == {0.5}
    assert qc.score_quality(odd.limit(0), none).collect() == []
    d, labels, _ = _quality_tables(spark, 300)
    both = qc.score_quality(d.select("doc_id", "text").union(odd.select("doc_id", "text")), labels).collect()
    assert len(both) == 306 and all(0 <= r.score <= 1 for r in both)


def _brute(vectors, every, k):
    out = {}
    for i, q in vectors:
        if i % every:
            continue
        q = np.array(q, np.float64)
        score = sorted((-float((np.array(x, np.float64) * q).sum() / (np.sqrt((np.array(x, np.float64) ** 2).sum()) * np.sqrt((q * q).sum()))), j)
                       for j, x in vectors if j != i)
        out[i] = score[:k]
    return out


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 32))
    v = [(k, (centres[k % 20] + 0.6 * rng.standard_normal(32)).astype(np.float32).tolist()) for k in range(3000)]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<float>").withColumn("block", F.lit(1))
    want = _brute(v, 50, 5)
    got = {}
    for r in nearest(df, 50, 5, block=700, chunk=25).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({j for _, j in want[q]} & {j for _, j, _ in got[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    for q, rows in got.items():
        assert [r for r, *_ in sorted(rows)] == [1, 2, 3, 4, 5]
        exact = {j: -s for s, j in _brute([x for x in v if x[0] == q or x[0] in {j for _, j, _ in rows}], 50, 5)[q]}
        assert all(abs(exact[j] - s) < 1e-12 for _, j, s in rows)


def test_neighbours_ties_and_unusable(spark):
    same = [1.0, 2.0, 0.5]
    rows = [(k, same) for k in range(100, 400)] + [(0, same), (50, [1.0, 0.0, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [float("nan"), 1.0, 1.0]),
            (4, [None, 1.0, 1.0]), (5, []), (7, [1.0, 2.0]), (None, same), (0, same), (6, [float("inf"), 0.0, 1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), 50, 5).collect()
    of = lambda q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
    assert of(0) == [100, 101, 102, 103, 104] and of(100) == [0, 101, 102, 103, 104] and of(50) == [0, 100, 101, 102, 103]
    few = nearest(spark.createDataFrame([(0, same), (1, same), (2, [3.0, 1.0, 0.0])], "vec_id bigint, embedding array<float>"), 50, 5).collect()
    assert len(few) == 2
    assert nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


def _recall(got, want):
    return sum(len({j for _, j in want[q]} & {r.vec_id for r in got if r.query_id == q}) for q in want) / sum(map(len, want.values()))


def test_queries_skip_far_cells_and_lose_little(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 24))
    v = [(k, (centres[k % 40] + 0.15 * rng.standard_normal(24)).tolist()) for k in range(4000)]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<double>")
    vectors = usable(df).select("v", F.array("vec_id").alias("ids"))
    index = build_index(vectors, cell=60, sample=1500)
    cells = index.cells.count()
    assert cells == index.most == 128 and index.vectors.count() == 4000
    top, met = search(index, usable(df).filter("vec_id % 50 = 0"), 5, chunk=7)
    got = top.collect()
    assert _recall(got, _brute(v, 50, 5)) >= 0.95
    assert met < 0.5 * 80 * cells
    unit = {k: np.array(x) / np.linalg.norm(x) for k, x in v}
    assert all(r.score == pytest.approx(unit[r.query_id] @ unit[r.vec_id], abs=1e-12) for r in got)


def test_large_cells_are_split_into_blocks(spark):
    rng = np.random.default_rng(12)
    v = [(k, (np.ones(8) + 1e-7 * rng.standard_normal(8) if k % 3 else rng.standard_normal(8)).tolist()) for k in range(1200)]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<double>")
    index = build_index(usable(df).select("v", F.array("vec_id").alias("ids")), cell=50, block=20, sample=64)
    assert index.cells.agg(F.max("blocks")).first()[0] > 1
    want, got = _brute(v, 50, 5), nearest(df, 50, 5, cell=50, block=20, sample=64).collect()
    assert sum(abs(-s - r.score) < 1e-9 for q in want
               for (s, _), r in zip(want[q], sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"]))) >= 0.95 * 5 * len(want)


def test_top_tree_deals_every_point_once():
    rng = np.random.default_rng(13)
    low = np.repeat(rng.standard_normal((50, 8)), 3, axis=0)
    for depth in (0, 1, 5):
        cells = TopTree(low, depth).cells(low)
        assert cells.min() >= 0 and cells.max() < 2 ** depth and (cells.reshape(50, 3) == cells[::3, None]).all()
    assert np.bincount(TopTree(low, 2).cells(low), minlength=4).min() >= 30
    assert TopTree(low[:1], 3).cells(low).max() < 8


def test_entry_has_all_queries():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, empty):
    import corpus_pipeline as cp
    from retentio.llm.common import materialise
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "near dedup", "source mixing", "packing"]
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    d = d.limit(0) if empty else d
    sizes = [d.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = materialise(stage(spark, d, SF_SMALL), "t")
        if k < 4:
            assert out.columns == d.columns
            assert out.join(d, "doc_id", "left_anti").isEmpty()
        sizes.append(out.count())
        d = out
    assert (sizes == [0] * 6) if empty else (sizes[1] <= sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2])
