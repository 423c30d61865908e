"""Fill-in-the-middle against a plain rendering."""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retentio.llm import fill_middle as fm
from tests.llm.helpers import docs

SPLIT = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+",
         "word": r"[^\n \t\x0b\x0c\r]*[\n \t\x0b\x0c\r]|[^\n \t\x0b\x0c\r]+", "char": r"(?s:.)"}
TEXTS = ["", "\n", "a", "a\n", "\n\n", "a\nb\nc", "\nx\n\ny", "é\n🙂 z\nß", "one <P> two\nthree", "x<S>", "<M>", "a <P\n> <S", "..! a? b", "word " * 3000,
         "line\n" * 70000, "no end " * 40000]


def _plain(doc_id, text, unit="line", rate=100, spm_rate=50):
    units = re.findall(SPLIT[unit], text)
    hx = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hx[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", fm.UNITS)
@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 10), (0, 50)])
def test_chunk_equals_the_plain_rendering(unit, rate, spm):
    ids = [3 * k - 5 for k in range(len(TEXTS) - 1)] + [None]
    made = fm.transform(ids, TEXTS, unit, rate=rate, spm_rate=spm)
    for k, (i, text) in enumerate(zip(ids, TEXTS)):
        want = _plain(i, text, unit, rate, spm)
        assert tuple(made[c][k] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == want
        assert made["restored_sha256"][k] == sha256(text.encode()).hexdigest()
        assert fm.restore(made["output"][k], made["form"][k]) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\n .<PSM>é🙂", max_size=90), max_size=12), st.sampled_from(sorted(fm.UNITS)))
def test_any_texts(texts, unit):
    made = fm.transform(list(range(len(texts))), texts, unit)
    for k, text in enumerate(texts):
        assert tuple(made[c][k] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == _plain(k, text, unit)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 128, 1000])
def test_wavelet_matrix_ranks_and_selects(size):
    rng = np.random.default_rng(size)
    seq = rng.integers(0, 4, size).astype(np.uint8)
    wm = fm.WaveletMatrix(seq)
    places = np.arange(size + 1)
    for kind in range(4):
        assert wm.rank(kind, places).tolist() == [int((seq[:p] == kind).sum()) for p in places]
        where = np.flatnonzero(seq == kind)
        assert wm.select(kind, np.arange(len(where))).tolist() == where.tolist()


def test_rows(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "a\nb"), (900, None), (5, "a\nb\nc"), (5, "a\nb\nc")]
    df = docs(spark, rows, "n form output __doc __text")
    got = fm.fill_in_middle(df, keep=["doc_id", "form", "n", "text"]).toPandas()
    assert len(got) == len(rows)
    assert got.columns.tolist()[:4] == ["doc_id", "form", "n", "text"]
    res = {(r.doc_id, r.text): r for r in fm.fill_in_middle(df, keep=["doc_id", "text"]).collect()}
    for i, text in rows:
        r = res[(i, text)]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _plain(i, text or "")
        assert r.restored_sha256 == sha256((text or "").encode()).hexdigest()
        assert r.output_sha256 == sha256(r.output.encode()).hexdigest()


def test_small_chunks_change_nothing(monkeypatch):
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], ["__text"])
    monkeypatch.setattr(fm, "CHUNK_CHARS", 5)
    parts = list(fm._chunks(batch))
    assert [t for _, texts in parts for t in texts] == TEXTS
    assert [first for first, _ in parts] == list(np.cumsum([0] + [len(t) for _, t in parts[:-1]]))


def test_empty_table(spark):
    out = fm.fill_in_middle(docs(spark, []).limit(0))
    assert out.collect() == [] and out.columns[0] == "doc_id"
    with pytest.raises(ValueError):
        fm.fill_in_middle(docs(spark, []), unit="page")
