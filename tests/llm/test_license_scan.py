"""License scan against every block compared with every template."""

from __future__ import annotations

import random
import re

import pytest

from retentio.llm import license_scan as ls
from tests.llm.helpers import docs, words

MIT, GRANT, APACHE, NOTICE, GPL = (t for _, t in ls.TEMPLATES[:5])


def _words(text):
    return re.findall(ls.WORD, (text or "").translate(str.maketrans(ls._UPPER, ls._LOWER)))


def _all_pairs(text, texts=ls.TEMPLATES, threshold=ls.THRESHOLD):
    w, out = _words(text), set()
    for t in ls.templates_of(texts, threshold):
        for b in range(-(-len(w) // t.stride)):
            held = set(w[b * t.stride:(b + 2) * t.stride])
            shared = len(held & set(t.words))
            if shared >= threshold * len(t.words) - 1e-9:
                out.add((t.number, t.label, b * t.stride, min((b + 2) * t.stride, len(w)) - 1, shared / len(t.words)))
    return out


def _base(text):
    w = _words(text)
    return [(i, label) for phrase, label in ls.PHRASES for p in [phrase.split()] for i in range(len(w)) if w[i:i + len(p)] == p]


def _expected(text):
    pairs, base = _all_pairs(text), _base(text)
    at = [i for i, _ in base]
    return (len(_words(text)), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({lab for _, lab in base})),
            ",".join(sorted({lab for _, lab in base} | {p[1] for p in pairs})), 1.0 if at else max((p[4] for p in pairs), default=0.0))


def _texts():
    rnd = random.Random(5)
    common = "the of and is under this license version work public software free licensed a to copy granted permission".split()
    out = ["", None, "...", "MIT", "mit license", "MIT-License! the\nApache  LICENSE, general public license", MIT, GRANT, APACHE, NOTICE, GPL,
           "prose " * 500 + GRANT.replace("free of charge", "without charge") + " more" * 900, GRANT.replace(" ", "\n"), "mit license " * 400,
           "Geändert 2.0 İstanbul É " + MIT, words(30000, 1) + " " + GPL + " " + words(20000, 2)]
    for k in range(150):
        body = [rnd.choice(common) if rnd.random() < 0.7 else f"w{rnd.randint(0, 99)}" for _ in range(rnd.randint(1, 120))]
        at = rnd.randint(0, len(body))
        notice = [w for w in rnd.choice(ls.TEMPLATES)[1].split() if rnd.random() < 0.85]
        out.append(" ".join(body[:at] + (notice if k % 2 else []) + body[at:]))
    return out


def test_documents(spark):
    rows = [(k, t) for k, t in enumerate(_texts())] + [(None, MIT), (3, "MIT"), (3, "MIT"), (6, GPL)]
    got = ls.scan_licenses(docs(spark, rows, "w base blocks found label n_words"), keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    seen = {(r.doc_id, r.text): tuple(r)[2:] for r in got}
    for i, text in rows:
        assert seen[(i, text)] == _expected(text), (i, text)


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_every_block_is_found(spark, threshold):
    texts = _texts()
    got = ls.license_blocks(docs(spark, list(enumerate(texts))), threshold=threshold).collect()
    want = {(k, *p) for k, t in enumerate(texts) for p in _all_pairs(t, threshold=threshold)}
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_a_common_word_of_a_template_builds_no_blocks(spark):
    """A word that most texts hold (as mit in German) is behind the prefix."""
    rows = [(k, "mit der katze " * 30) for k in range(50)] + [(99, MIT)]
    df = docs(spark, rows).select(ls.words_of(ls.F.col("text")).alias("w"))
    templates = ls.templates_of(ls.TEMPLATES[:1])
    order = ls.token_order(df, templates)
    assert order[-1] == "mit"
    assert "mit" not in ls.prefix_tokens(templates, order)[8]
    got = {r.doc_id: r.labels for r in ls.scan_licenses(docs(spark, rows)).collect()}
    assert got[99] == "mit" and got[0] == ""


def test_plan_is_native(spark):
    plan = ls.scan_licenses(docs(spark, [(1, MIT)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan


def test_empty_table_and_bad_parameters(spark):
    assert ls.scan_licenses(docs(spark, []).limit(0)).collect() == []
    for bad in (dict(threshold=0), dict(texts=[("x", "...")]), dict(texts=[("x", " ".join(f"w{k}" for k in range(20_001)))])):
        with pytest.raises(ValueError):
            ls.scan_licenses(docs(spark, []), **bad)
