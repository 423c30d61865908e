"""Every stage of the corpus pipeline against a plain rendering, whole rows compared."""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np

import corpus_pipeline as cp
from retentio.llm import packing as pk
from retentio.llm.common import materialise
from tests.llm.helpers import docs, edited, words
from tests.llm.test_placing import TOKENIZER, _targets

SPACE = " \t\n\x0b\x0c\r"
NOTICE = "subscribe to our weekly letter and share this page with your friends"
LONG_NOTICE = words(250, 77)


def _rows():
    rows = [(k, f"{words(30, k)}\n{words(30 + k % 7, 100 + k)}\t É", "abc"[k % 3]) for k in range(36)]
    rows += [(40, None, "a"), (41, "", "b"), (42, "too short", "c"), (43, " ".join(["again and again"] * 30), "a"), (None, words(64, 900), "b"),
             (44, words(61, 901), None), (45, words(62, 902), None)]
    rows += [(50 + k, f"{words(60, 200 + k)}\n{'  ' if k % 2 else ''}{NOTICE}", "a") for k in range(12)]       # over the host's limit
    rows += [(70 + k, f"{LONG_NOTICE}\n{words(55 + (20 if k else 0) * 3, 300 + k)}", "b") for k in range(12)]     # the first is depleted
    rows += [(90 + k, f"{words(60, 400 + k)}\n  A Line That Three Documents Hold\n{words(5, 500 + k)}", "abc"[k]) for k in range(3)]
    base = words(120, 600)
    rows += [(100, base, "c"), (101, base, "a"), (102, edited(base, 0.01, 1), "b"), (103, edited(base, 0.4, 2), "c")]
    return rows + [rows[5], rows[5], rows[100 - 36 - 30]]


def _quality(rows):
    def line(x):
        return " ".join(x.split()).lower()
    held = collections.defaultdict(set)
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if line(x):
                held[r["source"], line(x)].add((r["doc_id"], r["text"]))
    over = {k for k, found in held.items() if len(found) > 10}
    out = []
    for r in rows:
        w = (r["text"] or "").split()
        at = collections.defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k:k + 3])].append(k)
        repeated = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if (r["source"], line(x)) not in over]
        left = sum(len(x.split()) for x in kept)
        if len(w) >= 50 and 2 * len(repeated) <= len(w) and left >= 0.3 * len(w):
            out.append({**r, "text": "\n".join(kept)})
    return out


def _lines(rows):
    def key(x):
        return "".join(c.lower() if c.isascii() else c for c in x.strip(SPACE))
    number = lambda r: -math.inf if r["doc_id"] is None else r["doc_id"]
    held = collections.defaultdict(set)
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            held[key(x)].add(number(r))
    out = []
    for r in rows:
        kept = [x for x in (r["text"] or "").split("\n")
                if len(key(x)) < 20 or len(held[key(x)]) < 3 or number(r) == max(held[key(x)])]
        out.append({**r, "text": "\n".join(kept), "n_chars": len("\n".join(kept))})
    return out


def _near(rows):
    def bag(text):
        w = text.lower().split()
        return collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    bags = [bag(r["text"]) for r in rows]
    share = collections.Counter(s for b in bags for s in b)
    weigh = lambda b: sum(n * math.log(1 + 1 / max(share[s] / len(rows), 0.05)) for s, n in b.items())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a]["text"] == rows[b]["text"] or weigh(bags[a] & bags[b]) >= 0.8 * weigh(bags[a] | bags[b]):
                root = [root[b] if x == root[a] else x for x in root]
    first = {}
    for k, r in enumerate(rows):
        old = first.get(root[k])
        if old is None or (r["doc_id"] is None, -(r["doc_id"] or 0)) > (old["doc_id"] is None, -(old["doc_id"] or 0)):
            first[root[k]] = r
    return list(first.values())


def _count(rows):
    return collections.Counter(tuple(r.items()) for r in rows)


def test_stages_equal_a_plain_rendering(spark):
    df = docs(spark, _rows(), "copies __row __host tid over h")
    stages = dict(cp.STAGES)
    rows = [r.asDict() for r in df.collect()]
    for name, plain, goes in (("quality rules", _quality, 4), ("line dedup", _lines, 0), ("near dedup", _near, 3)):
        df = materialise(stages[name](spark, df, ""), "stage")
        want, got = plain(rows), [r.asDict() for r in df.collect()]
        assert _count(got) == _count(want), name
        assert len(rows) - len(want) >= goes
        if not goes:
            assert _count(want) != _count(rows)
        rows = want

    words_of = lambda r: len([w for w in r["text"].split() if w])
    mixed = materialise(stages["source mixing"](spark, df, ""), "stage")
    taken = _count(r.asDict() for r in mixed.collect())
    given = _count(rows)
    assert set(taken) <= set(given) and all(n <= 2 * given[k] for k, n in taken.items())
    sizes, got = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r["source"]] += words_of(r)
    for k, n in taken.items():
        got[dict(k)["source"]] += n * words_of(dict(k))
    target = _targets(dict(sizes))
    assert all(abs(got[s] - target[s]) <= max(map(words_of, rows)) for s in sizes)

    packed = stages["packing"](spark, mixed, "").collect()
    ids = pk.encode([dict(k)["text"] for k in taken], TOKENIZER)
    want = collections.Counter()
    for (k, n), x in zip(taken.items(), ids):
        for p in range(0, len(x), 2048):
            part = x[p:p + 2048]
            want[dict(k)["doc_id"], p // 2048, p, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    places = collections.defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for s in places.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    assert len(places) <= -(-sum(r.length for r in packed) // 2048) + 1
