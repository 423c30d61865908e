"""Small tables for the training-data operators."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, extra: str = ""):
    """rows: (doc_id, text[, source]); ``extra`` adds columns that clash with internal names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in filter(None, extra.split()):
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def words(n: int, seed: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def edited(text: str, share: float, seed: int) -> str:
    """``text`` with that share of its words replaced."""
    rnd = random.Random(seed)
    parts = text.split(" ")
    for k in rnd.sample(range(len(parts)), int(share * len(parts))):
        parts[k] = f"new{seed}x{k}"
    return " ".join(parts)
