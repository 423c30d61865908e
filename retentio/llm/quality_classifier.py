"""Quality classifier learned from positive and unlabelled documents.

Trusted positives are the training labels of 1; the unlabelled set is a sample
of all documents of the training folds, whatever their label.  The class prior
is estimated from the two sets alone (best-bin estimation on a first
positive-against-unlabelled model), and a logistic model then minimises the
non-negative unbiased risk: prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]).

Only the fit is on a bounded sample (``sample`` rows per set, chosen by the
hash of the id); features of whole texts and scores are computed for every
document in one pass.  Features are shares and rates of characters, words and
lines; ids, labels, language and source are never among them.

Defined results: null text is empty and gets a score like any other; without
training rows every score is the prior 0.5; repeated rows score alike; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



SAMPLE = 20_000
THRESHOLD = 0.3
FOLDS, HELD_OUT_FOLD = 5, 0
STEPS, RATE, RIDGE = 600, 0.05, 1e-4
_CLASSES = 128  # ASCII characters, by share
N_FEATURES = _CLASSES + 14


def features(raw: bytes) -> np.ndarray:
    """Rates that describe a whole text."""
    out = np.zeros(N_FEATURES, np.float32)
    codes = np.frombuffer(raw, np.uint8)
    n = max(1, len(codes))
    counts = np.bincount(codes, minlength=256)
    out[:_CLASSES] = np.sqrt(counts[:_CLASSES] / n)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w = max(1, len(words))
    often = Counter(words)
    top = max(often.values(), default=0)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    out[_CLASSES:] = (
        np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(often) / w, len(often) / w ** 0.75, top / w, sum(a == b for a, b in zip(words, words[1:])) / w,
        counts[65:91].sum() / max(1, letters), letters / n, counts[48:58].sum() / n,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(w / max(1, len(lines))))
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            x = [features(r or b"") for r in part.column("__raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("positive"), pa.array(x, pa.list_(pa.float32()))], ["positive", "x"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None) -> np.ndarray:
    """Weights (intercept last).  prior None: plain positive against unlabelled;
    else the non-negative unbiased risk.  Full-batch Adam."""
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (pos, unl))
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    for t in range(1, STEPS + 1):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        if prior is None:
            grad = -p.T @ (1 - sp) / len(p) + u.T @ su / len(u)
        else:
            negative = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
            on_negative = u.T @ su / len(u) - prior * p.T @ sp / len(p)
            # below zero the negative part has been fitted too far and is pushed back
            grad = -prior * p.T @ (1 - sp) / len(p) + on_negative if negative >= 0 else -on_negative
        grad = grad + RIDGE * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w = w - RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Best-bin estimate of the share of positives among the unlabelled: the
    smallest ratio, over score thresholds, of the unlabelled above it to the
    positives above it, with a margin for the size of the samples.  The model
    is fitted on one half and the ratio taken on the other."""
    w = _fit(pos[::2], unl[::2], None)
    sp, su = np.sort(pos[1::2] @ w[:-1]), np.sort(unl[1::2] @ w[:-1])
    if not len(sp) or not len(su):
        return 0.5
    at = np.unique(np.concatenate([sp, su]))
    qp = 1 - np.searchsorted(sp, at, "left") / len(sp)
    qu = 1 - np.searchsorted(su, at, "left") / len(su)
    margin = np.sqrt(np.log(4 / 0.1) / (2 * len(sp))) + np.sqrt(np.log(4 / 0.1) / (2 * len(su)))
    ok = qp > 0
    best = np.argmin((qu[ok] + margin) / qp[ok])
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.05, 0.99))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def lowest_ids(ids: DataFrame, sample: int) -> DataFrame:
    """Up to ``sample`` distinct doc_ids, those with the smallest hash.

    Only ids under a hash bound, set from the number of rows, are made
    distinct and sorted: a few more than ``sample`` whatever the table holds.
    Repeated ids can leave too few under it; the bound is then doubled.
    """
    h = F.xxhash64("doc_id")
    rows, share = ids.count(), 1.0
    if rows > sample:
        share = min(1.0, 1.2 * sample / rows + 100 / rows)
    while True:
        some = ids.filter(h <= int(share * (2 ** 64 - 1)) - 2 ** 63).distinct() if share < 1 else ids.distinct()
        if share >= 1 or some.count() >= sample:
            return some.orderBy(h, "doc_id").limit(sample)
        share = min(1.0, 2 * share)


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """positive, __raw: one row for each of up to ``sample`` positive ids that have a
    document and of up to ``sample`` ids of any.  An id held by many rows
    counts once, with the text of the smallest hash; its rows are reduced in
    the tasks that read them."""
    free = ~held_out() & F.col("doc_id").isNotNull()
    chosen = lowest_ids(labels.filter("quality = 1").filter(free).select("doc_id"), sample).withColumn("positive", F.lit(True)).union(
        lowest_ids(docs.filter(free).select("doc_id"), sample).withColumn("positive", F.lit(False)))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("__raw")).join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
    return rows.groupBy("doc_id", "positive").agg(F.min(F.struct(F.xxhash64("__raw").alias("h"), "__raw")).alias("r")).select("positive", "r.__raw")


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features of up to ``sample`` positives and ``sample`` unlabelled rows."""
    rows = sample_rows(docs, labels, sample)
    got = rows.mapInArrow(_feature_rows, "positive boolean, x array<float>").toArrow()
    if not got.num_rows:
        return np.zeros((0, N_FEATURES)), np.zeros((0, N_FEATURES))
    x = np.asarray(got["x"].combine_chunks().flatten(), np.float64).reshape(-1, N_FEATURES)
    positive = got["positive"].to_numpy()
    order = np.lexsort([*x.T[::-1], positive])  # the order of arrival must not matter
    x, positive = x[order], positive[order].astype(bool)
    mix = np.random.default_rng(0)
    return mix.permutation(x[positive]), mix.permutation(x[~positive])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """mean, scale, weights and prior of the model."""
    pos, unl = training_sample(docs, labels, sample)
    if not len(pos) or not len(unl):
        return {"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "w": np.zeros(N_FEATURES + 1), "prior": 0.5}
    both = np.vstack([pos, unl])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale[scale < 1e-6] = np.inf  # a constant feature says nothing
    pos, unl = (pos - mean) / scale, (unl - mean) / scale
    prior = class_prior(pos, unl)
    return {"mean": mean, "scale": scale, "w": _fit(pos, unl, prior), "prior": prior}


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([features(r or b"") for r in part.column("__raw").to_pylist()], np.float64).reshape(-1, N_FEATURES)
                z = np.clip((x - model["mean"]) / model["scale"], -20, 20)
                # row by row, so that a score does not depend on its neighbours
                s = _sigmoid((z * model["w"][:-1]).sum(axis=1) + model["w"][-1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64())],
                                                 ["doc_id", "held_out", "score"])
    return run


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels.select("doc_id", "quality"), sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("binary").alias("__raw")) \
              .mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
