"""Quality classifier by positive-unlabelled learning.

A small network is trained by the non-negative unbiased PU risk: with the class prior p, trusted positives P and unlabelled
web text U,

    risk = p * loss(P as positive) + max(0, loss(U as negative) - p * loss(P as negative)),

and a step that would push the second part below zero goes the other way.  P and U are bounded samples (`POSITIVES`
and `UNLABELLED` rows with the least id hashes), so training is a fixed amount of driver work; every document is scored, whole,
in one pass without a shuffle.  The prior is estimated as the share of label 1 among the training labels (with add-one
smoothing); labels of 0 are used for nothing else.

Labels are taken only from training rows: those whose crc32 of the doc_id's text is not divisible by five.  Features
come from the text alone: letters, digits, case, punctuation, line and word statistics, repetition.

Nulls: a NULL text scores as an empty one; a NULL doc_id is not held out and takes no part in training.  Repeated labels: a
document with labels 0 and 1 is no trusted positive.  Without any training positives every score is the prior.  An empty
table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import per_batch, words

POSITIVES, UNLABELLED = 10_000, 20_000
HIDDEN, STEPS, RATE, BATCH = 24, 1500, 0.01, 512
FOLDS, THRESHOLD = 5, 0.3
_STATS = 14
N_FEATURES = 128 + _STATS


def features(text: bytes | None) -> np.ndarray:
    """Shares of the ASCII characters (on a log scale) and statistics of words, lines and repetition."""
    text = text or b""
    out = np.zeros(N_FEATURES, np.float32)
    found = words(text)
    n, size = max(1, len(found)), max(1, len(text))
    raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[:128] = np.log1p(1000 * raw[:128] / size)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    lines = [x for x in text.split(b"\n") if x.strip()]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    pairs = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
    upper, letters = int(raw[65:91].sum()), int(raw[65:91].sum() + raw[97:123].sum())
    out[128:] = [
        np.log1p(len(found)), np.log1p(len(lines)), lengths.mean() if len(found) else 0, lengths.std() if len(found) else 0,
        np.log1p(lengths.max(initial=0)), len(np.unique(h)) / n, len(np.unique(pairs)) / n, len(set(lines)) / max(1, len(lines)),
        upper / max(1, letters), raw[128:].sum() / size, sum(1 for w in found if w.isupper()) / n,
        sum(1 for w in found if w[-1:] in b"!#*$%&|<>") / n, sum(1 for w in found if w[-1:] in b".,;:?") / n, float(not found),
    ]
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def least_hashes(ids: DataFrame, limit: int) -> DataFrame:
    """The `limit` rows of (doc_id) with the least hashes: a fixed sample of a size known beforehand."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def sample_features(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the documents in a bounded list of ids, in the order of their ids."""

    def run(cols):
        return {"doc_id": cols["doc_id"], "f": [features(t).tobytes() for t in cols["text"]]}

    schema = pa.schema([("doc_id", pa.int64()), ("f", pa.binary())])
    # The list is at most POSITIVES or UNLABELLED ids long; an id that is repeated gives its least text.
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    rows = chosen.groupBy("doc_id").agg(F.min(F.col("text").cast("binary")).alias("text"))
    found = rows.mapInArrow(per_batch(run, schema), "doc_id long, f binary").toArrow()
    data = sorted(zip(found.column("doc_id").to_pylist(), found.column("f").to_pylist()))
    return np.frombuffer(b"".join(f for _, f in data), np.float32).reshape(-1, N_FEATURES)


class Model:
    """One hidden layer over standardised features."""

    def __init__(self, mean, spread, weights):
        self.mean, self.spread, self.weights = mean, spread, weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.spread, -6, 6) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Model | None:
    """Minimise the non-negative PU risk with the logistic loss by Adam; the same result on every run."""
    if not len(positive) or not len(unlabelled):
        return None
    rng = np.random.default_rng(seed)
    mean, spread = unlabelled.mean(axis=0, dtype=np.float64), unlabelled.std(axis=0, dtype=np.float64) + 1e-3
    w = [rng.normal(0, 0.1, (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    model = Model(mean, spread, w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradient(x, slope):
        z = np.clip((x - mean) / spread, -6, 6)
        hidden = np.tanh(z @ w[0] + w[1])
        back = slope[:, None] * w[2] * (1 - hidden ** 2)
        return [z.T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum()]

    order = np.concatenate([rng.permutation(len(unlabelled)) for _ in range(1 + STEPS * BATCH // len(unlabelled))])
    for step in range(STEPS):
        start = step * BATCH
        u = unlabelled[order[start:start + BATCH]].astype(np.float64)
        p = positive[rng.integers(0, len(positive), BATCH)].astype(np.float64)
        zu, zp = model.logits(u), model.logits(p)
        # log(1 + e^z) is the loss of a negative, log(1 + e^-z) that of a positive.
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu, gp = sigmoid(zu) / len(u), sigmoid(zp) / len(p)
        if negative >= 0:
            grads = [a + b for a, b in zip(gradient(u, gu), gradient(p, prior * ((sigmoid(zp) - 1) / len(p) - gp)))]
        else:
            grads = [-(a + b) for a, b in zip(gradient(u, gu), gradient(p, -prior * gp))]
        t += 1
        for k in range(4):
            g = grads[k] + 1e-4 * w[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] -= RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return model


def fitted(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Model | None, float]:
    """(model, prior) from training rows only."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    n, ones = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum("low"), F.lit(0))).first()
    prior = (ones + 1) / (n + 2)
    narrow = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    trusted = written(least_hashes(marks.where("low = 1").select("doc_id"), positives), "positives")
    web = written(least_hashes(narrow, unlabelled), "unlabelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return train(sample_features(texts, trusted), sample_features(texts, web), prior), prior


def scored(docs: DataFrame, model: Model | None, prior: float, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(cols):
        if model is None:
            score = np.full(len(cols["doc_id"]), prior)
        else:
            score = model.scores(np.stack([features(t) for t in cols["text"]]))
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": score.tolist(), "predicted": [int(s >= threshold) for s in score]}

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text")
    )
    return rows.mapInArrow(per_batch(run, schema), "doc_id long, held_out boolean, score double, predicted int")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, *fitted(docs, labels))
