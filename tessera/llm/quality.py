"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled 1; all other training documents are unlabelled web text. Labels of 0
are never used. The class prior is estimated from a first classifier that tells positives from unlabelled
text: where only good documents are, the density ratio of the two is one over the prior. The model is a
logistic one on quantile indicators of surface statistics, trained on
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``.

Fitting takes at most ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` training documents, those of smallest id hash; scoring
covers all. Null and empty texts have all statistics 0 and a score like any other. With no positives the
score is 0.5 throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import prepare
from tessera.llm.textops import LOWER, chunks, span_hashes, word_spans

MAX_POSITIVE, MAX_UNLABELLED = 10_000, 20_000
BINS = 12
THRESHOLD = 0.3
FEATURES = 14

_CLASS = np.zeros(256, np.int64)  # 1 upper, 2 lower, 3 digit, 4 stop or comma, 5 other sign, 6 space, 7 newline, 0 beyond ASCII
_CLASS[0x21:0x7F] = 5
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[0x2C, 0x2E, 0x27, 0x2D]] = 4
_CLASS[[0x20, 9, 11, 12, 13]], _CLASS[10] = 6, 7


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES surface statistics for each document."""
    n_docs, size = len(off) - 1, np.diff(off)
    some = np.maximum(size, 1)
    owner = np.repeat(np.arange(n_docs), size)
    share = np.bincount(owner * 8 + _CLASS[buf], minlength=8 * n_docs).reshape(n_docs, 8) / some[:, None]
    low = LOWER[buf]
    starts, ends, first = word_spans(low, off)
    words = np.diff(first)
    has = np.maximum(words, 1)
    h = span_hashes(low, starts, ends)
    w_owner = np.repeat(np.arange(n_docs), words)
    order = np.lexsort((h, w_owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w_owner[order][1:] != w_owner[order][:-1])
    distinct = np.bincount(w_owner[order][new], minlength=n_docs)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w_owner[1:] == w_owner[:-1])
    length = (ends - starts).astype(float)
    alone = length == 1
    tail = low[ends - 1] if len(ends) else low[:0]
    sign = _CLASS[tail] == 5
    inner = np.zeros(len(buf), bool)
    inner[1:] = (_CLASS[buf[1:]] == 1) & (_CLASS[buf[:-1]] == 1)
    by = lambda x: np.bincount(w_owner, weights=x, minlength=n_docs) / has
    letters = np.maximum(share[:, 1] + share[:, 2] + share[:, 0], 1e-9)
    out = [
        np.log1p(size),
        share[:, 1] / letters,
        share[:, 3],
        share[:, 4],
        share[:, 5],
        share[:, 6],
        np.log1p(share[:, 7] * some),
        by(length),
        np.sqrt(np.maximum(0, by(length * length) - by(length) ** 2)),
        distinct / has,
        distinct / np.sqrt(has),
        by(again) + by(alone.astype(float)) * 1e-3,
        by(sign.astype(float)),
        np.bincount(owner, weights=inner, minlength=n_docs) / some,
    ]
    return np.stack(out, 1)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(buf, off) for _, _, buf, off in chunks(batch.column("text"))]
        flat = np.concatenate(rows) if rows else np.zeros((0, FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


def _expand(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Indicators of the quantile bin of each statistic, and a constant."""
    hot = [np.ones((len(x), 1))]
    for j in range(x.shape[1]):
        hot.append(np.eye(BINS)[np.searchsorted(edges[j], x[:, j], side="right")])
    return np.concatenate(hot, 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(gradient, dim: int, steps: int, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    w, m, v = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    for t in range(1, steps + 1):
        g = gradient(w) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> dict:
    """Bin edges, estimated class prior and weights from rows of statistics."""
    if not len(positive) or not len(unlabelled):
        return {"w": None, "prior": None}
    both = np.concatenate((positive, unlabelled))
    edges = np.quantile(both, np.arange(1, BINS) / BINS, axis=0).T
    p, u = _expand(positive, edges), _expand(unlabelled, edges)
    # positives against unlabelled text, each side weighing one half: the odds are the density ratio
    w = _descend(lambda w: (u * _sigmoid(u @ w)[:, None]).mean(0) - (p * _sigmoid(-(p @ w))[:, None]).mean(0), p.shape[1], 300)
    prior = float(np.clip(1 / np.exp(np.median(p @ w)), 0.05, 0.98))

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        up = -(p * _sigmoid(-zp)[:, None]).mean(0)  # of the risk of positives as positive
        down = (u * _sigmoid(zu)[:, None]).mean(0) - prior * (p * _sigmoid(zp)[:, None]).mean(0)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        return prior * up + down if negative >= 0 else -down

    return {"edges": edges, "prior": prior, "w": _descend(gradient, p.shape[1], 500)}


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(buf, off) for _, _, buf, off in chunks(batch.column("text"))]
            x = np.concatenate(rows) if rows else np.zeros((0, FEATURES))
            s = np.full(len(x), 0.5) if model["w"] is None else _sigmoid(_expand(x, model["edges"]) @ model["w"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> dict:
    """Model from training documents (doc_id, text) and their labels (doc_id, quality)."""
    prepare(docs.sparkSession)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    order = F.xxhash64("doc_id", F.lit(17))
    ids = docs.select("doc_id").distinct()
    pos = good.join(ids, "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_positive).withColumn("trusted", F.lit(True))
    rest = ids.orderBy(order, "doc_id").limit(max_unlabelled).withColumn("trusted", F.lit(False))
    sample = F.broadcast(pos.unionByName(rest))  # at most the two bounds
    got = docs.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(_emit, "doc_id long, x array<double>")
    got = got.join(sample, "doc_id").orderBy("doc_id", "trusted").toPandas()
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, FEATURES))
    trusted = got["trusted"].to_numpy(bool)
    return fit(x[trusted], x[~trusted])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(model), "doc_id long, score double")
