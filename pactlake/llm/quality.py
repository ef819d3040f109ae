"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all it learns from; documents labelled bad are never used
as such. The class prior is estimated by the best bin (Garg et al., 2021), and the classifier minimises
the non-negative unbiased risk (Kiryo et al., 2017) by full-batch gradient steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pactlake.llm.words import NOT_SPACE, hashes, mixed, words_of
from pactlake.session import never_broadcast

#: Documents of each kind that a fit may look at. Scoring looks at all of them.
SAMPLE = 10_000
THRESHOLD = 0.7
FEATURES = 14

_PLAIN = np.array(
    [0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)]
)
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])


def features(texts: pa.Array) -> np.ndarray:
    """Shares of words by their letters, marks, case and repetition; one row per text, null as empty."""
    parts = []
    for w in words_of(texts, NOT_SPACE, lower=False):
        n, row, counts = len(w.counts), w.row_of(), np.maximum(w.counts, 1)
        length = w.end - w.start

        def inside(table: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(table[w.buf], dtype=np.int64)])
            return total[w.end] - total[w.start]

        def share(values: np.ndarray) -> np.ndarray:
            return np.bincount(row, weights=values, minlength=n) / counts

        marks, upper, digits = length - inside(_PLAIN), inside(_UPPER), inside(_DIGIT)
        h = hashes(w)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        place = mixed(h ^ mixed(row.astype(np.uint64) + np.uint64(1)))
        distinct = np.unique(place, return_index=True)[1]
        parts.append(
            np.stack(
                [
                    share(upper == 1),
                    share(upper >= np.maximum(0.8 * (length - marks), 2)),
                    share(length),
                    np.sqrt(share(length * length)),
                    share(length == 1),
                    share(marks == 0),
                    share(marks == 1),
                    share(marks == 2),
                    share(marks >= 3),
                    share(marks == length),
                    share(digits > 0),
                    share(again),
                    np.bincount(row[distinct], minlength=n) / counts,
                    np.log1p(w.counts),
                ],
                axis=1,
            )
        )
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_expanded(x, self.mean, self.scale) @ self.weights)


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)


def _descend(gradient, weights: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam."""
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for i in range(1, steps + 1):
        g = gradient(weights)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights = weights - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return weights


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300) -> float:
    """Share of positives among the unlabelled rows, as the best bin estimate.

    A classifier tells positives from unlabelled rows on one half. On the other half, above any of its
    scores, the unlabelled rows are at least prior x the share of positives there; the bound is taken
    where its confidence term is least.
    """
    p, u = positive[::2], unlabelled[::2]

    def gradient(w):
        gp = -(1 - _sigmoid(p @ w)) @ p / len(p)
        return gp + _sigmoid(u @ w) @ u / len(u) + 1e-3 * w

    weights = _descend(gradient, np.zeros(p.shape[1]), steps, 0.05)
    sp, su = np.sort(positive[1::2] @ weights), np.sort(unlabelled[1::2] @ weights)
    if not len(sp) or not len(su):
        return 0.5
    above_p = 1 - np.arange(len(sp)) / len(sp)
    above_u = 1 - np.searchsorted(su, sp, "left") / len(su)
    doubt = np.sqrt(np.log(40) / 2 / len(su)) + np.sqrt(np.log(40) / 2 / len(sp))
    best = np.argmin((above_u + doubt) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def fit_rows(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 800) -> Model:
    """The model of feature rows. Without rows of either kind every score is 0.5."""
    width = positive.shape[1]
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros(2 * width + 1), 0.5)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    p, u = _expanded(positive, mean, scale), _expanded(unlabelled, mean, scale)
    prior = estimated_prior(p, u)

    def gradient(w):
        fp, fu = _sigmoid(p @ w), _sigmoid(u @ w)
        # Risks of calling: positives positive, positives negative, unlabelled rows negative.
        as_positive = -prior * (1 - fp) @ p / len(p)
        negative = fu @ u / len(u) - prior * fp @ p / len(p)
        low = np.log1p(np.exp(np.clip(u @ w, -30, 30))).mean()
        low -= prior * np.log1p(np.exp(np.clip(p @ w, -30, 30))).mean()
        # A negative part below zero is over-fitted: that part alone is stepped back.
        return (as_positive + negative if low >= 0 else -negative) + 1e-4 * w

    weights = _descend(gradient, np.zeros(p.shape[1]), steps, 0.03)
    return Model(mean, scale, weights, prior)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from. A null id has no label and is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` trusted positives and `sample` documents taken as unlabelled, those
    whose ids hash lowest, none of them held out. A document labelled both 0 and 1 is not trusted."""
    order = F.xxhash64("doc_id", F.lit("sample"))
    ids = docs.select("doc_id").where(~held_out() & F.col("doc_id").isNotNull())
    trusted = labels.where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("least"))
    trusted = ids.join(never_broadcast(trusted.where("least = 1")), "doc_id", "left_semi").distinct()
    kinds = [
        rows.orderBy(order).limit(sample).withColumn("trusted", F.lit(kind))
        for rows, kind in ((trusted, True), (ids.distinct(), False))
    ]
    chosen = kinds[0].union(kinds[1])
    # At most twice the sample's ids.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("trusted"), pa.array(list(x), pa.list_(pa.float64()))],
                ["doc_id", "trusted", "x"],
            )

    rows = texts.mapInArrow(run, "doc_id bigint, trusted boolean, x array<double>")
    # One row for an id, however often it is listed.
    rows = rows.groupBy("doc_id", "trusted").agg(F.min("x").alias("x"))
    rows = rows.orderBy(order, "trusted").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), FEATURES)
    positive = rows["trusted"].to_numpy(bool)
    return fit_rows(x[positive], x[~positive])


def score(model: Model) -> Column:
    """Of the column `text`, 0 to 1, higher for better text; null and empty texts alike."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts)))

    return run(F.col("text"))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; only the text is scored."""
    rows = docs.select(F.col("doc_id"), held_out().alias("held_out"), score(model).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all their columns, that are scored at least `threshold`."""
    return docs.where(score(model) >= threshold)
