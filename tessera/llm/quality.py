"""Quality classifier by positive-unlabelled learning.

A linear scorer on statistics of the text minimises the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` over trusted positives and unlabelled web text.
The class prior is estimated from the two samples; no negative label is used.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Expected rows of the two training samples. All rows are scored; only the fit is on a sample.
POSITIVE_ROWS, UNLABELLED_ROWS = 15_000, 30_000

#: Signs whose shares are features of their own.
_SIGNS = b".,;:!?*#$%&|/\\<>@_-=+'\"()[]{}~^`"
N_FEATURES = len(_SIGNS) + 14


def features(text: str | None) -> np.ndarray:
    """Statistics of one whole text: shares of kinds of signs, word shapes, repetition."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda lo, hi: counts[lo:hi].sum() / n
    out = np.zeros(N_FEATURES, np.float32)
    out[: len(_SIGNS)] = counts[np.frombuffer(_SIGNS, np.uint8)] / n
    words = raw.split()
    m = max(1, len(words))
    twice = sum(map(operator.eq, words, words[1:]))
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    out[len(_SIGNS) :] = (
        share(97, 123), share(65, 91), share(48, 58), share(128, 256), share(0, 33),
        np.log1p(n) / 10, np.log1p(m) / 10, len(set(words)) / m, len(set(words)) / np.sqrt(m) / 10, twice / m,
        lengths.mean() / 10, lengths.std() / 10, len(set(lines)) / len(lines), m / len(lines) / 50,
    )
    return out


def expanded(x: np.ndarray) -> np.ndarray:
    """The statistics with their square roots, which tell small shares apart."""
    return np.concatenate([x, np.sqrt(np.abs(x))], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return ((expanded(x) - self.mean) / self.scale) @ self.weight + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least_share: float = 0.5) -> float:
    """Share of positives among the unlabelled, from scores of both samples.

    Above any threshold the unlabelled share is at least prior times the positive share, so the
    smallest ratio of the two over thresholds (that keep ``least_share`` of the positives) bounds the
    prior from above, and meets it where a score range is free of negatives. The ratio's standard error
    is added, since the smallest of many noisy ratios is too small.
    """
    grid = np.quantile(positive, np.linspace(0, 1 - least_share, 60))
    p = (positive[None, :] >= grid[:, None]).mean(axis=1)
    u = (unlabelled[None, :] >= grid[:, None]).mean(axis=1)
    ratio = u / p
    error = ratio * np.sqrt((1 - u) / np.maximum(u, 1e-9) / len(unlabelled) + (1 - p) / p / len(positive))
    return float(np.clip((ratio + error).min(), 0.01, 0.99))


def _descend(xp: np.ndarray, xu: np.ndarray, prior: float, weight: np.ndarray, bias: float, steps: int, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the logistic loss."""
    theta = np.append(weight, bias)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    one = lambda x: np.hstack([x, np.ones((len(x), 1), x.dtype)])
    xp, xu = one(xp), one(xu)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = xp @ theta, xu @ theta
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        rest = xu.T @ sig(zu) / len(xu) - prior * (xp.T @ sig(zp)) / len(xp)
        grad = -prior * (xp.T @ sig(-zp)) / len(xp) + rest if negative >= 0 else -rest
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 600) -> Model:
    """Fit on two samples of ``features`` rows; ``prior`` is estimated if not given."""
    width = 2 * N_FEATURES
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5 if prior is None else prior)
    xp, xu = expanded(positive), expanded(unlabelled)
    mean, scale = xu.mean(axis=0), xu.std(axis=0) + 1e-6
    xp, xu = np.clip((xp - mean) / scale, -20, 20), np.clip((xu - mean) / scale, -20, 20)
    weight, bias = np.zeros(width), 0.0
    if prior is None:
        # A first scorer of positives against unlabelled, good enough to rank. Each half of the rows
        # is scored by a fit on the other, since a fit flatters its own positives.
        own = [_descend(xp[i::2], xu[i::2], 0.5, weight, bias, steps // 2) if len(xp) > 1 and len(xu) > 1 else (weight, bias) for i in (0, 1)]
        prior = float(np.mean([estimated_prior(xp[1 - i :: 2] @ w + c, xu[1 - i :: 2] @ w + c) for i, (w, c) in enumerate(own) if len(xp) > 1 and len(xu) > 1] or [0.5]))
    weight, bias = _descend(xp, xu, prior, weight, bias, steps)
    return Model(mean, scale, weight, bias, prior)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([features(t.as_py()) for t in batch.column(0)], np.float32).reshape(-1, N_FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], ["x", "trusted"])


def _share(n: int, wanted: int) -> float:
    return min(1.0, wanted / max(1, n))


def _chosen(key: Column, share: float) -> Column:
    """A repeatable sample by hash."""
    return F.lit(True) if share >= 1 else F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)


def train(docs: DataFrame, labels: DataFrame, usable: Column, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the rows of ``docs`` where ``usable`` (a condition on the id column) holds.

    Trusted positives are the ids that ``labels(doc_id, quality)`` marks 1 and never anything else;
    the unlabelled sample is drawn from all usable rows. Both samples have the expected sizes that
    the parameters give.
    """
    key = F.col(id_col)
    known = labels.select(F.col("doc_id").alias(id_col), "quality").where(usable & F.col("quality").isNotNull() & key.isNotNull())
    trusted = known.groupBy(id_col).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = 1 and high = 1").select(id_col)
    trusted = trusted.where(_chosen(key, _share(trusted.count(), positive_rows)))
    pool = docs.select(id_col, text_col).where(usable)
    share = _share(pool.count(), unlabelled_rows)
    # At most about positive_rows ids, so their size is bounded.
    marked = pool.join(F.broadcast(trusted.withColumn("trusted", F.lit(True))), id_col, "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    drawn = _chosen(F.concat_ws("/", key.cast("string"), F.lit("u")), share)
    marked = marked.where(F.col("trusted") | drawn).select(F.col(text_col).alias("text"), F.struct("trusted", drawn.alias("drawn")).alias("trusted"))
    got = marked.mapInArrow(_rows, "x binary, trusted struct<trusted: boolean, drawn: boolean>").select("x", "trusted.trusted", "trusted.drawn").toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    return fit(x[got["trusted"].to_numpy(bool)], x[got["drawn"].to_numpy(bool)])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column score, 0 to 1; null and empty texts are scored as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)], np.float32).reshape(-1, N_FEATURES)
            score = model.scores(x.astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """True for the fold whose labels are never learned from; a null id belongs to it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Labels are learned from outside the held-out fold only. Null and empty texts are scored as empty
    ones, texts of any length whole, repeated rows each; a null id belongs to the held-out fold. With no
    usable positive or no documents every score is 0.5. Ids that are labelled both ways are no
    positives. Further columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, ~held_out(F.col(id_col)), id_col=id_col, text_col=text_col, **sizes)
    out = scored(docs, model, id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns.

    Null and empty texts are scored as empty ones; repeated rows stay or go together. Without a usable
    positive every score is 0.5. An empty table gives an empty result.
    """
    model = train(docs, labels, ~held_out(F.col(id_col)), id_col=id_col, text_col=text_col, **sizes)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], np.float32).reshape(-1, N_FEATURES)
        return pd.Series(model.scores(x.astype(np.float64)))

    # The row travels as one struct, so no name of its columns can clash.
    rows = docs.select(F.struct("*").alias("_row"), score(F.col(text_col)).alias("_score"))
    return rows.where(F.col("_score") >= least).select("_row.*")
