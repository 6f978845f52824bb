"""Quality classifier by positive-unlabelled learning.

Features are shares of character classes and of repeated words over the whole text, cut into
quantile bins; the scorer is additive over the bins.  It minimises the non-negative unbiased risk
``pi R_P(+) + max(0, R_U(-) - pi R_P(-))`` from trusted positives and unlabelled web text.  The class
prior ``pi`` is the least ratio, over score thresholds, of the shares of unlabelled to positive rows above
it (best-bin estimation); the unlabelled shares are counted over all documents outside the held-out fold.

The rows of the gradient steps are bounded samples (``positives``, ``unlabelled``); scoring reads every text whole.  Null and
empty texts have all-zero features and get a score like any other; repeated rows and ties score alike, extra
columns pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import fresh_names, held_out, labelled_sample, read_table, sample_by_hash, texts_of

#: Groups of ASCII characters whose shares are features.
GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@^~+=_`", "|<>[]{}()/\\", "!?", ".,;:'\"-", "\n\r\t\x0b\x0c")
MASKS = np.zeros((len(GROUPS) + 1, 256))
for _i, _g in enumerate(GROUPS):
    MASKS[_i, list(_g.encode())] = 1.0
MASKS[-1, 128:] = 1.0
N_FEATURES = len(GROUPS) + 1 + 5


def text_features(text: str | None) -> np.ndarray:
    """Shares of byte classes; distinct words and word pairs, immediate repeats, mean length, log count."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out[: len(MASKS)] = MASKS @ np.bincount(raw, minlength=256) / len(raw)
    words = text.split()
    n = len(words)
    if n:
        k = len(MASKS)
        later = words[1:]
        out[k] = len(set(words)) / n
        out[k + 1] = (len(set(zip(words, later, strict=False))) + 1) / n
        out[k + 2] = sum(map(operator.eq, words, later)) / n
        out[k + 3] = len(text) / n
        out[k + 4] = np.log(n)
    return out


@dataclass(frozen=True)
class PuModel:
    cuts: tuple[tuple[float, ...], ...]
    weights: np.ndarray
    bias: float
    prior: float


def bin_edges(x: np.ndarray, bins: int) -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(np.unique(np.quantile(c, np.arange(1, bins) / bins))) for c in x.T)


def one_hot(x: np.ndarray, cuts) -> np.ndarray:
    """Each feature's bin as an indicator; a value equal to a cut belongs to the bin below it."""
    cols = []
    for c, edges in zip(x.T, cuts, strict=True):
        at = np.searchsorted(edges, c, side="left")
        cols.append(np.eye(len(edges) + 1)[at])
    return np.hstack(cols)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def prior_thresholds(pos: np.ndarray, least_share: float = 0.3, most: int = 100) -> np.ndarray:
    """Score thresholds at which the prior is looked for: quantiles of the positives that ``least_share`` of them pass at least; beyond, ratios are noise."""
    return np.unique(np.quantile(pos, np.linspace(0, 1 - least_share, most)))


def estimate_prior(pos: np.ndarray, thresholds: np.ndarray, above: np.ndarray) -> float:
    """Least ratio of the shares of unlabelled (``above``, one for each threshold) and positive rows at or above a threshold."""
    ratios = above / np.array([(pos >= c).mean() for c in thresholds])
    return float(np.clip(ratios.min(), 0.02, 0.98))


def _adam(grad, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass(frozen=True)
class PlainModel:
    """Positive against unlabelled rows, fitted on every second row; it only ranks."""

    cuts: tuple[tuple[float, ...], ...]
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return one_hot(x, self.cuts) @ self.weights[:-1] + self.weights[-1]


def fit_plain(pos: np.ndarray, unl: np.ndarray, bins: int = 12, steps: int = 500, rate: float = 0.05, l2: float = 2e-4) -> PlainModel:
    cuts = bin_edges(np.vstack([pos, unl]), bins)
    p, u = (np.hstack([one_hot(x[::2], cuts), np.ones((len(x[::2]), 1))]) for x in (pos, unl))
    reg = np.append(np.full(p.shape[1] - 1, l2), 0.0)
    return PlainModel(cuts, _adam(lambda w: p.T @ (_sigmoid(p @ w) - 1) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + reg * w, p.shape[1], steps, rate))


def fit_pu(pos: np.ndarray, unl: np.ndarray, shares=None, bins: int = 12, steps: int = 500, rate: float = 0.05, l2: float = 2e-4) -> PuModel:
    """The class prior from a plain fit's scores, then the non-negative risk on all rows.

    ``shares(model, thresholds)`` gives the shares of the unlabelled corpus at or above score
    thresholds; without it they are those of the other half of ``unl``.
    """
    plain = fit_plain(pos, unl, bins, steps, rate, l2)
    held = plain.scores(pos[1::2])
    at = prior_thresholds(held)
    rest = plain.scores(unl[1::2])
    prior = estimate_prior(held, at, shares(plain, at) if shares else np.array([(rest >= c).mean() for c in at]))
    cuts = plain.cuts
    p, u = (np.hstack([one_hot(x, cuts), np.ones((len(x), 1))]) for x in (pos, unl))
    reg = np.append(np.full(p.shape[1] - 1, l2), 0.0)

    def risk(w):
        zp, zu = p @ w, u @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = prior * (p.T @ (sp - 1)) / len(p)
        down = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        return (up + down if negative >= 0 else -down) + reg * w

    w = _adam(risk, p.shape[1], steps, rate)
    return PuModel(cuts, w[:-1], float(w[-1]), prior)


def score_features(x: np.ndarray, model: PuModel) -> np.ndarray:
    return _sigmoid(one_hot(x, model.cuts) @ model.weights + model.bias)


def _features(df: DataFrame) -> DataFrame:
    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([text_features(x if isinstance(x, str) else None) for x in batch])

    return df.select("doc_id", features("text").alias("f"))


def train_quality(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 6000) -> PuModel:
    """Trusted positives are training rows of ``labels.quality`` 1; unlabelled rows are any others outside the held-out fold.

    Of fewer than four rows of either kind nothing can be learnt: the model then takes every text for good (0.982).
    """
    pos = labelled_sample(docs, labels, "quality", 1, positives)
    unl = texts_of(docs, sample_by_hash(docs.where(~held_out(F.col("doc_id"))), "doc_id", unlabelled))
    rows = [np.array([r["f"] for r in sorted(_features(df).collect())]).reshape(-1, N_FEATURES) for df in (pos, unl)]
    if min(map(len, rows)) < 4:
        return PuModel(tuple(() for _ in range(N_FEATURES)), np.zeros(N_FEATURES), 4.0, 0.98)
    return fit_pu(*rows, shares=lambda plain, at: corpus_shares(docs.where(~held_out(F.col("doc_id"))), plain, at))


def corpus_shares(docs: DataFrame, plain: PlainModel, thresholds: np.ndarray) -> np.ndarray:
    """Shares of all ``docs`` that score at or above each threshold: one pass, counts of as many groups as thresholds come back."""

    @F.pandas_udf("int")
    def passed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([text_features(t if isinstance(t, str) else None) for t in batch]).reshape(-1, N_FEATURES)
            yield pd.Series(np.searchsorted(thresholds, plain.scores(x), side="right"))

    counts = np.zeros(len(thresholds) + 1)
    for r in docs.select(passed("text").alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect():
        counts[r["k"]] = r["n"]
    return counts[::-1].cumsum()[::-1][1:] / max(1.0, counts.sum())


def score_quality(docs: DataFrame, model: PuModel, threshold: float = 0.7, text_col: str = "text", out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the two columns of ``out``, score (1: likelier good) and decision; columns of these names are replaced."""

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([text_features(t if isinstance(t, str) else None) for t in batch]).reshape(-1, N_FEATURES)
            yield pd.Series(score_features(x, model))

    df = docs.drop(*out).withColumn(out[0], quality.asNondeterministic()(F.col(text_col)))
    return df.withColumn(out[1], (F.col(out[0]) >= threshold).cast("int"))


def drop_low_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go; the columns stay as they are."""
    model = train_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    score, predicted = fresh_names(docs, "score", "predicted")
    return score_quality(docs, model, out=(score, predicted)).where(F.col(predicted) == 1).select(*docs.columns)


def op3_quality_pu(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op3_quality_pu": op3_quality_pu}
ORACLES: dict[str, str] = {}
