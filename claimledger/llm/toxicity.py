"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams (and of itself), a
segment's vector the mean of its words', and a two-class softmax reads it (times the segment length).  Training is by multiple
instances: a toxic document vouches only for its most toxic segments, a clean one for all of its
own.  A document scores by its worst segment, so a short insult in a long text is not averaged away;
the segment logit is calibrated on labelled rows kept out of the fit.

Training reads a bounded sample of rows (``toxic_rows`` and ``clean_rows`` documents, fewer where
texts average over ``row_chars`` characters), each with its whole text, as scoring does, so the
maximum over a long text's segments is calibrated as it is scored.  Null, empty and wordless texts get the intercept's
score, ties and repeated rows score alike, extra columns pass through.  An empty table gives an empty
result; labels that know one class alone, or none, are described at ``train_toxicity``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import fresh_names, held_out, labelled_sample, read_table

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”„«»¡¿–—"


def subword_table(tokens: Sequence[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all tokens in order, buckets per token): the 3- to 5-grams of ``<word>`` and the word itself.

    A token's outer punctuation is stripped.  Hashes are polynomials of the characters, mixed.
    """
    words = [f"<{t.strip(PUNCTUATION) or t}>" for t in tokens]
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = ends[owner] - np.arange(len(chars))
    prime = np.uint64(0x100000001B3)
    owners, hashes = [], []
    with np.errstate(over="ignore"):
        run = np.zeros(len(chars), np.uint64)
        for n in range(1, 6):
            last = len(chars) - n + 1
            run = run[:last] * prime + chars[n - 1 :] * np.uint64(0x9E3779B97F4A7C15) if last > 0 else run[:0]
            if n >= 3:
                fits = np.flatnonzero(left[: max(0, last)] >= n)
                owners.append(owner[fits])
                hashes.append(run[fits] + np.uint64(n))
        whole = np.add.reduceat(chars * (prime ** left.astype(np.uint64)), ends - lengths) if len(words) else chars
        owners.append(np.arange(len(words)))
        hashes.append(whole)
        h = np.concatenate(hashes)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return bucket[order], np.bincount(who, minlength=len(words))


def distinct_runs(text: str | None) -> list[str]:
    """Lower-cased words of the text, a run of one repeated word counting once."""
    return [w for w, _ in groupby((text or "").lower().split())]


def segment_starts(n: int, size: int) -> np.ndarray:
    """Starts of runs of ``size`` words; a last run of less than half joins the one before."""
    starts = np.arange(0, n, size)
    return starts[:-1] if len(starts) > 1 and n - starts[-1] < (size + 1) // 2 else starts


def means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) / np.diff(np.append(starts, len(values)))


@dataclass(frozen=True)
class ToxicModel:
    """weights: embedding times (toxic - clean) column of the softmax, by bucket."""

    weights: np.ndarray
    bias: float
    bits: int
    segment: int
    slope: float
    offset: float


class WordLogits(dict):
    """token -> its share of the segment logit; starts anew when it has grown past ``most`` tokens, a bound on memory alone."""

    def __init__(self, model: ToxicModel, most: int = 200_000):
        super().__init__()
        self.model, self.most = model, most

    def learn(self, texts: Sequence[list[str]]) -> None:
        """Adds the tokens of ``texts`` that are new."""
        if len(self) >= self.most:
            self.clear()
        new = list({w for words in texts for w in words if w not in self})
        for first in range(0, len(new), 10_000):
            some = new[first : first + 10_000]
            bucket, count = subword_table(some, self.model.bits)
            z = np.add.reduceat(self.model.weights[bucket], np.cumsum(count) - count) / count
            self.update(zip(some, z.tolist(), strict=True))


def worst_segments(texts: Sequence[str | None], logits: WordLogits, block: int = 200) -> np.ndarray:
    """The greatest segment logit of each text."""
    out, model = np.full(len(texts), logits.model.bias), logits.model
    for first in range(0, len(texts), block):
        some = [distinct_runs(t) for t in texts[first : first + block]]
        logits.learn(some)
        for i, words in enumerate(some, first):
            if words:
                z = np.fromiter(map(logits.__getitem__, words), np.float64, len(words))
                out[i] += model.segment * float(means(z, segment_starts(len(z), model.segment)).max())
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit(texts: Sequence[str], labels: Sequence[int], bits: int = 16, dim: int = 8, segment: int = 24, rounds: int = 6, steps: int = 40, rate: float = 0.03, l2: float = 3e-4, floor: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """(bucket weights, bias).  Embedding and softmax are updated together by Adam on full batches."""
    vocab: dict[str, int] = {}
    ids, seg_len, seg_doc = [], [], []
    for d, text in enumerate(texts):
        words = distinct_runs(text)
        if not words:
            continue
        ids.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words)))
        sizes = np.diff(np.append(segment_starts(len(words), segment), len(words)))
        seg_len.append(sizes)
        seg_doc.append(np.full(len(sizes), d))
    if not ids:
        return np.zeros(1 << bits), -4.0
    word, seg_len, doc = np.concatenate(ids), np.concatenate(seg_len), np.concatenate(seg_doc)
    del ids
    seg_start = np.append(0, np.cumsum(seg_len)[:-1])
    seg = np.repeat(np.arange(len(seg_len), dtype=np.int32), seg_len)
    new = list(vocab)
    parts = [subword_table(new[i : i + 10_000], bits) for i in range(0, len(new), 10_000)]
    gram, gram_len = np.concatenate([g.astype(np.int32) for g, _ in parts]), np.concatenate([n for _, n in parts])
    del parts
    gram_start = np.cumsum(gram_len) - gram_len
    owner = np.repeat(np.arange(len(vocab), dtype=np.int32), gram_len)
    y = np.asarray(labels, dtype=np.float64)[doc]

    rng = np.random.default_rng(seed)
    emb, soft, bias = rng.normal(0, 0.01, (1 << bits, dim)), rng.normal(0, 0.3, (dim, 2)), np.zeros(2)
    moved, spread, t = [np.zeros_like(a) for a in (emb, soft, bias)], [np.zeros_like(a) for a in (emb, soft, bias)], 0
    n_seg = np.bincount(doc, minlength=len(labels))
    chosen = np.ones(len(y), dtype=bool)
    for r in range(rounds):
        weight = chosen / np.maximum(1, np.bincount(doc[chosen], minlength=len(labels)) if r else n_seg)[doc]
        weight = weight / np.where(y == 1, max(1e-9, 2 * weight[y == 1].sum()), max(1e-9, 2 * weight[y == 0].sum()))
        for _ in range(steps):
            z = np.add.reduceat((emb @ (soft[:, 1] - soft[:, 0]))[gram], gram_start) / gram_len
            logit = segment * np.add.reduceat(z[word], seg_start) / seg_len + bias[1] - bias[0]
            res = (_sigmoid(logit) - y) * weight
            g_word = segment * np.bincount(word, weights=(res / seg_len)[seg], minlength=len(vocab))
            g_gram = np.bincount(gram, weights=(g_word / gram_len)[owner], minlength=1 << bits)
            pull = emb.T @ g_gram
            grads = (np.outer(g_gram, soft[:, 1] - soft[:, 0]) + l2 * emb, np.stack([-pull, pull], 1) + l2 * soft, np.array([-res.sum(), res.sum()]))
            t += 1
            for k, (a, g) in enumerate(zip((emb, soft, bias), grads, strict=True)):
                moved[k] += 0.1 * (g - moved[k])
                spread[k] += 0.01 * (g * g - spread[k])
                a -= rate * (moved[k] / (1 - 0.9**t)) / (np.sqrt(spread[k] / (1 - 0.99**t)) + floor)
        # from now on a toxic document vouches for its worst segment and those the model is sure of
        top = np.full(len(labels), -np.inf)
        np.maximum.at(top, doc, logit)
        chosen = (y == 0) | (logit >= top[doc]) | (logit > 2.0)
    return emb @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def platt(x: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    mu, sd = (x.mean(), x.std() + 1e-9) if len(x) else (0.0, 1.0)
    f, w = np.stack([(x - mu) / sd, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(steps):
        p = _sigmoid(f @ w)
        h = (f * (p * (1 - p))[:, None]).T @ f + 0.5 * np.eye(2)
        w -= 0.5 * np.linalg.solve(h, f.T @ (p - y) + 0.5 * w * np.array([1.0, 0.0]))
    return float(w[0] / sd), float(w[1] - w[0] * mu / sd)


def whole_texts(docs: DataFrame, labels: DataFrame, value: int, most: int, most_chars: int) -> list[str]:
    """Whole texts of at most ``most`` training documents, in the order of their ids.

    Ids are taken by hash until their texts hold ``most_chars`` characters; the one that passes it
    is still taken, so a bound on memory takes away rows and never a part of a text.
    """
    sample = labelled_sample(docs, labels, "toxic", value, most).withColumn("h", F.xxhash64("doc_id"))
    room, last = most_chars, None
    for r in sorted(sample.select("h", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).collect()):
        if room <= 0:
            break
        room, last = room - r["n"], r["h"]
    rows = sample.where(F.col("h") <= F.lit(last)).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def train_toxicity(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1200, clean_rows: int = 2000, bits: int = 16, segment: int = 24, row_chars: int = 10_000) -> ToxicModel:
    """From at most ``toxic_rows`` and ``clean_rows`` training documents by ``labels.toxic``; three in four fit, one calibrates.

    Where the training labels know one class alone there is nothing to tell apart: every text then gets that
    class's share of the labels, smoothed by one row of each (without any labels 0.018), as its score.
    """
    counts = {r["toxic"]: r["n"] for r in labels.where(~held_out(F.col("doc_id"))).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts, y = [], []
    for value, most in ((0, clean_rows), (1, toxic_rows)):
        texts += whole_texts(docs, labels, value, most, most * row_chars)
        y += [value] * (len(texts) - len(y))
    y = np.asarray(y, dtype=np.float64)
    if not 0 < y.sum() < len(y):
        prior = np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)) if len(y) else -4.0
        return ToxicModel(np.zeros(1 << bits), 0.0, bits, segment, 1.0, float(prior))
    check = np.arange(len(y)) % 4 == 3
    weights, bias = fit([t for t, c in zip(texts, check, strict=True) if not c], y[~check], bits=bits, segment=segment)
    logits = WordLogits(raw := ToxicModel(weights, bias, bits, segment, 1.0, 0.0))
    x = worst_segments([t for t, c in zip(texts, check, strict=True) if c], logits, block=50)
    slope, offset = platt(x, y[check])
    # the sample is near balanced: shift to the share of toxic rows among all training labels
    true = np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)) - np.log((y[check].sum() + 1) / ((1 - y[check]).sum() + 1))
    return ToxicModel(raw.weights, raw.bias, bits, segment, slope, offset + float(true))


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, text_col: str = "text", out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the two columns of ``out``, score and decision; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size fixed by ``bits``

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        logits = WordLogits(shared.value)
        for batch in batches:
            z = worst_segments([x if isinstance(x, str) else None for x in batch], logits)
            yield pd.Series(_sigmoid(shared.value.slope * z + shared.value.offset))

    df = docs.drop(*out).withColumn(out[0], toxic.asNondeterministic()(F.col(text_col)))
    return df.withColumn(out[1], (F.col(out[0]) >= threshold).cast("int"))


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go; the columns stay as they are."""
    model = train_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    score, predicted = fresh_names(docs, "score", "predicted")
    return score_toxicity(docs, model, out=(score, predicted)).where(F.col(predicted) == 0).select(*docs.columns)


def op8_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
