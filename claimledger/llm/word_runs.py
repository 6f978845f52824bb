"""Periodic run detection: branching-tandem test on an enhanced suffix array of each text's words.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(least, power * q)``
words that no neighbouring word extends with the same period.  A word is dropped from the collapsed text
if some run holds it after that run's first ``q`` words.

1. Stretches.  Every 4-word window inside a run recurs ``q`` words on, so a run lies in one stretch of
   windows that recur within a quarter of the text.  Words outside such stretches go no further; nothing is lost.
2. Suffix array by prefix doubling, LCP values from the ranks of the doublings, nearest smaller values
   for the LCP intervals.  A boundary of depth ``d`` splits its interval into the children before it and the one behind it.
3. For each suffix ``i`` of the smaller side, ``ISA[i + d]`` or ``ISA[i - d]`` in the other side tells a square of period ``d``
   that the next word breaks.  Only the smaller side is looked at, so a text of ``n`` words takes O(n log n) tests; no tree is built.
4. Rotation.  A square moves left while the words agree; squares of one stretch and end whose periods are multiples are one run.

Texts are read whole, several at a time, by rows that stay where they are: no shuffle.  Null and wordless texts have no
run and collapse to the empty text.  Repeated rows are judged one by one, extra columns pass through, an empty table stays empty.
Words are those between spaces and \\t \\n \\v \\f \\r; a collapsed text joins the kept ones by one space.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import read_table

FOUND = "struct<runs: array<struct<start: long, length: long, period: long>>, collapsed: string, n_words: long>"
#: Words in a window of the first step.
WINDOW = 4


def ranks(codes: np.ndarray, ends: np.ndarray, rounds: int | None = None) -> list[np.ndarray]:
    """Ranks, from 1, of the stretches of 1, 2, 4, ... words at every place; the last list's are all different unless ``rounds`` ends it.

    ``ends``: behind the last word of the text that holds each place.  Equal codes are of one text.
    """
    n, at = len(codes), np.arange(len(codes))
    out = [np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1]
    while out[-1].max(initial=0) < n and (rounds is None or len(out) <= rounds):
        h, rank = 2 ** (len(out) - 1), out[-1]
        inside = np.flatnonzero(at + h < ends)
        key = rank * (n + 1)
        key[inside] += rank[inside + h]
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([1], np.diff(key[order]) != 0)))
        out.append(new)
    return out


def common_prefixes(sa: np.ndarray, levels: Sequence[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it in ``sa``; -1 at both ends."""
    a, b = sa[:-1].copy(), sa[1:].copy()
    end_a, end_b = ends[a], ends[b]
    for k in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero((a < end_a) & (b < end_b))
        same = ok[levels[k][a[ok]] == levels[k][b[ok]]]
        a[same] += 2**k
        b[same] += 2**k
    return np.concatenate(([-1], a - sa[:-1], [-1]))


def nearest_smaller(values: np.ndarray, at: np.ndarray, step: int, ties: bool) -> np.ndarray:
    """For each place of ``at`` the nearest one before (step -1) or behind (+1) whose value is smaller (``ties``: or equal)."""
    to = np.arange(len(values)) + step
    to[0], to[-1] = 0, len(values) - 1
    open_ = at
    while len(open_):
        far = values[to[open_]] > values[open_] if ties else values[to[open_]] >= values[open_]
        open_ = open_[far]
        to[open_] = to[to[open_]]
    return to[at]


def squares(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, power: int = 4, at_once: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of the squares that the next word breaks and that ``power - 2`` equal periods precede.

    ``begins`` and ``ends``: of the stretch that holds each place; codes of different stretches differ.
    """
    levels = ranks(codes, ends)
    isa = levels[-1] - 1
    sa = np.empty(len(codes), np.int64)
    sa[isa] = np.arange(len(codes))
    lcp = common_prefixes(sa, levels, ends)
    del levels
    inner = np.flatnonzero(lcp > 0)
    left, right = nearest_smaller(lcp, inner, -1, False), nearest_smaller(lcp, inner, 1, True)
    first = sa[inner]
    worth = (lcp[inner] * power <= ends[first] - begins[first]) & (right - left >= power)
    inner, left, right = inner[worth], left[worth], right[worth]
    small_left = inner - left <= right - inner
    lo, hi = np.where(small_left, left, inner), np.where(small_left, inner, right)
    other_lo, other_hi = np.where(small_left, inner, left), np.where(small_left, right, inner)
    total = np.cumsum(hi - lo)
    k = 0
    while k < len(inner):
        to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + at_once, side="right")))
        sizes = hi[k:to] - lo[k:to]
        own = np.repeat(np.arange(k, to), sizes)
        x = sa[np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[own]]
        d = lcp[inner[own]]
        for sign in (1, -1):
            y = x + sign * d
            ok = np.flatnonzero((y < ends[x]) & (y >= begins[x]))
            ok = ok[(isa[y[ok]] >= other_lo[own[ok]]) & (isa[y[ok]] < other_hi[own[ok]])]
            i, p, o = (x if sign > 0 else y)[ok], d[ok], own[ok]
            side_lo, side_hi = (lo[o], hi[o]) if sign > 0 else (other_lo[o], other_hi[o])
            for back in range(1, power - 1):  # the periods before it stand in the square's own side
                z = i - back * p
                ok = np.flatnonzero(z >= begins[i])
                i, p, side_lo, side_hi, z = i[ok], p[ok], side_lo[ok], side_hi[ok], z[ok]
                ok = np.flatnonzero((isa[z] >= side_lo) & (isa[z] < side_hi))
                i, p, side_lo, side_hi = i[ok], p[ok], side_lo[ok], side_hi[ok]
            if len(i):
                yield i, p
        k = to


def rotated(codes: np.ndarray, start: int, period: int, begin: int) -> int:
    """The leftmost place to which the square at ``start`` moves, word by word, with the same period."""
    width = max(64, 2 * period)
    while start > begin:
        a = max(begin, start - width)
        differ = np.flatnonzero(codes[a:start] != codes[a + period : start + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, width = a, 2 * width
    return begin


def runs_of(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int = 6, power: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the runs, by start and period."""
    found = list(squares(codes, begins, ends, power))
    if not found:
        return []
    start, period = (np.concatenate([f[j] for f in found]) for j in (0, 1))
    behind = start + 2 * period
    out, last, held = [], -1, []
    for k in np.lexsort((period, behind)).tolist():
        i, q, e = int(start[k]), int(period[k]), int(behind[k])
        if e != last:
            last, held = e, []
        if any(q % known == 0 and e - power * q >= s for s, known in held):
            continue
        s = rotated(codes, i, q, int(begins[i]))
        held.append((s, q))
        if e - s >= max(least, power * q):
            out.append((s, e - s, q))
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, texts: np.ndarray, begins: np.ndarray, ends: np.ndarray, power: int = 4, windows: int = 3) -> list[tuple[int, int]]:
    """(first, behind the last) places of the stretches outside which no run can be.

    A run of 6 words has 3 windows of 4, any longer one has more.
    """
    rank = ranks(codes, ends, 2)[-1]
    order = np.argsort(rank, kind="stable")
    near = np.diff(order) * power <= (ends - begins)[order[1:]]
    same = (np.diff(rank[order]) == 0) & near
    hit = np.zeros(len(codes) + 1, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    hit[:-1] &= np.arange(len(codes)) + WINDOW <= ends
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    cut = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        while a < b:  # windows of different texts never hang together
            e = min(b, int(ends[a]))
            if e - a >= windows:
                cut.append((a, min(e + WINDOW - 1, int(ends[a]))))
            a = e
    return cut


def find_runs(texts: Sequence[Sequence[bytes]], least: int = 6, power: int = 4) -> list[list[tuple[int, int, int]]]:
    """For each text (its words) the runs in it, by start and period.  ``least`` is 6 at least and ``power`` 4 at least."""
    if least < 6 or power < 4:
        raise ValueError("runs are sought from 6 words and 4 periods on")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    known: dict[bytes, int] = defaultdict(count().__next__)
    codes = np.fromiter((c for t in texts for c in map(known.__getitem__, t)), np.int64, int(sizes.sum()))
    own = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    codes += own * len(known)
    cut = stretches(codes, own, begins[own], ends[own], power)
    if not cut:
        return out
    a, b = (np.array(x, np.int64) for x in zip(*cut, strict=True))
    n = b - a
    piece = np.repeat(np.arange(len(cut)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(piece)) - first[piece] + a[piece]
    inner = np.unique(codes[place], return_inverse=True)[1]
    local = piece * (int(inner.max()) + 1) + inner
    for s, length, q in runs_of(local, first[piece], (first + n)[piece], least, power):
        k = int(own[place[s]])
        out[k].append((int(place[s] - begins[k]), length, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for s, length, q in runs:
        gone[s + q : s + length] = True
    return b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])


def with_runs(docs: DataFrame, text_col: str = "text", out: str = "found", least: int = 6, power: int = 4, words_at_once: int = 200_000, key_col: str | None = None, edit: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """Adds ``out``: the runs (start, length, period, by start and period), the collapsed text and the number of words.

    ``edit`` changes the words of a text before the search, given the row's ``key_col`` (null: None).
    """

    def judged(texts: list[list[bytes]]) -> list[dict]:
        return [
            {"runs": [{"start": s, "length": n, "period": q} for s, n, q in runs], "collapsed": collapsed(words, runs).decode(), "n_words": len(words)}
            for words, runs in zip(texts, find_runs(texts, least, power), strict=True)
        ]

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch, keys in batches:
            rows, waiting, size = [], [], 0
            for t, key in zip(batch, keys, strict=True):
                words = t.encode().split() if isinstance(t, str) else []
                waiting.append(edit(words, int(key) if key is not None else None) if edit else words)
                size += len(words)
                if size >= words_at_once:
                    rows += judged(waiting)
                    waiting, size = [], 0
            rows += judged(waiting)
            yield pd.DataFrame(rows, columns=["runs", "collapsed", "n_words"])

    # the key travels as text: a long column with nulls would arrive as doubles
    return docs.withColumn(out, search.asNondeterministic()(F.col(text_col), F.col(key_col).cast("string") if key_col else F.lit(None).cast("string")))


def repeated_tail(words: list[bytes], key: int | None) -> list[bytes]:
    """The words, those from ``a`` on replaced by repeats of ``a`` to ``a + p - 1``, for a tenth of the keys; others as they are.

    With h = crc32 of the key as decimal text and g = h div 10, a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    """
    n = len(words)
    if key is None or not n or (h := zlib.crc32(str(key).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op12_word_runs(spark, sf_dir):
    """Runs of every document, a tenth of them with a repeated tail, and digests of the runs and of the collapsed text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    f = with_runs(docs, key_col="doc_id", edit=repeated_tail)
    runs = F.col("runs")
    greater = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.when(F.size(runs) > 0, F.reduce(runs, F.get(runs, 0), lambda a, b: F.when(greater(a, b), b).otherwise(a)))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return (
        f.select("doc_id", "found.*").withColumn("best", best)
        .select(
            "doc_id", F.size(runs).cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
            F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )


QUERIES = {"op12_word_runs": op12_word_runs}
ORACLES: dict[str, str] = {}
