"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edits.

Texts are word sequences (lower-cased runs of letters and digits; characters of scripts that are
written without spaces are words of their own).  A stretch of a text matches an item when their edit
distance in words is at most ``edits``, a fifth of the item's words.

1. Windows.  An item is sought by its pieces: up to ``piece_words`` words it is one piece, longer ones are cut
   into equal parts.  Of ``e`` edits to ``m`` words some piece of ``n`` words has ``e n / m`` at most, so a match
   always has a piece within the distance.  Deletions and insertions make the walk below drift with each edit, so pieces are
   short: at 20 words, four edits at most, all kinds of edits are found as often (measured by kind and length in the tests).  A piece of ``n`` words is sought in
   windows of ``n`` words at every word of every text.  Windows that hold too few of the piece's word pairs to be within the
   distance are passed over: ``d`` edits destroy at most ``2 d`` of the ``n - 1`` pairs, so this loses nothing.
2. Embedding.  The CGK walk copies the word under its cursor and moves on by a random bit of (step,
   word): two sequences a few edits apart fall into step again, so that edit distance becomes Hamming
   distance.  ``tables`` samples of ``bits`` positions of the walk's first ``1.6 n`` steps are its keys.
   More tables are drawn until the recall that theory gives for windows at the limit reaches
   ``recall``, with a fresh walk for each table.
3. Verification.  Where a window shares a key with a piece, the whole item is aligned exactly; the best stretch of
   the text around the place counts.

The benchmark is a table of known, checked size (``most_items`` rows, ``most_chars`` characters), indexed once and broadcast; the
documents are scanned in place and never shuffled.  Items of fewer than ``least_words`` words have no
edits and too few pairs; they are found by their exact word sequence.  Very long texts are searched whole, their windows block by block.
Null and wordless texts and items match nothing, items without an id are left out; a column of the name of the result is replaced.  Repeated rows are judged one by one, extra columns pass through; of stretches of equal distance the first one
wins.  Empty tables give no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import fresh_names, read_table

#: Scripts without spaces: kana, Han, Thai, Lao, Khmer, Myanmar.
UNSPACED = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
WORD = re.compile(rf"[^\W_{UNSPACED}]+|[{UNSPACED}]")
HITS = "array<struct<item_id: long, distance: int, item_words: int, start_word: int, end_word: int>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix) applied to ``x`` with a salt."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Coins:
    """The walk's random bits, by table and step an array over the word codes."""

    def __init__(self, n_codes: int):
        self.codes, self.known = np.arange(n_codes + 1), {}

    def __call__(self, table: int, step: int) -> np.ndarray:
        if (table, step) not in self.known:
            self.known[table, step] = (mix(self.codes, table * 4096 + step) & np.uint64(1)).astype(np.int64)
        return self.known[table, step]


def cgk_keys(codes: np.ndarray, starts: np.ndarray, length: int, positions: np.ndarray, table: int, coins: Coins) -> np.ndarray:
    """One 64-bit key per window of ``length`` words: the CGK walk's words at the sampled ``positions``.

    A walk that has left its window gives 0s, as do words outside the benchmark's vocabulary.  ``codes``
    go on for ``length`` words after the last start.
    """
    key = np.full(len(starts), table, dtype=np.uint64)
    at, end = starts.copy(), starts + length
    wanted = set(positions.tolist())
    for j in range(int(positions.max()) + 1):
        got = codes[at] if j < length else np.where(at < end, codes[np.minimum(at, end - 1)], 0)
        if j in wanted:
            key = mix(key ^ got.astype(np.uint64), 1)
        at += coins(table, j)[got]
    return key


def edit_distance(a: Sequence[int], b: Sequence[int], limit: int) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``b`` closest to ``a``; distance limit + 1 if none is within ``limit``.

    Semi-global alignment: leaving out words before and after the stretch costs nothing.  Of equal
    distances the earliest end wins, then the latest start.
    """
    n = len(b)
    row, origin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    other = np.asarray(b, dtype=np.int64)
    steps = np.arange(n + 1)
    for i, x in enumerate(a, 1):
        swap = row[:-1] + (other != x)
        drop = row[1:] + 1
        best = np.minimum(swap, drop)
        came = np.where(swap <= drop, origin[:-1], origin[1:])
        new = np.concatenate(([i], best))
        src = np.concatenate(([0], came))
        # insertions: new[j] = min over k <= j of new[k] + j - k
        base = new - steps
        run = np.minimum.accumulate(base)
        first = np.maximum.accumulate(np.where(base == run, steps, 0))
        row, origin = run + steps, src[first]
    end = int(row.argmin())
    return (int(row[end]), int(origin[end]), end) if row[end] <= limit else (limit + 1, 0, 0)


@dataclass(frozen=True)
class Item:
    item_id: int
    words: tuple[int, ...]
    edits: int


@dataclass(frozen=True)
class Index:
    """codes: benchmark word -> number from 1; parts: (item, offset, length) of each piece; pairs: sorted codes of
    word pairs by piece length; keys: (length, table) -> sorted keys and their pieces; short: length -> sorted keys and their items."""

    codes: dict[str, int]
    items: tuple[Item, ...]
    parts: tuple[tuple[int, int, int], ...]
    sizes: tuple[int, ...]
    edits: dict[int, int]
    pairs: dict[int, np.ndarray]
    all_pairs: np.ndarray
    keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
    positions: dict[tuple[int, int], np.ndarray]
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def tables_for(edits: int, bits: int, steps: int, recall: float) -> int:
    """Tables needed for a window ``edits`` away: each edit is taken to spoil four steps of the walk."""
    agree = max(0.05, 1.0 - min(0.95, 4.0 * edits / steps)) ** bits
    return max(4, int(np.ceil(np.log(1 - recall) / np.log(1 - agree + 1e-12))))


def pieces_of(n: int, most: int) -> list[tuple[int, int]]:
    """(offset, length) of the equal parts of ``n`` words, none longer than ``most``."""
    ends = [n * i // -(-n // most) for i in range(-(-n // most) + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def sequence_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """One number for each run of ``n`` words; 0 where a word is not of the benchmark."""
    at = np.arange(max(0, len(codes) - n + 1))
    key, known = np.full(len(at), n, dtype=np.uint64), np.ones(len(at), bool)
    for i in range(n):
        key = mix(key ^ codes[at + i].astype(np.uint64), 2)
        known &= codes[at + i] > 0
    return np.where(known, key | np.uint64(1), np.uint64(0))


def build_index(rows: list[tuple[int, str]], share: float = 0.2, bits: int = 4, recall: float = 0.99, least_words: int = 5, piece_words: int = 20, seed: int = 11) -> Index:
    codes: dict[str, int] = {}
    items = []
    for item_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        seq = tuple(codes.setdefault(w, len(codes) + 1) for w in words_of(text))
        if seq:
            items.append(Item(item_id, seq, int(share * len(seq)) if len(seq) >= least_words else 0))
    parts = [(k, a, n) for k, i in enumerate(items) if len(i.words) >= least_words for a, n in pieces_of(len(i.words), piece_words)]
    sizes = tuple(sorted({n for _, _, n in parts}))
    rng, pairs, keys, positions, coins = np.random.default_rng(seed), {}, {}, {}, Coins(len(codes))
    for m in sizes:
        own = [p for p, (_, _, n) in enumerate(parts) if n == m]
        seqs = [np.asarray(items[parts[p][0]].words)[parts[p][1] : parts[p][1] + m] for p in own]
        pairs[m] = np.unique(np.concatenate([pair_codes(x) for x in seqs]))
        for t in range(tables_for(int(share * m), bits, 2 * m, recall)):
            positions[m, t] = np.sort(rng.choice(max(bits, int(1.6 * m)), bits, replace=False))
            found = cgk_keys(np.concatenate(seqs), np.arange(len(own)) * m, m, positions[m, t], t, coins)
            order = np.argsort(found, kind="stable")
            keys[m, t] = found[order], np.asarray(own)[order]
    short = {}
    for m in sorted({len(i.words) for i in items if len(i.words) < least_words}):
        own = np.array([k for k, i in enumerate(items) if len(i.words) == m])
        found = np.array([sequence_keys(np.asarray(items[k].words), m)[0] for k in own])
        order = np.argsort(found, kind="stable")
        short[m] = found[order], own[order]
    every = np.unique(np.concatenate(list(pairs.values()))) if pairs else np.zeros(0, np.int64)
    return Index(codes, tuple(items), tuple(parts), sizes, {m: int(share * m) for m in sizes}, pairs, every, keys, positions, short)


def pair_codes(seq: np.ndarray) -> np.ndarray:
    """One number per neighbouring pair; 0 where a word is not of the benchmark."""
    a, b = seq[:-1].astype(np.int64), seq[1:].astype(np.int64)
    return np.where((a > 0) & (b > 0), (a << 32) | b, 0)


def places(pairs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each pair in the sorted ``known``; len(known) where it is not there."""
    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
    return np.where((known[at] == pairs) & (pairs > 0), at, len(known))


def running(hits: np.ndarray) -> np.ndarray:
    """Count of hits before each place, from 0."""
    return np.concatenate(([0], np.cumsum(hits)))


def pairs_needed(m: int, edits: int) -> int:
    return max(1, (m - 1) - 2 * edits)


def may_match(pairs: np.ndarray, index: Index) -> np.ndarray:
    """Starts of stretches of ``min size - 1`` pairs dense enough for a match of any size.

    A match of ``m`` words holds ``pairs_needed`` known pairs; cut into stretches of the shortest
    size, one of them holds at least its part.
    """
    span = index.sizes[0] - 1
    least = min(-(-pairs_needed(m, index.edits[m]) // -(-(m - 1) // span)) for m in index.sizes)
    total = running(places(pairs, index.all_pairs) < len(index.all_pairs))
    n = max(1, len(pairs) - span + 1)
    ends = np.minimum(np.arange(n) + span, len(pairs))
    return np.flatnonzero(total[ends] - total[:n] >= least)


def find_short(texts: list[np.ndarray], index: Index) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) -> (0, start, end) of the first exact occurrence of each item that is too short for windows."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for m, (found, own) in index.short.items():
        for d, codes in enumerate(texts):
            keys, starts = np.unique(sequence_keys(codes, m), return_index=True)
            lo, hi = np.searchsorted(found, keys, "left"), np.searchsorted(found, keys, "right")
            for w in np.flatnonzero(hi > lo):
                for k in own[lo[w] : hi[w]].tolist():
                    at = int(starts[w])
                    if tuple(codes[at : at + m].tolist()) == index.items[k].words:
                        best[d, k] = (0, at, at + m)
    return best


def find_in_batch(texts: list[np.ndarray], index: Index, block: int = 20_000) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text (word codes): (item_id, distance, item words, start, end) of the best stretch for each item within reach."""
    best = find_short(texts, index) | (find_long(texts, index, block) if index.sizes and texts else {})
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
    for (d, k), (dist, a, b) in best.items():
        out[d].append((index.items[k].item_id, dist, len(index.items[k].words), a, b))
    return [sorted(x) for x in out]


def find_long(texts: list[np.ndarray], index: Index, block: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) -> (distance, start, end) by windows, keys and alignment."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    ends = np.cumsum([len(t) + 1 for t in texts])
    joined = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.int64))] + [np.zeros(index.sizes[0], np.int64)])
    likely = np.unique(np.searchsorted(ends, may_match(pair_codes(joined), index), side="right"))
    likely = likely[likely < len(texts)]
    if not len(likely):
        return best
    gap = np.zeros(index.sizes[-1] + 1, np.int64)
    codes = np.concatenate([x for d in likely for x in (texts[d], gap)])
    begins = np.concatenate(([0], np.cumsum([len(texts[d]) + len(gap) for d in likely])))
    inside = np.concatenate([np.repeat((True, False), (len(texts[d]), len(gap))) for d in likely])
    at, coins = places(pair_codes(codes), index.all_pairs), Coins(len(index.codes))
    tried: set[tuple[int, int]] = set()  # (item, where it would start)
    for m in index.sizes:
        own_pairs = np.append(np.isin(index.all_pairs, index.pairs[m], assume_unique=True), False)
        total = running(own_pairs[at])
        starts = np.flatnonzero(total[m - 1 :] - total[: len(total) - m + 1] >= pairs_needed(m, index.edits[m]))
        starts = starts[inside[starts]]
        for first in range(0, len(starts), block):
            some = starts[first : first + block]
            t = 0
            while (m, t) in index.keys:
                found, own = index.keys[m, t]
                keys = cgk_keys(codes, some, m, index.positions[m, t], t, coins)
                lo, hi = np.searchsorted(found, keys, "left"), np.searchsorted(found, keys, "right")
                for w in np.flatnonzero(hi > lo):
                    d = int(np.searchsorted(begins, some[w], side="right")) - 1
                    for p in own[lo[w] : hi[w]].tolist():  # a piece near a text's begin is no further left than its item allows
                        k, offset, _ = index.parts[p]
                        tried.add((k, max(int(begins[d]), int(some[w]) - offset)))
                t += 1
    for k, first, last in merged(sorted(tried), index.items):
        d = int(np.searchsorted(begins, first, side="right")) - 1
        item, text = index.items[k], texts[likely[d]]
        lo = max(0, first - int(begins[d]) - item.edits)
        stretch = text[lo : last - int(begins[d]) + len(item.words) + item.edits]
        dist, a, b = edit_distance(item.words, stretch, item.edits)
        key = int(likely[d]), k
        if dist <= item.edits and (key not in best or (dist, lo + a) < best[key][:2]):
            best[key] = (dist, lo + a, lo + b)
    return best


def merged(tried: list[tuple[int, int]], items: Sequence[Item]) -> list[tuple[int, int, int]]:
    """(item, first, last) of runs of starts no more than the item's length apart."""
    out: list[list[int]] = []
    for k, s in tried:
        if out and out[-1][0] == k and s - out[-1][2] <= len(items[k].words):
            out[-1][2] = s
        else:
            out.append([k, s, s])
    return [(k, a, b) for k, a, b in out]


def load_items(benchmark: DataFrame, most_items: int, most_chars: int = 200_000_000) -> list[tuple[int, str]]:
    """The benchmark on the driver; refuses a table of more than ``most_items`` rows or ``most_chars`` characters."""
    known = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    n, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if n > most_items or chars > most_chars:
        raise ValueError(f"the benchmark has more than {most_items} items or {most_chars} characters; split it and run once for each part")
    return [(r["item_id"], r["text"]) for r in known.collect()]


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "hits", most_items: int = 100_000, rows_at_once: int = 1000, **settings) -> DataFrame:
    """Adds ``out``: the items found in each text, by item id; empty where there are none."""
    shared = docs.sparkSession.sparkContext.broadcast(build_index(load_items(benchmark, most_items), **settings))

    @F.pandas_udf(HITS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        code = index.codes.get
        names = ("item_id", "distance", "item_words", "start_word", "end_word")
        for batch in batches:
            found = []
            for first in range(0, len(batch), rows_at_once):
                texts = [np.fromiter((code(w, 0) for w in words_of(t)), np.int64) if isinstance(t, str) else np.zeros(0, np.int64) for t in batch.iloc[first : first + rows_at_once]]
                found += [[dict(zip(names, h, strict=True)) for h in hits] for hits in find_in_batch(texts, index)]
            yield pd.Series(found)

    # not deterministic for the optimizer: else a filter on the result would run the search twice
    return docs.withColumn(out, search.asNondeterministic()(F.col(text_col)))


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; the columns stay as they are."""
    (hits,) = fresh_names(docs, "hits")
    return with_hits(docs, read_table(spark, sf_dir, "benchmark"), out=hits).where(F.size(hits) == 0).select(*docs.columns)


def op7_decontamination(spark, sf_dir):
    """One row per document and benchmark item found in it; clean documents have none."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_hits(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES: dict[str, str] = {}
