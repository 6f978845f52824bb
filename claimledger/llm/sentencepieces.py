"""SentencePiece segmentations: Gumbel top-k sampling without replacement over the lattice, and decoding.

Every way to cut a text into pieces is a path of its lattice.  Piece weights are a Zipf law over the
vocabulary's ranks (a BPE vocabulary has ranks, not probabilities), a character without a piece falls
back to its bytes.  Pieces never run from a word into the next space, so the lattice is a chain of
word lattices; those are built once per distinct word and their backward masses make every step's
choice exact.

Sampling is the perturbed A* search: the best path carries the root's Gumbel value; at each of its
steps the branches not taken form an agenda entry whose value is a Gumbel of their mass, cut off at
the parent's value; the best entry is popped next, which gives the next distinct path, and so on.
The first value that is not emitted, ``kappa``, gives the inclusion score ``1 - exp(-exp(log_prob -
kappa))`` of each sample.  Random numbers are hashes of (seed, row key, place), so results depend
neither on batches nor on partitions (log probabilities do in their last digits); equal keys with equal
texts give equal samples.

Null texts count as empty; an empty text has one segmentation, of no pieces.  Texts with fewer than
``k`` segmentations give all they have, with inclusion 1.  A null key takes the random numbers of key 0.  Texts of any length
are cut whole, word by word; extra columns are left out of the samples; an empty table gives none.  Words are told apart by 63-bit
hashes; every sample is decoded and compared with its text, so that a collision would show in ``decodes``.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import free_heap, read_table

MODEL = os.environ.get("CLAIMLEDGER_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
WIDE = 12  #: steps per word that are kept in a matrix; longer words go on in lists
SAMPLES = "doc_id long, sample int, log_prob double, inclusion double, n_pieces int, pieces array<int>, decodes boolean"


class Vocabulary:
    """Pieces of a model file with their log weights; ids from ``size`` on stand for characters that fall back to bytes."""

    def __init__(self, path: str, zipf: float = 2.7, fallback: float = 10.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        usual = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.weights = np.full(self.size, -np.inf)
        self.weights[usual] = -np.log(np.arange(len(usual)) + zipf)
        self.weights -= np.logaddexp.reduce(self.weights[usual])
        self.fallback = float(self.weights[usual].min()) - fallback
        pieces = {model.id_to_piece(i): i for i in usual}
        self.pieces = pieces
        self._build_trie(pieces)
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [b""] * self.size
        for piece, i in pieces.items():
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        self.raw_len = np.array([len(x) for x in self.raw], dtype=np.int64)
        self.raw_start, self.blob = np.cumsum(self.raw_len) - self.raw_len, np.frombuffer(b"".join(self.raw), np.uint8)
        self.other: dict[str, int] = {}  # fallback characters met so far -> id
        self.spelled: list[list[int]] = []  # their byte pieces
        if crossing := [p for p in pieces if SPACE in p.lstrip(SPACE)]:
            raise ValueError(f"pieces run from a word into a space: {crossing[:3]}")

    def fallback_id(self, char: str) -> int:
        found = self.other.get(char)
        if found is None:
            found = self.other[char] = self.size + len(self.spelled)
            self.spelled.append([self.bytes[b] for b in char.encode("utf-8", "surrogatepass")])
        return found

    def spell(self, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all paths with the fallback characters as byte pieces, pieces per path)."""
        odd = np.flatnonzero(pieces >= self.size)
        if not len(odd):
            return pieces, sizes
        own = [self.spelled[p - self.size] for p in pieces[odd].tolist()]
        lengths = np.ones(len(pieces), np.int64)
        lengths[odd] = [len(x) for x in own]
        out = np.repeat(pieces, lengths)
        ends = np.append(0, np.cumsum(lengths))
        out[np.repeat(lengths > 1, lengths)] = [b for x in own if len(x) > 1 for b in x]
        out[ends[odd[lengths[odd] == 1]]] = [x[0] for x in own if len(x) == 1]
        at = np.append(0, np.cumsum(sizes))
        return out, np.diff(ends[at])

    def first_step(self, char: np.ndarray) -> np.ndarray:
        """States of the trie after a piece's first character, -1 where none starts so."""
        return self.starts[np.minimum(char, len(self.starts) - 1)]

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next states of the piece trie, -1 where no piece goes on so."""
        key = (state << 21) | char
        at = self._slot(key)
        got = self.trie[at]
        open_ = np.flatnonzero((got >> 20 != key) & (got >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.trie) - 1)
            got[open_] = self.trie[at[open_]]
            open_ = open_[(got[open_] >> 20 != key[open_]) & (got[open_] >= 0)]
        return np.where(got >= 0, got & 0xFFFFF, -1)

    def _slot(self, key):
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.trie_bits)).astype(np.int64)

    def _build_trie(self, pieces: dict[str, int]) -> None:
        """States are the beginnings of pieces; transitions (key and next state in one number) lie in an open-addressed table."""
        begins = sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)}, key=lambda p: (len(p), p))
        if len(begins) >= 1 << 20:
            raise ValueError("the vocabulary has too many beginnings of pieces")
        number = {"": 0} | {p: i + 1 for i, p in enumerate(begins)}
        self.state_piece = np.array([-1] + [pieces.get(p, -1) for p in begins])
        keys = np.array([(number[p[:-1]] << 21) | ord(p[-1]) for p in begins], dtype=np.int64)
        self.trie_bits = int(4 * len(keys)).bit_length()
        self.trie = np.full(1 << self.trie_bits, -1)
        for key, at, to in zip(keys.tolist(), self._slot(keys).tolist(), range(1, len(keys) + 1), strict=True):
            while self.trie[at] >= 0:
                at = (at + 1) & ((1 << self.trie_bits) - 1)
            self.trie[at] = key << 20 | to
        ones = [p for p in begins if len(p) == 1]
        self.starts = np.full(max(map(ord, ones), default=0) + 2, -1)  # the last place stands for all later characters
        self.starts[[ord(p) for p in ones]] = [number[p] for p in ones]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)



def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of the normalised texts, where their words start, words per text).

    A normalised text has a space in front and the piece mark for spaces; a word is a run of spaces with what
    follows it up to the next space.  An empty text has no words.
    """
    raw = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    space = raw == 32
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[begins[sizes > 0]] = True
    starts = np.flatnonzero(first)
    chars = raw.astype(np.int64)
    chars[space] = ord(SPACE)
    return chars, starts, np.diff(np.searchsorted(starts, np.append(begins, len(raw))))


class WordTable:
    """Open-addressed table from 64-bit word hashes to roots; 0 marks a free place."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int) -> None:
        self.bits, self.keys, self.roots, self.used = bits, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Roots of the hashes, -1 where they are unknown."""
        at = self._slots(h)
        got = self.keys[at]
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            got[open_] = self.keys[at[open_]]
            open_ = open_[(got[open_] != h[open_]) & (got[open_] != 0)]
        return np.where(got == h, self.roots[at], -1)

    def insert(self, h: np.ndarray, roots: np.ndarray) -> None:
        """Adds hashes that are not there yet, each once."""
        if self.used + len(h) > len(self.keys) // 2:
            known = self.keys != 0
            old = self.keys[known], self.roots[known]
            self.clear(int(4 * (self.used + len(h))).bit_length())
            self.insert(*old)
        self.used += len(h)
        at = self._slots(h)
        while len(h):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = h[free]  # of several at one place the last one stays
            won = free[self.keys[at[free]] == h[free]]
            self.roots[at[won]] = roots[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, roots, at = h[rest], roots[rest], (at[rest] + 1) & (len(self.keys) - 1)


class Lattices:
    """Lattices of all words met so far, as one table of edges; node 0 is the end of every word.

    ``first[node]`` is the node's first edge; edges of a node stand by falling length.  ``p`` is an edge's
    probability, ``upto`` the running one, ``rest`` that of the node's other edges.
    """

    def __init__(self, vocab: Vocabulary, most_edges: int = 2_000_000):
        self.vocab, self.most_edges = vocab, most_edges
        self.words, self.power, self.inverse = WordTable(), np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.hashes, self.begins, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the words, in the order of their roots
        self.nodes, self.edges = 1, 0
        self.first, self.again = np.zeros(2, np.int64), np.zeros(2, bool)
        self.piece, self.target = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.upto, self.p, self.rest = np.zeros(0), np.zeros(0), np.zeros(0)

    def tidy(self) -> bool:
        """Between blocks: when the tables have grown past their bound, only words met again since the last time stay.

        They move to the front of the tables, whose memory is used again.  True if that was done.
        """
        if self.edges <= self.most_edges:
            return False
        kept = np.flatnonzero(self.again[self.begins])
        per_word = self.first[self.begins[kept] + self.lengths[kept]] - self.first[self.begins[kept]]
        kept = kept[: int(np.searchsorted(np.cumsum(per_word), self.most_edges // 2, side="right"))]
        old, lengths, per_word = self.begins[kept], self.lengths[kept], per_word[: len(kept)]
        new = 1 + np.cumsum(lengths) - lengths
        node = np.repeat(old - new, lengths) + np.arange(1, 1 + int(lengths.sum()))
        edge_end = np.cumsum(per_word)
        edge = np.repeat(self.first[old] - (edge_end - per_word), per_word) + np.arange(int(per_word.sum()))
        sizes = self.first[node + 1] - self.first[node]
        target = self.target[edge]
        target = np.where(target == 0, 0, target - np.repeat(old - new, per_word))
        self.target[: len(edge)] = target
        del target
        for name in ("piece", "upto", "p", "rest"):
            column = getattr(self, name)
            column[: len(edge)] = column[edge]
        self.first[1] = 0
        self.first[2 : len(node) + 2] = np.cumsum(sizes)
        self.again[:] = False
        self.hashes, self.begins, self.lengths = self.hashes[kept], new, lengths
        self.words.clear(16)
        self.words.insert(self.hashes, new)
        self.nodes, self.edges = 1 + len(node), len(edge)
        return True

    def _raw_edges(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges per character, pieces, lengths): all pieces that start at each character, longest first."""
        v = self.vocab
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))
        at, state, n, found = np.arange(len(chars)), None, 0, []
        while len(at):
            state = v.step(state, chars[at + n]) if n else v.first_step(chars)
            n += 1
            piece = np.where(state >= 0, v.state_piece[state], -1)
            if n == 1:
                for c in np.unique(chars[at[piece < 0]]).tolist():
                    piece[(chars == c) & (piece < 0)] = v.fallback_id(chr(c))
            hit = piece >= 0
            found.append((at[hit], piece[hit]))
            on = (state >= 0) & (left[at] > n)
            at, state = at[on], state[on]
        per_node = np.bincount(np.concatenate([a for a, _ in found]), minlength=len(chars))
        fill = np.append(0, np.cumsum(per_node))[:-1].copy()
        pieces, longs = np.empty(per_node.sum(), np.int64), np.empty(per_node.sum(), np.int64)
        for n in range(len(found), 0, -1):
            a, piece = found[n - 1]
            pieces[fill[a]], longs[fill[a]] = piece, n
            fill[a] += 1
        return per_node, pieces, longs

    def add(self, hashes: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> None:
        """Builds the lattices of words: beta of a node is the log mass of all cuts from there to the word's end."""
        per_node, piece, long = self._raw_edges(chars, lengths)
        n, m = len(per_node), len(piece)
        start = np.append(0, np.cumsum(per_node))
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)  # characters from the node to the word's end
        source = np.repeat(np.arange(n), per_node)
        target = np.where(long == left[source], n, source + long)
        weight = np.full(m, self.vocab.fallback)
        usual = piece < self.vocab.size
        weight[usual] = self.vocab.weights[piece[usual]]
        beta, p = np.zeros(n + 1), np.empty(m)
        by_level = np.argsort(left.astype(np.int16) if left.max() < 2**15 else left, kind="stable")
        for nodes in np.split(by_level, np.cumsum(np.bincount(left)[1:])[:-1]):
            if len(nodes):
                sizes = per_node[nodes]
                ends = np.cumsum(sizes)
                e = np.arange(ends[-1]) + np.repeat(start[nodes] - (ends - sizes), sizes)
                begins, own = ends - sizes, np.repeat(np.arange(len(nodes)), sizes)
                mass = weight[e] + beta[target[e]]
                top = np.maximum.reduceat(mass, begins)
                mass = np.exp(mass - top[own])
                total = np.add.reduceat(mass, begins)
                p[e] = mass / total[own]
                beta[nodes] = top + np.log(total)
        p[per_node[source] == 1] = 1.0
        run = np.cumsum(p)
        upto = run - np.repeat(np.append(0.0, run)[start[:-1]], per_node)
        upto[start[1:] - 1] = 2.0
        sure = p > 0.5
        rest = 1.0 - p
        rest[sure] = np.add.reduceat(np.where(sure, 0.0, p), start[:-1])[source[sure]]
        self._append(start[1:], piece, np.where(target == n, 0, target + self.nodes), upto, p, rest)
        begins = self.nodes + np.cumsum(lengths) - lengths
        self.words.insert(hashes, begins)
        self.hashes, self.begins, self.lengths = np.append(self.hashes, hashes), np.append(self.begins, begins), np.append(self.lengths, lengths)
        self.nodes += n
        self.edges += m

    def _append(self, ends, *columns) -> None:
        names, m = ("piece", "target", "upto", "p", "rest"), self.edges + len(columns[0])
        for name, values in zip(names, columns, strict=True):
            old = getattr(self, name)
            if len(old) < m:
                grown = np.empty(max(m, len(old) + len(old) // 2), old.dtype)
                grown[: self.edges] = old[: self.edges]
                setattr(self, name, old := grown)
            old[self.edges : m] = values
        nodes = self.nodes + len(ends)
        if len(self.first) < nodes + 1:
            grown, again = np.empty(2 * (nodes + 1), np.int64), np.zeros(2 * (nodes + 1), bool)
            grown[: self.nodes + 1], again[: self.nodes] = self.first[: self.nodes + 1], self.again[: self.nodes]
            self.first, self.again = grown, again
        self.first[self.nodes] = self.edges
        self.first[self.nodes + 1 : nodes + 1] = self.edges + ends

    def _hash(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash per word, never 0: its characters' codes as a polynomial, shifted to the word's start, and its length."""
        prime = 0x9E3779B97F4A7C15
        while len(self.power) < len(chars) + 1:
            for name, base in (("power", prime), ("inverse", pow(prime, -1, 2**64))):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, old * np.uint64(pow(base, len(old), 2**64))]))
        with np.errstate(over="ignore"):
            code = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            code = (code ^ (code >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            run = np.append(np.uint64(0), np.cumsum(code * self.power[: len(chars)]))
            z = (run[ends] - run[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) | np.uint64(1)

    def roots_of(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The words' roots; words met for the first time are added.  Words are told apart by 63-bit hashes."""
        ends = np.append(starts[1:], len(chars))
        h = self._hash(chars, starts, ends)
        found = self.words.find(h)
        self.again[found[found > 0]] = True
        late = np.flatnonzero(found < 0)
        if len(late):
            new, one = np.unique(h[late], return_index=True)
            one = late[one]
            lengths = ends[one] - starts[one]
            upto = np.cumsum(lengths)
            self.add(new, chars[np.repeat(starts[one] - (upto - lengths), lengths) + np.arange(upto[-1])], lengths)
            found[late] = self.words.find(h[late])
        return found

    def tables(self) -> tuple[np.ndarray, ...]:
        m = self.edges
        return self.first[: self.nodes + 1], self.piece[:m], self.target[:m], self.upto[:m], self.p[:m], self.rest[:m]


def uniform(seed: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1): hashes of a seed and a place."""
    with np.errstate(over="ignore"):
        z = seed + np.asarray(place, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def derive(seed: np.ndarray, salt: int) -> np.ndarray:
    return (uniform(seed, salt) * 2.0**62).astype(np.uint64)


def walk(tables, starts: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples a path from each start node: (edges of all paths in order, edges per path)."""
    first, _, target, upto, _, _ = tables
    n = len(starts)
    grid = np.full((n, WIDE), -1, dtype=np.int32)
    at, alive, step = starts.copy(), np.flatnonzero(starts != 0), 0
    late: dict[int, list[int]] = {}
    while len(alive):
        edge = first[at[alive]]
        u = uniform(seeds[alive], step)
        more = np.flatnonzero(u >= upto[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] >= upto[edge[more]]]
        if step < WIDE:
            grid[alive, step] = edge
        else:
            for a, e in zip(alive.tolist(), edge.tolist(), strict=True):
                late.setdefault(a, []).append(e)
        at[alive] = target[edge]
        alive = alive[at[alive] != 0]
        step += 1
    used = grid >= 0
    count, flat = used.sum(axis=1), grid[used].astype(np.int64)
    if late:
        who = np.array(sorted(late))
        flat = np.insert(flat, np.repeat(np.cumsum(count)[who], [len(late[a]) for a in who]), np.concatenate([late[a] for a in who]))
        count[who] += [len(late[a]) for a in who]
    return flat, count


class Entry:
    """An agenda entry of one text: the branches that leave ``path`` at token ``t`` and are not in ``taken``."""

    __slots__ = ("gumbel", "path", "t", "taken")

    def __init__(self, gumbel: float, path: int, t: int, taken: tuple[int, ...]):
        self.gumbel, self.path, self.t, self.taken = gumbel, path, t, taken

    def __lt__(self, other: Entry) -> bool:
        return self.gumbel > other.gumbel


def branch_values(tables, edges: np.ndarray, prefix: np.ndarray, log_tau: np.ndarray, seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Gumbel values of the branches not taken at each step, cut off at the value of the path's own.

    In arrival times ``exp(-gumbel)``: the path's time plus an exponential of the branches' mass.
    """
    with np.errstate(divide="ignore"):
        late = np.log(-np.log(uniform(seeds, places))) - (prefix + np.log(tables[5][edges]))
    return -np.logaddexp(log_tau, late)


def sample_batch(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[float, float, np.ndarray]]]:
    """For each text up to ``k`` samples (log_prob, inclusion, piece ids), best perturbed value first."""
    chars, starts, owner_len = split_words(texts)
    roots = lattices.roots_of(chars, starts)
    tables = lattices.tables()
    row = np.repeat(np.arange(len(texts)), owner_len)
    word_at = np.append(0, np.cumsum(owner_len))
    place = np.arange(len(roots)) - word_at[row] if len(roots) else roots
    edges, count = walk(tables, roots, derive(keys, 1)[row] + place.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    token_word = np.repeat(np.arange(len(roots)), count)
    token_row = row[token_word] if len(roots) else token_word
    token_at = np.append(0, np.cumsum(np.bincount(token_row, minlength=len(texts))))
    logp = np.log(tables[4][edges])
    run = np.cumsum(logp)
    base = np.append(0.0, run)[token_at[:-1]]
    prefix = run - logp - base[token_row]
    log_tau = np.log(-np.log(uniform(derive(keys, 2), 0)))
    values = branch_values(tables, edges, prefix, log_tau[token_row], derive(keys, 3)[token_row], np.arange(len(edges)) - token_at[token_row])

    searches = []
    for r in range(len(texts)):
        lo, hi = token_at[r], token_at[r + 1]
        total = float(prefix[hi - 1] + logp[hi - 1]) if hi > lo else 0.0
        searches.append(one := Search([(edges[lo:hi], token_word[lo:hi], prefix[lo:hi], total)], [], int(word_at[r + 1])))
        one.push(0, values[lo:hi], 0, k)
    for n in range(1, k):
        next_paths(tables, roots, word_at, searches, keys, n, k)
    return [s.samples(tables[1], k) for s in searches]


class Search:
    """The perturbed A* search of one text: its paths so far (edges, their words, prefix log probabilities, total) and its agenda."""

    __slots__ = ("paths", "agenda", "word_end")

    def __init__(self, paths: list, agenda: list[Entry], word_end: int):
        self.paths, self.agenda, self.word_end = paths, agenda, word_end

    def push(self, path: int, values: np.ndarray, offset: int, k: int) -> None:
        """Only the best ``k + 1`` entries of a path can be popped."""
        best = np.argpartition(-values, k)[: k + 1] if len(values) > k + 1 else np.arange(len(values))
        for t in best.tolist():
            if values[t] > -np.inf:
                heapq.heappush(self.agenda, Entry(float(values[t]), path, t + offset, (int(self.paths[path][0][t + offset]),)))

    def samples(self, piece: np.ndarray, k: int) -> list[tuple[float, float, np.ndarray]]:
        """kappa is the best value that was not popped."""
        kappa = self.agenda[0].gumbel if self.agenda and len(self.paths) == k else -np.inf
        return [(lp, 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(50.0, lp - kappa)))), piece[e]) for e, _, _, lp in self.paths]


def next_paths(tables, roots, word_at, searches: list[Search], keys: np.ndarray, n: int, k: int) -> None:
    """Pops the best entry of every agenda and completes it: the n-th path of each text that has one."""
    first, _, target, _, prob, _ = tables
    salt = 16 * n
    u_pick, u_rest, seeds, u_seed = derive(keys, salt), derive(keys, salt + 2), derive(keys, salt + 1), derive(keys, salt + 3)
    rows = [r for r, s in enumerate(searches) if s.agenda and len(s.paths) == n]
    if not rows:
        return
    popped = [heapq.heappop(searches[r].agenda) for r in rows]
    at = np.array([e.t for e in popped])
    wants, lates = uniform(u_pick[rows], at).tolist(), np.log(-np.log(uniform(u_rest[rows], at))).tolist()
    left = np.array([searches[r].paths[e.path][0][e.t] for r, e in zip(rows, popped, strict=True)])
    nodes = np.searchsorted(first, left, side="right") - 1
    picks, starts, offsets = [], [], []
    for r, e, lo, hi, want, late in zip(rows, popped, first[nodes].tolist(), first[nodes + 1].tolist(), wants, lates, strict=True):
        s = searches[r]
        _, words, prefix, _ = s.paths[e.path]
        free = [x for x in range(lo, hi) if x not in e.taken]
        mass = prob[free].tolist()
        want, pick, run = want * sum(mass), free[-1], 0.0
        for x, p in zip(free, mass, strict=True):
            run += p
            if want < run:
                pick = x
                break
        others = sum(p for x, p in zip(free, mass, strict=True) if x != pick)
        if others > 0.0:  # the branches still not taken there
            heapq.heappush(s.agenda, Entry(float(-np.logaddexp(-e.gumbel, late - float(prefix[e.t]) - log(others))), e.path, e.t, (*e.taken, pick)))
        word = int(words[e.t])
        picks.append(pick)
        # the rest of the word from the branch, then all later words anew
        starts.append(np.append(np.int64(target[pick]), roots[word + 1 : s.word_end]))
        offsets.append(word - word_at[r])
    sizes = np.array([len(x) for x in starts])
    owner = np.repeat(np.arange(len(rows)), sizes)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(owner)) - begin[owner] + np.array(offsets)[owner]
    chosen = np.array(rows)
    tail, count = walk(tables, np.concatenate(starts), seeds[chosen][owner] + place.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    token_owner = np.repeat(owner, count)
    token_word = np.repeat(np.arange(len(owner)) - begin[owner], count)
    at = np.append(0, np.cumsum(np.bincount(token_owner, minlength=len(rows))))
    old = np.array([searches[r].paths[e.path][2][e.t] for r, e in zip(rows, popped, strict=True)]) + np.log(prob[picks])
    tail_logp = np.log(prob[tail])
    run = np.cumsum(tail_logp)
    prefix = run - tail_logp + (old - np.append(0.0, run)[at[:-1]])[token_owner]
    t = np.array([e.t for e in popped])
    gumbel = np.array([e.gumbel for e in popped])
    values = branch_values(tables, tail, prefix, -gumbel[token_owner], u_seed[chosen][token_owner], np.arange(len(tail)) - at[token_owner] + t[token_owner] + 1)
    for i, r in enumerate(rows):
        s, e, word, lo, hi = searches[r], popped[i], offsets[i] + word_at[r], at[i], at[i + 1]
        edges, words, before, _ = s.paths[e.path]
        total = float(prefix[hi - 1] + tail_logp[hi - 1]) if hi > lo else float(old[i])
        s.paths.append((np.concatenate((edges[: e.t], [picks[i]], tail[lo:hi])), np.concatenate((words[: e.t], [word], token_word[lo:hi] + word)), np.concatenate((before[: e.t + 1], prefix[lo:hi])), total))
        if hi > lo:
            s.push(n, values[lo:hi], e.t + 1, k)


def raw_bytes(pieces: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all pieces in order, end of each piece in them)."""
    sizes = vocab.raw_len[pieces]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return vocab.blob[np.repeat(vocab.raw_start[pieces] - (ends - sizes), sizes) + np.arange(total)], ends


def decode(pieces, vocab: Vocabulary) -> str:
    """The text of piece ids; the leading space of the first piece goes."""
    raw = b"".join(map(vocab.raw.__getitem__, pieces.tolist() if hasattr(pieces, "tolist") else pieces))
    return raw.decode("utf-8", "replace")[1:] if raw[:1] == b" " else raw.decode("utf-8", "replace")


def segment_batches(batches: Iterator[pa.RecordBatch], k: int, seed: int, model: str, block_chars: int) -> Iterator[pa.RecordBatch]:
    """``SAMPLES`` rows of a task's (key, text) batches; the worker then keeps the vocabulary and no word lattice."""
    vocab = vocabulary(model)
    lattices = Lattices(vocab)

    def flush(ids: list, texts: list[str]) -> pa.RecordBatch:
        plain = np.array([0 if i is None else i for i in ids], dtype=np.int64).view(np.uint64)
        keys = derive(plain ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)), 7)
        cols: tuple[list, ...] = ([], [], [], [], [], [])
        wanted: list[bytes] = []
        for i, text, samples in zip(ids, texts, sample_batch(lattices, texts, keys, k), strict=True):
            raw = f" {text}".encode("utf-8", "surrogatepass") if text else b""
            for s, (lp, inc, found) in enumerate(samples):
                for c, x in zip(cols, (i, s, lp, inc, len(found), found), strict=True):
                    c.append(x)
                wanted.append(raw)
        if lattices.tidy():
            free_heap()
        flat, sizes = vocab.spell(np.concatenate(cols[5]), np.array(cols[4], dtype=np.int64))
        at = np.append(0, np.cumsum(sizes)).astype(np.int32)
        flat = flat.astype(np.int32)
        got, ends = raw_bytes(flat, vocab)
        cuts = np.append(0, ends)[at].tolist()
        decodes = [got[lo:hi].tobytes() == raw for lo, hi, raw in zip(cuts, cuts[1:], wanted, strict=False)]
        types = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32())
        arrays = [pa.array(c, t) for c, t in zip((*cols[:4], sizes), types, strict=True)]
        arrays += [pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(decodes, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SAMPLES.split(", ")])

    try:
        for batch in batches:
            ids, texts, size = [], [], 0
            for first in range(0, batch.num_rows, 500):
                some = batch.slice(first, 500)
                for i, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(text or "")
                    size += len(texts[-1])
                    if size >= block_chars:
                        yield flush(ids, texts)
                        ids, texts, size = [], [], 0
            if ids:
                yield flush(ids, texts)
    finally:
        del lattices
        free_heap()


def sample_segmentations(docs: DataFrame, k: int = 2, seed: int = 5, model: str = MODEL, key_col: str = "doc_id", text_col: str = "text", block_chars: int = 300_000) -> DataFrame:
    """``SAMPLES`` rows, up to ``k`` per document; ``model`` is a path that every executor can read."""

    return docs.select(F.col(key_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: segment_batches(batches, k, seed, model, block_chars), SAMPLES)


def decode_column(df: DataFrame, pieces_col: str, out: str, model: str = MODEL) -> DataFrame:
    """Adds the text of an array of piece ids (null: null)."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(model)
        for batch in batches:
            yield batch.map(lambda x: None if x is None else decode(x, vocab)).astype(object)

    return df.withColumn(out, texts(F.col(pieces_col)))


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the kept documents' sampled segmentations."""
    return sample_segmentations(docs)


def op5_sentencepieces(spark, sf_dir):
    return sample_segmentations(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_sentencepieces": op5_sentencepieces}
ORACLES: dict[str, str] = {}
