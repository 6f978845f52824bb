"""Periodic runs against a brute force over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from claimledger.llm.word_runs import WINDOW, collapsed, find_runs, op12_word_runs, ranks, stretches, with_runs


def brute_runs(words, least=6, power=4):
    n, found = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                found.setdefault((i, j + q - i), q)  # smaller periods come first
            i = j
    return sorted((s, length, q) for (s, length), q in found.items() if length >= max(least, power * q))


def brute_row(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(150):
        letters = "ab" if rng.random() < 0.5 else "abcdefg"
        words = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 12)[: rng.randrange(1, 70)]
        texts.append([w.encode() for w in words])
    got = find_runs(texts)
    assert [sorted(r) for r in got] == [brute_runs(t) for t in texts]
    assert sum(map(len, got)) > 100


def test_long_periods_and_nesting():
    unit = [b"x"] * 8 + [b"w%d" % i for i in range(700)]
    text = [b"a", *unit * 5, b"z"]
    runs = find_runs([text, [], [b"q"] * 9000])
    assert (1, len(unit) * 5, len(unit)) in runs[0] and sum(q == 1 for _, _, q in runs[0]) == 5
    assert runs[1] == [] and runs[2] == [(0, 9000, 1)]
    assert collapsed(text, runs[0]) == b" ".join([b"a", b"x", *unit[8:], b"z"])
    assert collapsed([b"q"] * 9000, runs[2]) == b"q"


def test_stretches_hold_every_run():
    rng = random.Random(3)
    words = [rng.randrange(300) for _ in range(2000)]
    words[500:500] = [1, 2, 3] * 5
    codes = np.array(words)
    zero, end = np.zeros(len(codes), np.int64), np.full(len(codes), len(codes))
    cut = stretches(codes, zero, zero, end)
    assert any(a <= 500 and b >= 515 for a, b in cut) and sum(b - a for a, b in cut) < 200
    assert all(b - a >= 3 + WINDOW - 1 for a, b in cut)
    top = ranks(codes, end)[-1]
    assert [words[i:] for i in np.argsort(top)] == sorted(words[i:] for i in range(len(words)))


def test_op12_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = op12_word_runs(spark, sf).collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = {r["doc_id"] for r in docs if len(r["text"] or "") < 40_000}
    assert sorted(tuple(r[n] for n in names) for r in rows if r["doc_id"] in short) == sorted(brute_row(r["doc_id"], r["text"]) for r in docs if r["doc_id"] in short)
    assert len(rows) == len(docs) and sum(r["n_runs"] > 0 for r in rows) > 5


def test_op12_edges(spark, tmp_path):
    planted = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a b " * 4, "x"), (4, "a b " * 4, "x"), (None, "c " * 6, "x"), (planted, " ".join(f"w{i}" for i in range(200)), "x"), (planted, None, "x"), (9, "ab c " * 7, "x"), (11, "a " * 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[:8] for r in op12_word_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((brute_row(i, t) for i, t, _ in rows), key=repr)
    assert [(r["start"], r["length"], r["period"]) for r in with_runs(df.where("doc_id = 4"), out="hit").first()["hit"]["runs"]] == [(0, 8, 2)]
    assert "found" in with_runs(df, out="hit").columns and with_runs(df.limit(0), out="hit").count() == 0


def test_planted_tail_is_the_stated_one(spark, tmp_path):
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(1, 90)))) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[:8] for r in op12_word_runs(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(brute_row(i, t) for i, t in rows)
