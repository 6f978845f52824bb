"""Hard negatives against brute force over all pairs, the intervals themselves, odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimledger.llm.hard_negatives import ORACLES, Anchors, encode, mine, op13_hard_negatives, planes, products, rotation, search, surviving


def brute(rows, is_anchor, n_positives=5, n_negatives=10):
    """rows: (vec_id, label, components)."""
    ok = [(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors, out = {}, []
    for r in sorted(ok, key=lambda r: (r[1], r[2]), reverse=True):
        anchors[r[0]] = r
    for i, lab, v in anchors.values():
        if not is_anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in ok if j != i and len(w) == len(v)))
        for s, j in dict.fromkeys((-s, j) for s, j in [(s, j) for s, j, other in scored if other == lab][:n_positives]):
            negative = [(j2, -s2) for s2, j2, other in scored if other != lab and 30 * s <= -100 * s2 <= 90 * s][:n_negatives]
            out += [(i, j, k + 1, j2, s, s2) for k, (j2, s2) in enumerate(negative)]
    return sorted(out)


def vectors(rng, n, size=64, labels=3):
    centres = rng.standard_normal((6, size))
    rows = []
    for i in range(n):
        x = centres[i % 6] + 0.7 * rng.standard_normal(size)
        rows.append((i, int(rng.integers(labels)), (x / np.linalg.norm(x)).astype(np.float32).tolist()))
    return rows


@pytest.mark.parametrize("size", [1, 7, 64, 100])
def test_intervals_hold_every_score(size):
    rng = np.random.default_rng(size)
    x, q = rng.integers(-300, 300, (200, size)), rng.integers(-300, 300, (30, size))
    assert np.allclose(rotation(size) @ rotation(size).T, np.eye(size))
    bits, aligned, left = encode(x, 4)
    assert (np.diff(left, axis=1) <= 1e-9).all() and (left[:, 0] < np.sqrt((x * x).sum(axis=1)) + 1e-9).all()
    p = planes(q)
    turned = (q @ rotation(size)) @ np.where(np.unpackbits(bits[:, 0].view(np.uint8).reshape(200, -1), axis=1, bitorder="little")[:, :size], 1, -1).T / np.sqrt(size)
    got = products(p, np.arange(30)[:, None], bits[None, :, 0], size)
    assert (np.abs(got - turned) <= p.left[:, None] + 1e-6).all()
    rows = {"vector": x, "bits": bits, "aligned": aligned, "left": left, "length": np.sqrt((x * x).sum(axis=1).astype(float))}
    anchors = Anchors(np.arange(30), np.zeros(30, int), q, p, np.zeros((30, 1), int), np.zeros((30, 1), int), None, None)
    exact = q @ x.T
    floor, top = np.quantile(exact, 0.99, axis=1), np.quantile(exact, 0.995, axis=1)
    a, i = surviving(anchors, slice(0, 30), floor, top, rows, np.ones((30, 200), bool))
    kept = set(zip(a.tolist(), i.tolist(), strict=True))
    inside = set(zip(*(z.tolist() for z in np.nonzero((exact >= floor[:, None]) & (exact <= top[:, None]))), strict=True))
    assert inside <= kept and (size < 50 or len(kept) < 0.5 * 30 * 200)


def test_search_keeps_the_best_over_blocks():
    rng = np.random.default_rng(2)
    x = rng.integers(-20, 20, (900, 16))
    x[300:600] = x[300]
    label, ids = rng.integers(0, 2, 900), rng.permutation(900)
    bits, aligned, left = encode(x, 2)
    own = np.arange(0, 900, 90)
    n = len(own)
    anchors = Anchors(ids[own], label[own], x[own], planes(x[own]), np.full((n, 1), -(2**62)), np.full((n, 1), 2**62), np.zeros((n, 1), int), np.zeros((n, 1), int))
    blocks = [{"id": ids[s], "label": label[s], "vector": x[s], "bits": bits[s], "aligned": aligned[s], "left": left[s], "length": np.sqrt((x[s] ** 2).sum(axis=1).astype(float))} for s in (slice(0, 400), slice(400, 401), slice(401, 900))]
    best = search(anchors, iter(blocks), 7, False, pairs_at_once=1500)
    for k, a in enumerate(own):
        want = sorted((-int(x[a] @ x[j]), int(ids[j])) for j in range(900) if label[j] != label[a])[:7]
        assert [(-s, i) for s, i in zip(best.score[k].tolist(), best.id[k].tolist(), strict=True)] == want


def test_mining_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = vectors(rng, 500)
    rows += [(1000 + i, 1, rows[100][2]) for i in range(60)] + [(2000 + i, 2, [0.0] * 64) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    for settings in ({}, {"anchors_at_once": 3, "levels": 1}, {"levels": 2, "rows_a_task": 50}):
        got = sorted(tuple(r) for r in mine(df, F.col("vec_id") % 50 == 0, **settings).collect())
        assert got == brute(rows, lambda i: i % 50 == 0) and len(got) > 300


def test_mining_edges(spark):
    rng = random.Random(4)
    vec = lambda n: [rng.uniform(0, 1) for _ in range(n)]
    rows = [(i, rng.randrange(3), vec(8)) for i in range(60)]
    rows += [(0, 1, rows[0][2]), (5, 1, rows[5][2]), (5, 1, rows[5][2]), (7, 2, rows[7][2]), (None, 1, vec(8)), (61, None, vec(8)), (62, 1, None), (63, 1, [float("nan")] * 8), (64, 1, [float("inf"), *vec(7)]), (65, 1, [None, *vec(7)]), (66, 1, []), (100, 1, vec(3)), (101, 1, vec(3)), (102, 2, vec(3)), (200, 9, vec(5)), (300, 9, vec(8))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, anchor string, size int")
    got = sorted(tuple(r) for r in mine(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute(rows, lambda i: i % 20 == 0) and len(got) > 50
    huge = spark.createDataFrame([(0, 1, [1e30] * 4), (1, 1, [1.0] * 4), (2, 2, [0.5] * 4), (100, 1, [1.0] * 4)], "vec_id long, label int, embedding array<float>")
    assert [tuple(r) for r in mine(huge, F.col("vec_id") % 100 == 0).collect()] == [(100, 1, 1, 2, 4 * 256 * 256, 2 * 256 * 256)]
    assert mine(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0 and mine(df, F.lit(False)).count() == 0


def test_op13_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    r = con.sql(ORACLES["op13_hard_negatives"])
    got = op13_hard_negatives(spark, sf)
    assert sorted(got.columns) == sorted(r.columns)
    assert sorted(tuple(x[c] for c in r.columns) for x in got.collect()) == sorted(r.fetchall())
    assert got.count() > 100
