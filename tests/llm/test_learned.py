"""Toxicity and quality classifiers, decontamination, SentencePiece sampling, Jaccard join, pipeline."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimledger.llm import decontamination, jaccard_join, quality_pu, sentencepieces, toxicity
from claimledger.llm.common import held_out
from tests.llm.test_filters import same_as_sql

BIG = "/root/testdata/sf0.1"


def auc(rows, target):
    pos, neg = [r.score for r in rows if r[target] == 1], [r.score for r in rows if r[target] == 0]
    ranks = np.argsort(np.argsort(np.array(pos + neg), kind="stable"), kind="stable")[: len(pos)]
    return (ranks.sum() - len(pos) * (len(pos) - 1) / 2) / (len(pos) * len(neg))


def scored(spark, query):
    out = query(spark, BIG)
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert out.count() == spark.read.parquet(f"{BIG}/documents.parquet").count() and all(0 <= r.score <= 1 for r in rows)
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = scored(spark, toxicity.op8_toxicity)
    assert auc(rows, "toxic") > 0.9 and all(r.predicted == (r.score >= 0.3) for r in rows)
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)


def test_quality_on_held_out_rows(spark):
    rows = scored(spark, quality_pu.op3_quality_pu)
    assert auc(rows, "quality") > 0.97 and all(r.predicted == (r.score >= 0.7) for r in rows)
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in good) >= 0.97 * len(good)


def test_toxicity_reads_whole_training_texts(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]
    rows = []
    for i in range(240):
        words = rng.choices(vocab, k=rng.choice((40, 200)) if i % 3 == 0 else rng.randint(1600, 3000))
        if i % 3 == 1:  # every insult stands behind word 1,500
            at = rng.randint(1520, len(words))
            words[at:at] = [rng.choice(("stinkhorn", "stinkhorns", "stinker")) for _ in range(6)]
        rows.append((i, " ".join(words), int(i % 3 == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    labels = docs.select("doc_id", "toxic")
    got = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs.select("doc_id", "text"), labels)).where(held_out(F.col("doc_id"))).collect()
    long = [r for r in got if len(r.text.split()) > 1500]
    bad, good = [r.predicted for r in long if r.toxic], [r.predicted for r in long if not r.toxic]
    assert len(bad) > 10 and len(good) > 10 and sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.1 * len(good)
    # less room takes rows away, never a part of a text
    some = toxicity.whole_texts(docs.select("doc_id", "text"), labels, 1, 100, 50_000)
    assert 1 < len(some) < 10 and set(some) <= {t for _, t, _ in rows}


def test_toxicity_sees_misspellings():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]
    doc = lambda bad: " ".join(rng.choices(vocab, k=60) + ([rng.choice(("stinkhorn", "stinkhorns", "stinker"))] * 2 if bad else []))
    y = [i % 2 for i in range(300)]
    w, b = toxicity.fit([doc(v) for v in y], y)
    logits = toxicity.WordLogits(toxicity.ToxicModel(w, b, 16, 24, 1.0, 0.0))
    bad, good = toxicity.worst_segments(["stinkhornz " + doc(0)], logits)[0], toxicity.worst_segments([doc(0)], logits)[0]
    assert bad > good + 1


def test_scorers_take_odd_texts(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, " \n", 5.0), (4, "!!! ???", 5.0), (5, "x" * 100_000, 5.0), (5, "x" * 100_000, 5.0)], "doc_id long, text string, score double")
    m = toxicity.ToxicModel(np.zeros(1 << 16), -4.0, 16, 24, 1.0, 0.0)
    assert [r.predicted for r in toxicity.score_toxicity(df, m).collect()] == [0] * 6
    q = quality_pu.PuModel(tuple(() for _ in range(quality_pu.N_FEATURES)), np.zeros(quality_pu.N_FEATURES), 4.0, 0.9)
    assert [r.predicted for r in quality_pu.score_quality(df, q).collect()] == [1] * 6
    assert toxicity.score_toxicity(df.limit(0), m).count() == quality_pu.score_quality(df.limit(0), q).count() == 0


def brute_toxic(text, m):
    """Score of a text from the model's weights alone, word by word."""
    words = toxicity.distinct_runs(text)
    z = []
    for w in words:
        bucket, _ = toxicity.subword_table([w], m.bits)
        z.append(sum(m.weights[b] for b in bucket) / len(bucket))
    starts = list(range(0, len(z), m.segment))
    if len(starts) > 1 and len(z) - starts[-1] < (m.segment + 1) // 2:
        starts.pop()
    parts = [z[a:b] for a, b in zip(starts, [*starts[1:], len(z)], strict=True)]
    worst = m.bias + (m.segment * max(sum(p) / len(p) for p in parts) if z else 0.0)
    return 1 / (1 + math.exp(-(m.slope * worst + m.offset)))


def test_scores_against_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    m = toxicity.train_toxicity(docs, labels)
    got = toxicity.op8_toxicity(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r.score - brute_toxic(texts[r.doc_id], m)) < 1e-6 and r.predicted == (r.score >= 0.3)
    q = quality_pu.train_quality(docs, labels)
    for r in quality_pu.op3_quality_pu(spark, sf).collect():
        z = q.bias
        at = 0
        for x, cuts in zip(quality_pu.text_features(texts[r.doc_id]), q.cuts, strict=True):
            z += q.weights[at + sum(x > c for c in cuts)]
            at += len(cuts) + 1
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.7)


def test_too_few_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(12)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 0) for i in range(12)], none.schema)
    for labels in (none, one):
        got = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()
        assert len({r.score for r in got}) == 1 and {r.predicted for r in got} == {0}
        assert {r.predicted for r in quality_pu.score_quality(docs, quality_pu.train_quality(docs, none)).collect()} == {1}
    empty = docs.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.train_toxicity(empty, none)).count() == quality_pu.score_quality(empty, quality_pu.train_quality(empty, none)).count() == 0


def test_samples_are_of_the_smallest_hash(spark):
    from claimledger.llm.common import fresh_names, sample_by_hash

    ids = spark.range(5000).unionByName(spark.range(0, 2000, 1).selectExpr("id * 0 AS id")).withColumnRenamed("id", "doc_id")
    got = [r.doc_id for r in sample_by_hash(ids.repartition(7), "doc_id", 40).collect()]
    want = [r.doc_id for r in ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(40).collect()]
    assert sorted(got) == sorted(want) and sample_by_hash(ids.limit(0), "doc_id", 40).count() == 0
    assert fresh_names(spark.range(1).withColumn("rank", F.lit(1)), "rank", "x") == ["rank_", "x"]


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(2, 1, (3000, 2)), rng.normal(-2, 1, (1200, 2))
    m = quality_pu.fit_pu(pos[:1500], np.vstack([pos[1500:], neg]))
    assert abs(m.prior - 1500 / 2700) < 0.08
    assert (quality_pu.score_features(neg, m) < 0.5).mean() > 0.95 and (quality_pu.score_features(pos, m) > 0.5).mean() > 0.95


ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."


def test_decontamination_cases(spark):
    words = ITEM.split()
    noise = [f"w{i}" for i in range(200)]
    edited = words[:3] + ["other"] + words[4:9] + words[10:]  # one replaced, one dropped
    too_far = [w if i % 3 else f"n{i}" for i, w in enumerate(words)]
    texts = [ITEM, ITEM.upper(), " ".join(noise + words + noise), " ".join(noise + edited + noise), " ".join(too_far), " ".join(noise), None, "", " ".join(words[:10]), "alpha " * 50_000, " ".join(words + noise + words)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, hits string").repartition(2)
    bench = spark.createDataFrame([(7, ITEM, "x"), (8, None, "x"), (9, "too short", "x"), (None, ITEM, "x")], "item_id long, text string, doc_id string")
    got = {r.doc_id: r.found for r in decontamination.with_hits(docs, bench, out="found").collect()}
    assert {d for d, h in got.items() if h} == {0, 1, 2, 3, 10} and got[3][0].distance == 2 and got[2][0].start_word == 200 and got[2][0].end_word == 220
    assert decontamination.with_hits(docs.limit(0), bench).count() == 0
    assert all(r.found == [] for r in decontamination.with_hits(docs, bench.limit(0), out="found").collect())
    with pytest.raises(ValueError):
        decontamination.load_items(bench, 1)


def brute_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_distance_and_recall():
    rng = random.Random(5)
    for _ in range(60):
        a, b = [rng.randint(1, 4) for _ in range(rng.randint(1, 9))], [rng.randint(1, 4) for _ in range(rng.randint(1, 14))]
        d, lo, hi = decontamination.edit_distance(a, b, 99)
        assert d == brute_distance(a, b) and brute_distance(a, b[lo:hi]) == d
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice((12, 25, 40))))) for i in range(60)]
    index, found, n = decontamination.build_index(items), 0, 0
    for item in index.items:
        for edits in range(item.edits + 1):
            w = list(item.words)
            for _ in range(edits):
                p = rng.randrange(len(w))
                rng.choice((lambda w=w, p=p: w.__setitem__(p, 0), lambda w=w, p=p: w.insert(p, 0), lambda w=w, p=p: w.pop(p)))()
            hits = decontamination.find_in_batch([np.array([0] * 9 + w + [0] * 9)], index)[0]
            n, found = n + 1, found + any(h[0] == item.item_id for h in hits)
    assert found >= 0.95 * n


@pytest.mark.parametrize("size", [12, 25, 40, 60, 120, 250, 500])
def test_recall_at_the_edit_limit(size):
    """Passages as many edits away as an item allows, at every length; longer items are sought by pieces."""
    rng = random.Random(size)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=size))) for i in range(30)]
    index, found, n = decontamination.build_index(items), 0, 0
    for item in index.items:
        w = list(item.words)
        for p in rng.sample(range(len(w)), item.edits):  # no two at one place, so the distance is the limit
            w[p] = 0
        hits = decontamination.find_in_batch([np.array([0] * 9 + w + [0] * 9)], index)[0]
        n, found = n + 1, found + any(h[0] == item.item_id and h[1] <= item.edits for h in hits)
        assert decontamination.find_in_batch([np.array(list(item.words))], index)[0][0][:2] == (item.item_id, 0)
    assert found >= 0.9 * n


@pytest.mark.parametrize("kind", ["replace", "insert", "delete", "mixed"])
@pytest.mark.parametrize("size", [12, 15, 20, 21, 30, 35, 38, 40, 41, 50, 60, 90])
def test_recall_of_every_kind_of_edit(size, kind):
    rng = random.Random(1000 * size + len(kind))
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=size))) for i in range(25)]
    index, texts, want = decontamination.build_index(items), [], []
    for item in index.items:
        for _ in range(4):
            w = list(item.words)
            for _ in range(item.edits):
                p, one = rng.randrange(len(w)), rng.choice(("replace", "insert", "delete")) if kind == "mixed" else kind
                w[p : p + (one != "insert")] = [] if one == "delete" else [0]
            around = [rng.randrange(1, len(index.codes)) for _ in range(25)]
            texts.append(np.array([*around, *w, *around]))
            want.append(item.item_id)
    hits = decontamination.find_in_batch(texts, index)
    assert sum(any(h[0] == i for h in hs) for hs, i in zip(hits, want, strict=True)) >= 0.93 * len(want)


def test_hits_against_alignment_of_everything(spark):
    """Every item aligned with every text, at the smallest size: what is within the distance is found, and nothing else."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    codes, want = {}, set()
    code = lambda t: [codes.setdefault(w, len(codes) + 1) for w in decontamination.words_of(t)]
    items = [(b.item_id, code(b.text)) for b in bench]
    for d in docs:
        words = code(d.text)
        pairs = set(zip(words, words[1:], strict=False))
        for i, item in items:
            limit = int(0.2 * len(item))
            # an edit spoils two neighbouring pairs at most
            if len(item) >= 5 and sum(p in pairs for p in zip(item, item[1:], strict=False)) >= len(item) - 1 - 2 * limit:
                if decontamination.edit_distance(item, words, limit)[0] <= limit:
                    want.add((d.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontamination.op7_decontamination(spark, sf).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and want


def test_short_and_unspaced_items(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "x one two, three. y"), (3, "one two four three"), (4, "日本語の文をここに書く"), (5, "本語"), (6, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "One two three!"), (2, "本語の文"), (3, "語の文をここに書"), (4, "")], "item_id long, text string")
    got = {r.doc_id: [(h.item_id, h.start_word) for h in r.found] for r in decontamination.with_hits(docs, bench, out="found").collect()}
    assert got == {1: [(1, 0)], 2: [(1, 1)], 3: [], 4: [(2, 1), (3, 2)], 5: [], 6: []}


def test_pieces_cover_an_item():
    for n in range(1, 700):
        parts = decontamination.pieces_of(n, 40)
        assert sum(m for _, m in parts) == n and max(m for _, m in parts) <= 40 and min(m for _, m in parts) >= min(n, 20)
        assert all(a + m == b for (a, m), (b, _) in zip(parts, parts[1:], strict=False))


def test_decontamination_finds_every_verbatim_passage(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{BIG}/benchmark.parquet").collect()
    norm = lambda t: " " + " ".join(decontamination.words_of(t)) + " "
    items = [(b.item_id, norm(b.text)) for b in bench if len(decontamination.words_of(b.text)) >= 5]
    want = {(d, i) for d, text in [(d.doc_id, norm(d.text)) for d in docs] for i, t in items if t in text}
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.op7_decontamination(spark, BIG).collect()}
    assert want and want <= got.keys() and len(got) <= 1.2 * len(want)


def cuts(word, v):
    if not word:
        yield 0.0, ()
    for j in range(1, len(word) + 1):
        if word[:j] in v.pieces:
            i = v.pieces[word[:j]]
            for w, rest in cuts(word[j:], v):
                yield v.weights[i] + w, (i, *rest)


def test_samples_follow_the_lattice():
    v = sentencepieces.vocabulary(sentencepieces.MODEL)
    every = [(a + b, x + y) for (a, x), (b, y) in itertools.product(cuts("▁the", v), cuts("▁cat", v))]
    z = np.logaddexp.reduce([w for w, _ in every])
    p = {x: math.exp(w - z) for w, x in every}
    n = 6000
    got = sentencepieces.sample_batch(sentencepieces.Lattices(v), ["the cat"] * n, sentencepieces.derive(np.arange(n, dtype=np.uint64), 7), 3)
    first = Counter(tuple(r[0][2].tolist()) for r in got)
    pairs = Counter((tuple(r[0][2].tolist()), tuple(r[1][2].tolist())) for r in got)
    for x, q in sorted(p.items(), key=lambda t: -t[1])[:4]:
        assert abs(first[x] / n - q) < 4 * math.sqrt(q / n)
    for (a, b), m in pairs.most_common(4):
        q = p[a] * p[b] / (1 - p[a])
        assert abs(m / n - q) < 5 * math.sqrt(q / n)
    assert all(len({tuple(s[2].tolist()) for s in r}) == 3 for r in got)
    assert abs(np.mean([sum(math.exp(s[0]) / s[1] for s in r) for r in got]) - 1) < 0.03


def test_round_trip_and_determinism(spark):
    texts = ["", None, " ", "  two  spaces ", "a\tb\nc\r\n", "héllo 😀 \u4e2d\u6587 \ufdfa", "x" * 5000, "The quick brown fox " * 500, "▁raw▁", "The quick brown fox"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(9, texts[9], "n"), (None, "null key", "n")], "doc_id long, text string, sample string")
    one = sorted((r.doc_id or -1, r.sample, tuple(r.pieces), r.log_prob) for r in sentencepieces.sample_segmentations(df.repartition(5), k=3).collect())
    two = sorted((r.doc_id or -1, r.sample, tuple(r.pieces), r.log_prob) for r in sentencepieces.sample_segmentations(df.coalesce(1), k=3).collect())
    assert [x[:3] for x in one] == [x[:3] for x in two] and np.allclose([x[3] for x in one], [x[3] for x in two])
    out = sentencepieces.decode_column(sentencepieces.sample_segmentations(df, k=3), "pieces", "back").collect()
    for r in out:
        if r.doc_id is not None and r.doc_id != 8:
            assert r.back == (texts[r.doc_id] or "") and r.decodes
        assert 0 <= r.inclusion <= 1 and r.n_pieces == len(r.pieces)
    assert [len(r.pieces) for r in out if r.doc_id in (0, 1)] == [0, 0]
    assert sentencepieces.sample_segmentations(df.limit(0)).count() == 0


def words_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()


def brute_components(rows):
    sets = {d: words_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_matches_brute_force(spark, seed):
    """Chains, copies, a near group longer than a short run, a passage that most texts share, ties, odd texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    passage, base = rng.choices(vocab, k=55), rng.choices(vocab, k=70)
    texts = [None, "", "  \n", "one", "One ", "a b c", "A b  c", "a b c d e", "x y " * 20]
    for _ in range(40):
        texts.append(" ".join(rng.choices(vocab, k=rng.randint(5, 60)) + passage))
    for _ in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    chain = rng.choices(vocab, k=80)
    for i in range(12):
        texts.append(" ".join(chain[i * 3 : i * 3 + 44]))
    texts += [" ".join(passage + rng.choices(vocab, k=4)) for _ in range(15)] + texts[60:70] + [" ".join(rng.choices(vocab, k=3000))] * 2
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(twice).collect()) == [(1, 1), (2, 2)]


def test_jaccard_join_sql_twin(spark, sf):
    same_as_sql(jaccard_join.op6_jaccard_join(spark, sf), jaccard_join.ORACLES["op6_jaccard_join"])


def test_open_pairs_meet_across_components(spark):
    """A near group of which some members link with no pivot but with each other, under hashes that all share."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(60):
        w = list(base)
        for p in rng.sample(range(len(w)), rng.randint(0, 2)):
            w[p] = f"x{i}-{p}"
        texts.append(" ".join(w))
    for i in range(12):  # far from the base, near to one another in pairs
        w = list(base)
        for p in (5, 25, 45, 65, 85):
            w[p] = f"y{i // 2}-{p}"
        w[100] = f"z{i}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) > 5
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()} == want
    # a bitmap that lets nearly all texts through changes nothing
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, bits=64).collect()} == want


def test_shown_blocks_send_two_rows_of_a_hash(spark):
    docs = spark.createDataFrame([(i, "the same five words here " + ("" if i % 2 else f"and {i}")) for i in range(200)], "doc_id long, text string").coalesce(1)
    rows = jaccard_join.shown_entries(docs, 1.0, 5).collect()
    sent = Counter(r.h for r in rows if r.w == 0)
    assert max(sent.values()) == 2
    counts = {r.s: r.c for r in jaccard_join.shared_counts(jaccard_join.shown_entries(docs, 1.0, 5)).collect()}
    assert len(counts) == 101 and set(counts.values()) <= {1, 2}


def test_one_of_each_keeps_rows_without_id(spark):
    rows = [(1, "a b c d e f", 7), (1, "other words stand here in this row", 8), (2, "a b c d e f", 9), (None, "a b c d e f", 1), (None, None, 2), (3, None, 3), (3, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep int")
    got = sorted((tuple(r) for r in jaccard_join.one_of_each(spark, docs, "").collect()), key=str)
    assert docs.columns == ["doc_id", "text", "keep"] and [g[0] for g in got].count(None) == 2
    assert {g[0] for g in got if g[0]} == {1, 3} and len([g for g in got if g[0] == 3]) == 1


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        kept[name] = ({r.doc_id for r in before.select("doc_id").collect()}, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    before, after = kept["n-gram Jaccard join"]
    rows = [(d, t) for d, t in kept["quality classifier"][1].items()]
    assert set(after) == {c for _, c in brute_components(rows).values()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = kept["quality classifier"][0] - set(kept["quality classifier"][1])
    assert sum(labels[d].quality == 1 for d in gone if d in labels) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.where("sample = 0").count() == docs.count() and last.where("NOT decodes").count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated ids, columns named like the stages' own, an empty table."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    odd = spark.createDataFrame([(None, None, None), (None, "some text", "en"), (900_001, None, None), (900_001, "", "en"), (900_002, "one word " * 70, None), (900_002, "one word " * 70, None)], docs.schema)
    docs = docs.unionByName(odd)
    for name in ("score", "predicted", "hits", "rank", "keep", "text_hash", "sample"):
        docs = docs.withColumn(name, F.lit("mine"))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, sf)
            assert out.columns == columns
            rows = out.collect()
            assert all(r.score == r.hits == r.rank == "mine" for r in rows) and (rows or some is not docs)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.where("sample = 0").count() == docs.count() and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_held_out_fold(spark):
    import zlib

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
