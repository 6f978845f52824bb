"""Hard-negative mining: rotated one-bit codes, interval filter, integer scores.

Each component ``x`` of a vector becomes ``floor(scale * x)``; a score is the integer inner product of two such vectors.
An anchor's positives are its first ``n_positives`` other rows of the same label.  For each of them the first ``n_negatives`` rows of other
labels count whose score is ``low`` to ``high`` percent of the positive's.  Higher scores come first, ties by smaller id.

1. Codes.  All vectors are rotated by one random orthogonal matrix.  A vector's code is the signs of its components, as bits; with it
   are stored its alignment ``c`` (the inner product with the code's unit vector) and the length of what the code leaves over.
   What is left over gets a code of its own, ``levels`` times: one code alone leaves 0.6 of a vector's length.
2. Estimates.  The anchor's components become whole numbers of 6 bits; the inner product with a code is the popcount of
   ``code & plane`` summed over the bit planes.  The estimate of the score is the sum over the levels of alignment times product.
3. Intervals.  By Cauchy-Schwarz the score differs from the estimate by the anchor's length times the length left over at most, plus the
   alignments times the length that the 6 bits leave over.  Nothing here is a matter of chance: a row goes only if its whole
   interval lies below the scores that are held or outside the band.  After each level fewer rows are left.
4. The rows that are left are scored in integers, and the best of each task meet in one ranking for each anchor and positive.

Anchors are a stated set of queries.  They come in parts of about ``anchors_at_once`` (a bound of what is broadcast and of what a
task holds); for each part all rows are read once for the positives and once for the negatives, by tasks that hand on
their best rows only.  The rows themselves are never shuffled.  Work is anchors times rows: where both grow, so does it with the square.

Rows with a null id, label or vector, with a null or non-finite component, with no component, or with a component beyond
``2**31 / scale / sqrt(components)`` (the products would leave 64 bits) take no part.  Vectors of different lengths have no score.  Of rows
that repeat an id the least (label, vector) is the anchor; each one may be found, never by its own id; a positive that comes twice with
one score has its negatives once.  Extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimledger.llm.common import discard, read_table, store, work_dir

CODED = "vec_id long, label int, anchor boolean, size int, vector array<int>, bits array<long>, aligned array<double>, left array<double>, length double"
HITS = "anchor_id long, positive_id long, positive_score long, other_id long, score long"
#: Bits of an anchor's components in the estimates.
PLANES = 6
#: Share of the lengths by which rounding may move an estimate.
SLACK = 1e-9


def rotation(size: int, seed: int = 13) -> np.ndarray:
    """An orthogonal matrix, the same on every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def packed(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n, d = signs.shape
    wide = np.zeros((n, -(-d // 64) * 64), np.uint8)
    wide[:, :d] = signs
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def encode(vectors: np.ndarray, levels: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits by level, alignments, lengths left over behind each level) of integer vectors."""
    left = vectors.astype(np.float64) @ rotation(vectors.shape[1], seed)
    unit = 1 / np.sqrt(vectors.shape[1])
    bits, aligned, over = [], [], []
    for _ in range(levels):
        signs = left >= 0
        code = np.where(signs, unit, -unit)
        c = (left * code).sum(axis=1)
        left = left - c[:, None] * code
        bits.append(packed(signs))
        aligned.append(c)
        over.append(np.sqrt((left * left).sum(axis=1)))
    return np.stack(bits, axis=1), np.stack(aligned, axis=1), np.stack(over, axis=1)


@dataclass(frozen=True)
class Planes:
    """Anchors as bit planes: component = base + step * (0 .. 2**PLANES - 1) + what is left over."""

    bits: np.ndarray
    base: np.ndarray
    step: np.ndarray
    sums: np.ndarray
    left: np.ndarray
    length: np.ndarray


def planes(vectors: np.ndarray, seed: int = 13) -> Planes:
    turned = vectors.astype(np.float64) @ rotation(vectors.shape[1], seed)
    base = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - base) / (2**PLANES - 1), 1e-300)
    whole = np.rint((turned - base[:, None]) / step[:, None]).astype(np.int64)
    near = base[:, None] + step[:, None] * whole
    bits = np.stack([packed((whole >> k) & 1 == 1) for k in range(PLANES)], axis=1)
    return Planes(bits, base, step, near.sum(axis=1), np.sqrt(((turned - near) ** 2).sum(axis=1)), np.sqrt((turned * turned).sum(axis=1)))


def popcount(words: np.ndarray) -> np.ndarray:
    """Set bits of the 64-bit words along the last axis."""
    n = np.bitwise_count(words)
    return n[..., 0] if words.shape[-1] == 1 else n.sum(axis=-1, dtype=np.int64)


def products(p: Planes, a: np.ndarray | slice, codes: np.ndarray, size: int) -> np.ndarray:
    """Inner products of anchors (near their planes) and the unit vectors of codes, by popcounts.

    Sum over the places with a set bit, doubled, less the sum over all places.  ``a`` and ``codes`` broadcast against each other.
    """
    set_sum = 0.0
    for k in range(PLANES):
        set_sum = set_sum + float(2**k) * popcount(p.bits[a, k] & codes)
    n_set = popcount(codes)
    return (2 * (p.base[a] * n_set + p.step[a] * set_sum) - p.sums[a]) / np.sqrt(size)


@dataclass
class Anchors:
    """A part of the anchors, of one vector length.  bands: (least, most score) of each band, a band without rows has most < least."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    planes: Planes
    least: np.ndarray
    most: np.ndarray
    positive_ids: np.ndarray
    positive_scores: np.ndarray


def surviving(anchors: Anchors, own: slice, floor: np.ndarray, top: np.ndarray, rows: dict, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) pairs of ``allowed`` whose interval meets [floor, top] of the anchor, level by level."""
    p, size = anchors.planes, rows["vector"].shape[1]
    codes, aligned, left, length = rows["bits"], rows["aligned"], rows["left"], rows["length"]
    a = i = None
    estimate = spread = None
    for level in range(codes.shape[1]):
        if a is None:
            pair = np.arange(own.start, own.stop)[:, None]
            got = products(p, pair, codes[None, :, level], size)
            estimate, spread = aligned[None, :, 0] * got, p.left[pair] * np.abs(aligned[None, :, 0])
            # what the code leaves over is at right angles to it, so only that part of the anchor counts
            across = np.sqrt(np.maximum(0, p.length[pair] ** 2 - np.maximum(0, np.abs(got) - p.left[pair]) ** 2))
            margin = spread + across * left[None, :, 0] + SLACK * p.length[pair] * length[None, :]
            ok = allowed & (estimate + margin >= floor[:, None]) & (estimate - margin <= top[:, None])
            a, i = np.nonzero(ok)
            estimate, spread = estimate[a, i], spread[a, i]
            a = a + own.start
        else:
            got = products(p, a, codes[i, level], size)
            estimate = estimate + aligned[i, level] * got
            spread = spread + p.left[a] * np.abs(aligned[i, level])
            margin = spread + p.length[a] * left[i, level] + SLACK * p.length[a] * length[i]
            ok = (estimate + margin >= floor[a - own.start]) & (estimate - margin <= top[a - own.start])
            a, i, estimate, spread = a[ok], i[ok], estimate[ok], spread[ok]
        if not len(a):
            break
    return a, i


class Best:
    """The best ``k`` (score, id) of each place, a place being an anchor and band."""

    def __init__(self, places: int, k: int):
        self.k, self.score, self.id, self.n = k, np.zeros((places, k), np.int64), np.zeros((places, k), np.int64), np.zeros(places, np.int64)

    def floor(self, least: np.ndarray) -> np.ndarray:
        """Scores below this cannot enter."""
        return np.where(self.n >= self.k, np.maximum(self.score[:, -1], least), least)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(place)
        old = np.repeat(touched, self.n[touched])
        rank = np.arange(len(old)) - np.repeat(np.cumsum(self.n[touched]) - self.n[touched], self.n[touched])
        p, s, x = np.concatenate((old, place)), np.concatenate((self.score[old, rank], score)), np.concatenate((self.id[old, rank], ids))
        order = np.lexsort((x, -s, p))
        p, s, x = p[order], s[order], x[order]
        starts = np.searchsorted(p, touched)
        rank = np.arange(len(p)) - np.repeat(starts, np.diff(np.append(starts, len(p))))
        keep = rank < self.k
        p, s, x, rank = p[keep], s[keep], x[keep], rank[keep]
        self.score[p, rank], self.id[p, rank] = s, x
        self.n[touched] = np.bincount(np.searchsorted(touched, p), minlength=len(touched))


def scores(a: np.ndarray, b: np.ndarray, at_once: int = 1 << 21) -> np.ndarray:
    """Integer inner products, row by row."""
    step = max(1, at_once // max(1, a.shape[1]))
    return np.concatenate([np.einsum("ij,ij->i", a[k : k + step], b[k : k + step]) for k in range(0, len(a), step)] or [np.zeros(0, np.int64)])


def search(anchors: Anchors, blocks: Iterator[dict], k: int, same_label: bool, pairs_at_once: int = 1 << 19) -> Best:
    """The best ``k`` rows of all ``blocks`` for each anchor and band, of the anchor's own or of other labels."""
    n, bands = anchors.least.shape
    best = Best(n * bands, k)
    for rows in blocks:
        step = max(1, pairs_at_once // max(1, len(rows["id"])))
        for first in range(0, n, step):
            own = slice(first, min(n, first + step))
            floors = best.floor(anchors.least.reshape(-1)).reshape(n, bands)[own]
            open_ = anchors.least[own] <= anchors.most[own]
            floor = np.where(open_, floors, np.iinfo(np.int64).max).min(axis=1)
            top = np.where(open_, anchors.most[own], np.iinfo(np.int64).min).max(axis=1)
            same = anchors.labels[own, None] == rows["label"][None, :]
            a, i = surviving(anchors, own, floor, top, rows, (same if same_label else ~same) & (anchors.ids[own, None] != rows["id"][None, :]))
            score = scores(anchors.vectors[a], rows["vector"][i])
            for band in range(bands):
                ok = np.flatnonzero((score >= floors[a - own.start, band]) & (score <= anchors.most[a, band]))
                if len(ok):
                    best.add(a[ok] * bands + band, score[ok], rows["id"][i[ok]])
    return best


def lists(column: pa.Array, width: int, kind) -> np.ndarray:
    """A list column without nulls, each of ``width`` entries, as a matrix."""
    return np.asarray(column.flatten(), dtype=kind).reshape(-1, width)


def blocks_of(batch: pa.RecordBatch, levels: int) -> Iterator[tuple[int, dict]]:
    """(vector length, rows of that length) of a batch of coded rows."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        b = batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))
        words = -(-size // 64)
        yield size, {
            "id": b.column("vec_id").to_numpy(), "label": b.column("label").to_numpy(), "vector": lists(b.column("vector"), size, np.int64), "length": b.column("length").to_numpy(),
            "bits": lists(b.column("bits"), levels * words, np.int64).view(np.uint64).reshape(-1, levels, words), "aligned": lists(b.column("aligned"), levels, float), "left": lists(b.column("left"), levels, float),
        }


def coded(rows: DataFrame, levels: int) -> DataFrame:
    """``rows`` (vec_id, label, anchor, vector of whole numbers) with their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CODED.split(", ")]
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                b = batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))
                vectors = lists(b.column("vector"), size, np.int64)
                bits, aligned, left = encode(vectors, levels)
                flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.reshape(len(x), -1).shape[1], pa.int32()), pa.array(x.reshape(-1)))  # noqa: B023, E731
                columns = [b.column("vec_id"), b.column("label"), b.column("anchor"), pa.array(np.full(len(vectors), size, np.int32)), b.column("vector"), flat(bits.view(np.int64)), flat(aligned), flat(left), pa.array(np.sqrt((vectors.astype(float) ** 2).sum(axis=1)))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, CODED)


def hits(rows: DataFrame, parts: dict[int, Anchors], levels: int, k: int, same_label: bool) -> DataFrame:
    """Each task's best ``k`` rows for every anchor and band."""
    shared = rows.sparkSession.sparkContext.broadcast(parts)
    names = [f.split()[0] for f in HITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for size, block in blocks_of(batch, levels):
                if size not in shared.value:
                    continue
                anchors = shared.value[size]
                got = search(anchors, iter([block]), k, same_label)
                if size in best:
                    place = np.repeat(np.arange(len(got.n)), got.n)
                    rank = np.concatenate([np.arange(n) for n in got.n.tolist()] or [np.zeros(0, int)]).astype(int)
                    best[size].add(place, got.score[place, rank], got.id[place, rank])
                else:
                    best[size] = got
        for size, b in best.items():
            anchors, bands = shared.value[size], shared.value[size].least.shape[1]
            place, rank = np.nonzero(np.arange(k)[None, :] < b.n[:, None])
            a, band = place // bands, place % bands
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors.ids[a], anchors.positive_ids[a, band], anchors.positive_scores[a, band], b.id[place, rank], b.score[place, rank])], names=names)

    return rows.select("vec_id", "label", "size", "vector", "bits", "aligned", "left", "length").mapInArrow(run, HITS)


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def anchors_of(rows: list, bands: dict[int, list[tuple[int, int]]] | None, low: int, high: int) -> dict[int, Anchors]:
    """Anchors by vector length; without ``bands`` every score is within reach, else those of each (positive, score)."""
    out = {}
    for size in sorted({r["size"] for r in rows}):
        own = [r for r in rows if r["size"] == size and (bands is None or r["vec_id"] in bands)]
        if not own:
            continue
        vectors = np.array([r["vector"] for r in own], np.int64)
        width = max((len(bands[r["vec_id"]]) for r in own), default=1) if bands is not None else 1
        shape = (len(own), width)
        least, most, ids, score = (np.full(shape, v, np.int64) for v in (1, 0, 0, 0))
        if bands is None:
            least[:], most[:] = -(2**62), 2**62
        else:
            for k, r in enumerate(own):
                for j, (other, s) in enumerate(bands[r["vec_id"]]):
                    ids[k, j], score[k, j], least[k, j], most[k, j] = other, s, -(-low * s // 100), high * s // 100
        out[size] = Anchors(np.array([r["vec_id"] for r in own]), np.array([r["label"] for r in own]), vectors, planes(vectors), least, most, ids, score)
    return out


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, levels: int = 4, anchors_at_once: int = 20_000, rows_a_task: int = 20_000) -> DataFrame:
    """Hard negatives of ``rows`` (vec_id, label, embedding) for the rows where ``is_anchor`` holds: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    folder = work_dir(spark)
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("int"))
    most = 2.0**31 / scale / F.sqrt(F.size("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) <= most)) & (F.size("embedding") > 0)
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    table = store(coded(kept.select("vec_id", F.col("label").cast("int").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), whole.alias("vector")), levels), folder, "codes")
    n_rows, n_anchors = table.agg(F.count("*"), F.count_if("anchor")).first()
    # the codes lie in as many files as the input had; tasks that hold more rows hand on fewer hits
    dealt = table.coalesce(max(2 * spark.sparkContext.defaultParallelism, n_rows // rows_a_task + 1))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    n_parts = n_anchors // anchors_at_once + 1
    for part in range(n_parts):
        own = table.where(F.col("anchor") & (F.pmod(F.xxhash64("vec_id"), F.lit(n_parts)) == part)).select("vec_id", "label", "size", "vector").limit(4 * anchors_at_once + 1).collect()
        if len(own) > 4 * anchors_at_once:
            raise ValueError("ids of anchors repeat so often that a part of them is no longer small")
        if not own:
            continue
        own = list({r["vec_id"]: r for r in sorted(own, key=lambda r: (r["label"], r["vector"]), reverse=True)}.values())
        firsts = ranked(hits(dealt, anchors_of(own, None, low, high), levels, n_positives, True), ["anchor_id"], n_positives)
        bands: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(firsts.select("anchor_id", "rank", "other_id", "score").collect()):
            if (r["other_id"], r["score"]) not in (own_bands := bands.setdefault(r["anchor_id"], [])):
                own_bands.append((r["other_id"], r["score"]))
        found = ranked(hits(dealt, anchors_of(own, bands, low, high), levels, n_negatives, False), ["anchor_id", "positive_id", "positive_score"], n_negatives)
        found = found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = store(found, folder, f"part-{part}") if part == 0 and n_parts == 1 else out.unionByName(store(found, folder, f"part-{part}"))
    discard(spark, folder, "codes")
    return out


def op13_hard_negatives(spark, sf_dir):
    """Anchors are the rows whose id is divisible by 100; every seventh label is shifted first."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {
    "op13_hard_negatives": """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
    n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
          FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
