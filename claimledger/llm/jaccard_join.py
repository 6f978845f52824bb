"""N-gram Jaccard join: grouped prefix join on word shingles, exact, with connected components.

Words are maximal runs of non-space bytes after lower-casing A-Z; a text's set is its distinct
shingles of ``k`` words (the whole sequence if it is shorter), each a 64-bit hash.  Two texts link
when ``den * |A n B| >= num * |A u B|`` (3 of 4).

1. Texts of one set form a class and stand as its smallest id; only classes go on.
2. Support.  Linked sets have most of their hashes in common, so a set that shares few hashes with any
   other has no links.  First the ``lam`` of each set that comes first in hash order is counted, then the
   whole sets of those that pass, with exact counts.  Few texts of a corpus pass both.
3. Prefixes.  A set's hashes are put in one order of all sets, rarest first.  Linked sets share one of
   their first ``n - ceil(num n / den) + 1``.  Sets of one size and one prefix form a group, which takes part
   as its smallest member.  A pair that meets at a hash is a candidate if sizes and places there
   leave room for the overlap a link needs (at the first common hash they must).
4. Groups meet in stars: under each hash every group with the best supported one, in each group every
   member with the smallest.  Candidates are verified on their whole sets, the links give components.
5. What is left open are pairs in different components.  Once more a member of each component meets the
   largest component of the run, then all pairs of different components that pass the filters, members
   of groups one by one, are verified.  So no link between components is lost, and pairs inside a component
   (nearly all pairs of a large group of near copies) are never made.

Null, empty and wordless texts have no shingles and link with nothing; rows without a doc_id are no
documents.  Copies never make pairs of their own.  Rows that repeat a doc_id count as one document with
the text of the least (size, set hashes, text hash).  Other columns are not read, whatever their names;
an empty table gives an empty result.  Every step is written to the shared folder, so a lost executor
costs one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from claimledger.llm.common import discard, fresh_names, read_table, store, work_dir


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Shingler:
    """Shingle hashes of texts, by array operations over their bytes; keeps only powers up to the longest text."""

    PRIME = 0x9E3779B97F4A7C15

    def __init__(self, k: int = 5):
        self.k = k
        rng = np.random.default_rng(20)
        self.code = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.power) < n:
            for name, base in (("power", self.PRIME), ("inverse", pow(self.PRIME, -1, 2**64))):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, old * np.uint64(pow(base, len(old), 2**64))]))

    def words(self, text: str) -> np.ndarray:
        """One hash per word: its bytes' codes as a polynomial, shifted to the word's start, and its length."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
        edge = np.flatnonzero(np.diff(self.space[raw], prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.zeros(0, np.uint64)
        self._powers(len(raw) + 1)
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.code[raw] * self.power[: len(raw)], out=run[1:])
        return _mix((run[end] - run[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes (uint64) of a text."""
        with np.errstate(over="ignore"):
            h = self.words(text) if text else np.zeros(0, np.uint64)
            if not len(h):
                return h
            k = min(self.k, len(h))
            out = np.full(len(h) - k + 1, k, dtype=np.uint64)
            for i in range(k):
                out = (out * np.uint64(self.PRIME)) ^ h[i : len(h) - k + 1 + i]
                out ^= out >> np.uint64(29)
            out = _mix(out)
            out.sort()
            return out[np.append(True, out[1:] != out[:-1])]


def shown_part(hashes: np.ndarray, lam: float) -> np.ndarray:
    return hashes[: int(np.ceil(lam * len(hashes)))]


def _digest(x: np.ndarray, salt: int) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes(), seed=salt)).astype(np.int64))


def _blocks(batch: pa.RecordBatch, rows: int = 2000, size: int = 4_000_000) -> Iterator[tuple[list, ...]]:
    """The batch's columns as lists, a few texts at a time; a text is the last column.

    At most ``rows`` rows, and no more once their texts hold ``size`` bytes.
    """
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, rows)
        lengths = np.cumsum(pc.fill_null(pc.binary_length(part.column(part.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
        n = min(part.num_rows, int(np.searchsorted(lengths, size)) + 1)
        yield tuple(c.to_pylist() for c in part.slice(0, n).columns)
        at += n


def _longs(*columns) -> list[pa.Array]:
    return [pa.array(np.asarray(c, dtype=np.int64)) for c in columns]


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Per row with an id: set size ``n``, two hashes of the set, and ``t``, a hash of the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for batch in batches:
            for ids, t, texts in _blocks(batch):
                found = []
                for text in texts:
                    x = shingles(text)
                    found.append((len(x), _digest(x, 1), _digest(x, 2)))
                yield pa.RecordBatch.from_arrays(_longs(ids, *zip(*found, strict=True), t), names=["doc_id", "n", "s1", "s2", "t"])

    given = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return given.mapInArrow(rows, "doc_id long, n long, s1 long, s2 long, t long")


def shown_entries(docs: DataFrame, lam: float, k: int) -> DataFrame:
    """Entries (h, s, block, w) of the first part of each set in hash order; ``s`` names the set.

    Each block of texts combines its own: a set counts once, of the sets under one hash only two are sent
    on, and what the others would add (they share the hash with those two) comes as one row of weight ``w``.
    So a hash or a set of very many texts gives two rows a block at most.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, number = Shingler(k), TaskContext.get().partitionId() << 12
        for batch in batches:
            for (texts,) in _blocks(batch):
                sets = {}
                for text in texts:
                    x = shingles(text)
                    if len(x):
                        sets.setdefault(_digest(x, 1), shown_part(x, lam))
                if not sets:
                    continue
                names, sizes = np.fromiter(sets, np.int64), np.array([len(x) for x in sets.values()])
                h, owner = np.concatenate(list(sets.values())).view(np.int64), np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(h, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(h[order]) != 0))
                place = np.empty(len(h), np.int64)
                place[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
                sent = place < 2
                rest = np.bincount(owner[~sent], minlength=len(sets))
                more = np.flatnonzero(rest)
                number += 1
                columns = _longs(np.append(h[sent], names[more]), np.append(names[owner[sent]], names[more]))
                w = np.append(np.zeros(sent.sum(), np.int32), rest[more].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(w), number % 2**31, np.int32)), pa.array(w)], names=["h", "s", "block", "w"])

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(rows, "h long, s long, block int, w int")


def shared_counts(entries: DataFrame) -> DataFrame:
    """(s, c): how many of the hashes that a set shows another set shows too; never less than that."""
    run = Window.partitionBy("h")
    seen = entries.withColumn("lo", F.min("s").over(run)).withColumn("hi", F.max("s").over(run)).where("w > 0 OR lo <> hi")
    return seen.groupBy("s", "block").agg(F.sum(F.greatest("w", F.lit(1))).alias("c")).groupBy("s").agg(F.max("c").alias("c"))


def least_shown(n: Column, lam: float, num: int, den: int) -> Column:
    """How many hashes two linked sets, one of size ``n``, have in common at least among those they show.

    Of the common hashes those are missing that lie behind the shown part of one of the two.
    """
    share, n = num / (num + den), n.cast("double")
    smaller, larger = F.ceil(n * num / den), F.floor(n * den / num)
    below = F.ceil(share * (n + smaller) - 1e-6) - (n - F.ceil(lam * n))
    above = F.ceil(F.least(share * (n + larger) - (1 - lam) * larger, 2 * share * n - (1 - lam) * n) - 1e-6)
    return F.greatest(F.least(below, above), F.lit(1))


def id_bitmap(ids: DataFrame, key: str, bits: int) -> DataFrame:
    """(word, mask): a bitmap of ``bits`` places in which each id's hash is set; ``bits / 64`` rows at most, whatever the ids."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    return ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("mask"))


def whole_sets(docs: DataFrame, chosen: DataFrame, k: int, bits: int) -> DataFrame:
    """(id, n, hs): the whole sets of the ``chosen`` (id, n, t) texts.

    The bitmap of the chosen ids, of a fixed size, is broadcast and lets few other texts through to the join.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for batch in batches:
            for ids, n, texts in _blocks(batch, 500):
                sets = [shingles(text) for text in texts]
                ends = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([*_longs(ids, n), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "n", "hs"])

    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), "text").withColumn("p", place).withColumn("word", F.floor(F.col("p") / 64))
    likely = texts.join(F.broadcast(id_bitmap(chosen, "id", bits)), "word").where("shiftright(mask, cast(p % 64 as int)) & 1 = 1").select("id", "t", "text")
    return likely.join(chosen, ["id", "t"]).select("id", "n", "text").mapInArrow(rows, "id long, n long, hs array<long>")


def supported_sets(wholes: DataFrame, num: int, den: int) -> DataFrame:
    """(id, n, c, hs): sets with enough hashes that another set has too, those ``c`` hashes rarest first.

    A set of which more than a quarter is its own alone can link with nothing.
    """
    counts = wholes.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    met = wholes.select("id", "n", F.explode("hs").alias("h")).join(counts, "h")
    kept = met.groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "h"))).alias("o"))
    kept = kept.select("id", "n", F.array_distinct(F.col("o.h")).alias("hs"))  # a text that comes in several rows is counted as often
    return kept.select("id", "n", F.size("hs").cast("long").alias("c"), "hs").where(F.lit(den) * F.col("c") >= F.lit(num) * F.col("n"))


def prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, n, gid, prefix, skip): the rarest hashes of which two linked sets share one at least.

    ``skip`` hashes that no other set has come before them.  Sets of one size and one prefix form a group, named by the least id.
    """
    length = F.col("n") - F.ceil(F.lit(num) * F.col("n") / F.lit(den)) + 1 - (F.col("n") - F.col("c"))
    p = sets.select("id", "n", (F.col("n") - F.col("c")).alias("skip"), F.slice("hs", F.lit(1), length.cast("int")).alias("prefix"))
    keyed = p.withColumn("g1", F.xxhash64("n", "prefix")).withColumn("g2", F.xxhash64(F.lit(20), "prefix", "n"))
    groups = keyed.groupBy("g1", "g2").agg(F.min("id").alias("gid"))
    return keyed.join(groups, ["g1", "g2"]).select("id", "n", "gid", "prefix", "skip")


def may_link(na: str, ia: str, nb: str, ib: str, num: int, den: int) -> Column:
    """Size and positional filter of two sets that meet at a hash in places ``ia`` and ``ib``.

    At their first common hash all that they can share lies from there on.
    """
    rest = F.least(F.col(na) - F.col(ia), F.col(nb) - F.col(ib))
    sizes = F.lit(den) * F.least(na, nb) >= F.lit(num) * F.greatest(na, nb)
    return sizes & (F.lit(num + den) * rest >= F.lit(num) * (F.col(na) + F.col(nb)))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def group_stars(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b): under each hash every group with the one that stands there best supported."""
    groups = entries.where("id = gid")
    best = F.min(F.struct((F.col("i") / F.col("n")).alias("r"), "id", "n", "i"))
    pivots = groups.groupBy("h").agg(best.alias("p"), F.count("*").alias("f")).where("f > 1").select("h", F.col("p.id").alias("pid"), F.col("p.n").alias("pn"), F.col("p.i").alias("pi"))
    return groups.join(pivots, "h").where((F.col("id") != F.col("pid")) & may_link("n", "i", "pn", "pi", num, den)).select(*_pair("id", "pid")).distinct()


def _with_components(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return df.join(found.select(F.col("id").alias(key), "component"), key, "left").withColumn("component", F.coalesce("component", key))


def mixed_runs(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries under hashes that more than one component has, with the run's largest component as ``main``."""
    e = _with_components(entries, found, "id")
    parts = e.groupBy("h", "component").agg(F.count("*").alias("m"))
    runs = parts.groupBy("h").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("h", "main")
    return e.join(runs, "h")


def component_stars(mixed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b): under each hash a member of every component with one of the largest."""
    best = F.min(F.struct((F.col("i") / F.col("n")).alias("r"), "id", "n", "i")).alias("p")
    reps = mixed.groupBy("h", "component").agg(F.first("main").alias("main"), best).select("h", "component", "main", "p.id", "p.n", "p.i")
    first = reps.where("component = main").select("h", F.col("id").alias("pid"), F.col("n").alias("pn"), F.col("i").alias("pi"))
    return reps.where("component <> main").join(first, "h").where(may_link("n", "i", "pn", "pi", num, den)).select(*_pair("id", "pid")).distinct()


def open_pairs(mixed: DataFrame, num: int, den: int, steps: int = 6) -> DataFrame:
    """All pairs (a, b) of different components that pass the filters at a common hash.

    Members of a run's largest component don't meet each other.  A run is dealt by ``steps`` size
    classes to a doubling, and an entry goes to those classes only that its place leaves open to a partner.
    """
    band = lambda n: F.floor(F.log2(n) * steps)
    least = F.ceil(F.lit(num) * F.col("n") / F.lit(den))
    most = F.least(F.floor(F.lit(den) * F.col("n") / F.lit(num)), F.floor(F.lit(num + den) * (F.col("n") - F.col("i")) / F.lit(num)) - F.col("n"))
    odd = mixed.where("component <> main").withColumn("lo", least).withColumn("hi", most).where("lo <= hi")
    odd = odd.select("h", F.col("id").alias("oid"), F.col("n").alias("no"), F.col("i").alias("io"), F.col("component").alias("co"), F.explode(F.sequence(band("lo"), band("hi"))).alias("band"))
    all_ = mixed.select("h", "id", "n", "i", "component", band("n").alias("band"))
    return odd.join(all_, ["h", "band"]).where((F.col("co") != F.col("component")) & may_link("no", "io", "n", "i", num, den)).select(*_pair("oid", "id")).distinct()


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link."""
    side = lambda k: sets.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("hs").alias(f"h{k}"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.lit(den) * both >= F.lit(num) * (F.col("na") + F.col("nb") - both)).select("a", "b")


def components(links: DataFrame, folder: str, name: str, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link.

    Alternating large-star and small-star steps; each round is written out, so a lost executor costs
    one round.  Rounds grow with the logarithm of the longest chain.
    """

    def kept(df: DataFrame, step: int) -> tuple[DataFrame, tuple]:
        """The stored rows and, taken while they were written, sums that tell two sets of rows apart."""
        seen = Observation()
        sums = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s"))
        out = store(df.observe(seen, *sums), folder, f"{name}-{step}")
        return out, tuple(seen.get[k] for k in ("n", "x", "s"))

    edges, before = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), 0)
    for r in range(1, most_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: greater neighbours go to the least one
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: lesser neighbours and the node itself go to the least one
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges, after = kept(small, r)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").unionByName(roots)


def merged(found: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """``found`` after more ``links``: components of components, so the graph is as small as what changes."""
    a = _with_components(links.withColumnRenamed("a", "id"), found, "id").select("b", F.col("component").alias("a"))
    ends = _with_components(a.withColumnRenamed("b", "id"), found, "id").select("a", F.col("component").alias("b"))
    over = components(ends, folder, name)
    lifted = found.join(over.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return store(lifted.unionByName(over.join(found, "id", "left_anti")), folder, f"{name}-all")


def jaccard_components(docs: DataFrame, lam: float = 0.36, k: int = 5, num: int = 75, den: int = 100, bits: int = 1 << 24) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, and t (hash of the text that counts), one row per document.

    ``lam`` must be above ``1 - num / den``: it is the part of each set that is looked at first.
    ``bits`` sets the size of the one table that is broadcast; beyond it more texts are shuffled, no more.
    """
    spark = docs.sparkSession
    folder = work_dir(spark)
    rows = store(describe(docs, k), folder, "rows")
    whole = rows.groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2", "t")).alias("s")).select("doc_id", "s.*")
    classes = store(whole.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "t")).alias("c")).select("n", "s1", "s2", F.col("c.doc_id").alias("class_id"), F.col("c.t").alias("t")), folder, "classes")
    shared = shared_counts(shown_entries(docs, lam, k)).withColumnRenamed("s", "s1")
    chosen = classes.join(shared, "s1").where(F.col("c") >= least_shown(F.col("n"), lam, num, den)).select(F.col("class_id").alias("id"), "n", "t")
    chosen = store(chosen, folder, "chosen")

    sets = store(supported_sets(store(whole_sets(docs, chosen, k, bits), folder, "wholes"), num, den), folder, "sets")
    discard(spark, folder, "wholes", "chosen")
    shown = prefixes(sets, num, den)
    entries = shown.select("id", "n", "gid", "skip", F.posexplode("prefix").alias("i", "h")).select("h", "id", "gid", "n", (F.col("skip") + F.col("i")).alias("i"))
    entries = store(entries, folder, "entries")

    inside = entries.where("id <> gid").select(*_pair("id", "gid")).distinct()
    tried = store(group_stars(entries, num, den).unionByName(inside).distinct(), folder, "pairs-1")
    links = store(verify(tried, sets, num, den), folder, "links-1")
    found = store(components(links, folder, "round-1"), folder, "components-1")
    for turn, meet in ((2, component_stars), (3, open_pairs)):
        pairs = meet(mixed_runs(entries, found), num, den).join(tried, ["a", "b"], "left_anti")
        pairs = store(pairs, folder, f"pairs-{turn}")
        more = store(verify(pairs, sets, num, den), folder, f"links-{turn}")
        tried = tried.unionByName(pairs)
        if not more.isEmpty():
            found = merged(found, more, folder, f"round-{turn}")
    discard(spark, folder, "sets", "entries")
    out = whole.join(classes.select("n", "s1", "s2", "class_id"), ["n", "s1", "s2"], "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = out.join(found.select(F.col("id").alias("class_id"), F.col("component").alias("_c")), "class_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("_c", "class_id").alias("component_id"), "t")


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document of the smallest id stays; the columns stay as they are.

    Rows that repeat a doc_id are one document: one row with the text that was compared stays.  Rows
    without an id can't be named by a link and all stay.
    """
    ids = jaccard_components(docs).where("doc_id = component_id").select("doc_id", "t")
    keep, text_hash, rank = fresh_names(docs, "keep", "text_hash", "rank")
    ids = ids.toDF(keep, text_hash)
    kept = docs.join(ids, (docs["doc_id"].cast("long") == ids[keep]) & (F.xxhash64(docs["text"]) == ids[text_hash]), "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.lit(1))
    kept = kept.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def op6_jaccard_join(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id", "class_id")


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLES = {
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS h FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id, p.class_id
FROM n JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1) m USING (doc_id)
JOIN (SELECT doc_id, CASE WHEN len(sh) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(sh)) END AS class_id FROM s) p USING (doc_id)
"""
}
