"""Quality rules: text statistics and a learnt decision list, all in DataFrame functions.

Statistics are arrays and strings handled row by row inside Spark, so no row moves for them.  The
decision list is grown on the driver by sequential covering (grow a conjunction of thresholds by
information gain on two thirds of a bounded labelled sample, prune it on the rest) and comes back
as one ordered ``CASE WHEN``.  A list has at most ``most_rules`` (8) conjunctions of at most ``most_tests``
(3) thresholds each, a threshold is one of at most some ``most_cuts`` (40) midpoints of a feature's sampled
values; of tests of equal gain the first in the order of feature names, cuts and directions wins.

Null and empty texts have zeros everywhere and fail the base rules.  Repeated rows and ties are judged
one by one, an empty table gives an empty result, other columns pass through whatever their names (those
that are set here are replaced).  Without labelled rows of both kinds no rule is learnt, and the base
rules alone decide.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import SPACE_CLASS, fresh_names, labelled_sample, read_table

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(grams: Column) -> Column:
    """Words inside three-word windows whose hash occurs twice or more; ``grams``: the windows' hashes in order."""
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        twin = lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | ((k < last) & (F.get(s, k + 1)["g"] == x["g"]))
        flagged = F.transform(s, lambda x, k: F.when(twin(x, k), x["i"]))
        return F.sort_array(F.array_compact(flagged))

    def words(p: Column) -> Column:
        steps = F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), v + 3) - v))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(placed, lambda s: _let(starts(s), words))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the statistics (long) over the whole text; columns of these names are replaced."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    size = lambda c: F.size(c).cast("long")
    w, h, g = fresh_names(docs, "words", "word_hashes", "grams")
    df = docs.drop(*STATS, "n_marks").withColumn(w, F.filter(F.split(t, SPACE_CLASS), lambda x: x != ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    grams = F.when(F.size(h) > 2, F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(g, grams)
    repeated = F.when(F.size(F.array_distinct(g)) < F.size(g), _covered(F.col(g))).otherwise(F.lit(0).cast("long"))
    return (
        df.withColumn("n_words", size(w))
        .withColumn("word_chars", F.char_length(F.array_join(w, "")).cast("long"))
        .withColumn("n_symbols", (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", repeated)
        .withColumn("n_marks", (F.char_length(t) - F.char_length(F.translate(t, "!?", ""))).cast("long"))
        .drop(w, h, g)
    )


def ratios() -> dict[str, Column]:
    """The features that the learnt conjunctions test; every one is 0 for an empty text."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_lines_per_word": F.col("n_dup_lines") / words,
        "marks_per_word": F.col("n_marks") / words,
        "chars_per_word": F.col("word_chars") / words,
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, row) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        value = ratios()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


def _thresholds(values: Sequence[float], most: int) -> list[float]:
    ordered = sorted(set(values))
    cuts = [(a + b) / 2 for a, b in zip(ordered, ordered[1:], strict=False)]
    step = max(1, len(cuts) // most)
    return cuts[::step]


def _grow(bad: list[dict], good: list[dict], features: Sequence[str], most_tests: int, most_cuts: int) -> list[Test]:
    """Adds the test of the greatest information gain until no good row is covered."""
    tests: list[Test] = []
    while bad and good and len(tests) < most_tests:
        base, best, gain = math.log2(len(bad) / (len(bad) + len(good))), None, 1e-9
        for f in features:
            for cut in _thresholds([r[f] for r in bad + good], most_cuts):
                for above in (True, False):
                    t = Test(f, above, cut)
                    p, n = sum(map(t.holds, bad)), sum(map(t.holds, good))
                    if p and (g := p * (math.log2(p / (p + n)) - base)) > gain:
                        best, gain = t, g
        if best is None:
            break
        tests.append(best)
        bad, good = [r for r in bad if best.holds(r)], [r for r in good if best.holds(r)]
    return tests


def _worth(tests: Sequence[Test], bad: list[dict], good: list[dict]) -> float:
    p, n = (sum(all(t.holds(r) for t in tests) for r in rows) for rows in (bad, good))
    return (p - n) / max(1, p + n)


def learn_rules(bad: list[dict], good: list[dict], most_rules: int = 8, most_tests: int = 3, most_cuts: int = 40, least_precision: float = 0.9) -> list[list[Test]]:
    """Conjunctions that reject, in the order they were learnt; each covers bad rows the earlier ones left."""
    features, rules = sorted(ratios()), []
    third = lambda rows, keep: [r for i, r in enumerate(rows) if (i % 3 == 2) != keep]
    grow_bad, prune_bad, grow_good, prune_good = third(bad, True), third(bad, False), third(good, True), third(good, False)
    while grow_bad and len(rules) < most_rules:
        tests = _grow(grow_bad, grow_good, features, most_tests, most_cuts)
        while len(tests) > 1 and _worth(tests[:-1], prune_bad, prune_good) >= _worth(tests, prune_bad, prune_good):
            tests = tests[:-1]
        hit = lambda r, tests=tests: all(t.holds(r) for t in tests)
        p, n = sum(map(hit, grow_bad + prune_bad)), sum(map(hit, grow_good + prune_good))
        if not tests or p == 0 or p / (p + n) < least_precision:
            break
        rules.append(tests)
        grow_bad, prune_bad = [r for r in grow_bad if not hit(r)], [r for r in prune_bad if not hit(r)]
    return rules


def rule_column(rules: Sequence[Sequence[Test]]) -> Column:
    """0-based number of the first rule that fires, null if none does."""
    out = None
    for i, tests in enumerate(rules):
        fires = F.lit(True)
        for t in tests:
            fires = fires & t.column()
        out = F.when(fires, i) if out is None else out.when(fires, i)
    return F.lit(None).cast("int") if out is None else out


def train_rules(docs: DataFrame, labels: DataFrame, per_class: int = 600) -> list[list[Test]]:
    """Learns from at most ``per_class`` training documents of each ``labels.quality``."""
    rows = {}
    for value in (0, 1):
        sample = with_statistics(labelled_sample(docs, labels, "quality", value, per_class))
        picked = sample.select("doc_id", *[c.alias(n) for n, c in ratios().items()]).collect()
        rows[value] = [r.asDict() for r in sorted(picked)]
    return learn_rules(rows[0], rows[1])


def judge(docs: DataFrame, rules: Sequence[Sequence[Test]], least_words: int = 50, most_repeat_percent: int = 50) -> DataFrame:
    """Adds the statistics, ``base_failed``, ``rule`` (the rejecting rule's number) and ``kept``."""
    df = with_statistics(docs.drop("base_failed", "kept", "rule"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn("rule", rule_column(rules))
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op9_quality_rules(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = train_rules(docs, read_table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", *STATS, "base_failed", "kept", "rule")


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES: dict[str, str] = {}
