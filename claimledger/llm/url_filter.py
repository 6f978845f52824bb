"""URL filter: host/path rules first, then logistic regression on hashed character n-grams.

The regression is trained on the driver, to convergence, from a small labelled URL table
(``labelled_urls`` or the caller's own) and its weight vector, of fixed size, goes to the tasks that score the URLs.
Null URLs and URLs without ``://`` have an empty host and path; no rule fits those and the model
scores them by its intercept and the empty parts.  Repeated rows are judged one by one, extra columns pass through (those
named like the five that are set are replaced), an empty table gives an empty one.  URLs of any length are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import fresh_names, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words of hosts and paths that are unwanted, and ones that are not; the training URLs are made of them.
BAD_WORDS = (
    "casino poker slots jackpot roulette betting bets gamble lottery pills pharmacy viagra cialis steroids adult xxx porn sex cams escort nude dating torrent crack keygen warez "
    "serial replica bet wager payday loans malware phishing spyware virus spam scam ads adserver banner tracker track clicks popunder affiliate"
).split()
GOOD_WORDS = (
    "news blog library school science museum docs wiki weather city forum health music travel garden history books recipes sports theatre maps physics archive council garage "
    "bakery river mountain letters painting radio journal village market chess poetry biology cycling kitchen station"
).split()
#: Words that stand with either.
NEUTRAL_WORDS = "win free cheap best top online live my the fast hot x 24 777 world home center point shop club store one".split()
#: Plain words and names that hold an unwanted word by chance.
CHANCE_WORDS = (
    "essex sussex middlesex wessex sextant sextet bisexual alphabet better betterment tibet abettor diabetes racetrack trackandfield soundtrack tracksuit railtracks backtrack adulthood adultlearning cameras camshaft "
    "webcams scampi scamper brandads adsorption adstream roads uploads heads dateline datingrocks carbondating firecracker nutcracker crackling cracked serials cereals spamalot hotspam seriality torrential "
    "genealogy loansharks slotted timeslots pokerface pokers wagers stagewager lotterytickets pillsbury caterpillars spillsafe nudelman denude pornic popcorn antivirus viruses castle castor casual cascade village pillar pillow potters ottery keyboard keynote bannerman stripclub"
).split()
#: Syllables of invented plain words.
SYLLABLES = "ba dor fi gu kel mo na rus vi zan pol quin tem jul vos mar heg nik fen lud bra cor dim".split()
ENDINGS = "um ix ard ula ek in ovo ette is ana ur".split()
PATHS = ("", "/", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/index.html", "/page/{}", "/a/{}", "/en/{}.html", "/de/{}", "/item/{}", "/story-{}.html", "/view/{}/", "/fr/{}.html", "/es/{}/", "/de/{}/", "/en/{}/", "/p/{}")


def labelled_urls() -> list[tuple[str, str, int]]:
    """Invented training URLs, made by rule: (host, path, 1 for unwanted).

    Every unwanted host has wanted twins with the same subdomain, domain and path, so that these tell
    nothing: unwanted words meet neutral ones in the one, plain words and syllables without meaning in
    the other.  Other pairs are of unwanted and plain words in the paths of plain hosts.
    """
    subs, tlds = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org", "test", "invalid")
    pick = lambda xs, i: xs[i % len(xs)]
    nonsense = lambda i: "".join(pick(SYLLABLES, (i + 1) * (3 * j + 5) + i // 7 * j) for j in range(2 + i % 3))
    rows = []
    for i, w in enumerate(BAD_WORDS):
        n, m, good = pick(NEUTRAL_WORDS, i), pick(NEUTRAL_WORDS, i + 5), pick(GOOD_WORDS, i)
        shapes = ("{w}", "{w}-{n}", "{n}-{w}", "{n}{w}", "{w}{m}", "{w}-{v}", "{v}{n}{w}", "{w}{v}", "{w}-{m}", "{m}-{w}", "{w}{n}", "{n}-{w}-{m}")
        for k, shape in enumerate(shapes):
            j = len(rows)
            sub, tld, path = pick(subs, j // 2 + k), pick(tlds, j // 2), pick(PATHS, j // 2 + i).format(j * 7919 % 99991)
            for label, word, other in ((1, w, pick(BAD_WORDS, i + 7)), (0, good, nonsense(j + 1)), (0, nonsense(j), pick(GOOD_WORDS, j)), (0, nonsense(j + 2) + pick(ENDINGS, j), nonsense(j + 3))):
                rows.append((f"{sub}{shape.format(w=word, n=n, m=m, v=other)}.{tld}", path, label))
        for k, shape in enumerate(("/{w}/{i}", "/{n}-{w}.html")):
            host = f"{pick(subs, i + k)}{good if k else nonsense(i)}.{pick(tlds, i)}"
            rows += [(host, shape.format(w=x, n=n, i=i * 311 % 997), label) for label, x in ((1, w), (0, pick(GOOD_WORDS, i + 3)), (0, pick(GOOD_WORDS, i + 11)), (0, nonsense(i + k)))]
    for i, w in enumerate(CHANCE_WORDS):
        for k, shape in enumerate(("{w}", "www.{w}", "{n}-{w}", "{w}{n}", "{w}-{v}")):
            path, tld = pick(PATHS, i + 3 * k).format(i * 7919 % 99991), pick(tlds, i + k)
            make = lambda word, shape=shape, j=i + k: shape.format(w=word, n=pick(NEUTRAL_WORDS, j), v=pick(GOOD_WORDS, j))
            rows += [(f"{make(x)}.{tld}", path, label) for label, x in ((0, w), (0, nonsense(i + 7 * k)), (1, pick(BAD_WORDS, i + k)))]
        rows.append((f"{pick(GOOD_WORDS, i)}.{pick(tlds, i)}", f"/{w}/{i}", 0))
    # unwanted words run together with plain or meaningless ones, and plain twins of the same make
    wide = (*tlds, "io", "co", "tv", "biz", "info", "eu", "de", "fr", "org.uk")
    for i, w in enumerate(BAD_WORDS):
        for k, shape in enumerate(("{w}{x}", "{x}{w}", "{w}{g}", "{g}{w}", "{w}{x}-{g}", "{x}{w}{y}")):
            j = 6 * i + k
            make = lambda word, shape=shape, j=j: shape.format(w=word, x=nonsense(3 * j), y=nonsense(3 * j + 1), g=pick(GOOD_WORDS, j))
            tld, path = pick(wide, j), pick(PATHS, j).format(j)
            rows += [(f"{make(x)}.{tld}", path, label) for label, x in ((1, w), (0, pick(GOOD_WORDS, i + k + 1)), (0, nonsense(5 * j + 2)), (0, pick(CHANCE_WORDS, j)))]
    # unwanted names with a number
    numbers = [(i, w, k, n) for i, w in enumerate(BAD_WORDS) for k, n in enumerate(("365", "88", "24-7"))]
    rows += [(f"{x}{n}.{pick(tlds, i + k)}", pick(PATHS, i + k).format(i), label) for i, w, k, n in numbers for label, x in ((1, w), (0, pick(GOOD_WORDS, i)), (0, nonsense(i + k)))]
    # hosts without a word of their own
    return rows + [(pick(subs, i // 5) + pick(tlds, i), pick(PATHS, i // 3).format(i * 7919 % 99991), 0) for i in range(3 * len(PATHS))]


def url_host(url: Column) -> Column:
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    return F.translate(part, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def rule_columns(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, both null if none fits.

    Of rules of one length the alphabetically first wins.
    """
    rule, verdict = None, None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


DIGITS = str.maketrans("123456789", "0" * 9)


def ngram_buckets(host: str, path: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of the character 3- to 5-grams of ``<host>`` and ``<path>``, each with its own prefix, any digit read as 0.

    The values of either part have length 1 together, so a long path does not thin out a host, nor the other way round.
    """
    size, buckets, values = 1 << bits, [], []
    for mark, text in (("h", f"<{host}>"), ("p", f"<{path}>")):
        raw = text.translate(DIGITS).encode("utf-8", "surrogatepass")
        found = [zlib.crc32(raw[i : i + n], ord(mark)) % size for n in (3, 4, 5) for i in range(len(raw) - n + 1)]
        buckets += found
        values += [max(1, len(found)) ** -0.5] * len(found)
    return np.asarray(buckets, dtype=np.int64), np.asarray(values)


def train_url_model(table: Iterable[tuple[str, str, int]] | None = None, bits: int = 16, l2: float = 1e-5, most_steps: int = 2000, tolerance: float = 1e-5) -> np.ndarray:
    """Logistic regression by accelerated gradient steps on all rows until the gradient is below ``tolerance``; the last weight is the intercept.

    A table without rows gives weights of zero.
    """
    rows = list(labelled_urls() if table is None else table)
    out = np.zeros((1 << bits) + 1)
    if not rows:
        return out
    grams = [ngram_buckets(host, path, bits) for host, path, _ in rows]
    column, value = np.concatenate([b for b, _ in grams]), np.concatenate([v for _, v in grams])
    sizes = np.array([len(b) for b, _ in grams])
    row, begins = np.repeat(np.arange(len(rows)), sizes), np.cumsum(sizes) - sizes
    y = np.asarray([r[2] for r in rows], dtype=np.float64)
    longest = np.bincount(row, weights=value**2).max() + 1.0  # a row's squared length is at most this, repeats of an n-gram apart
    w = v = out
    step = 1.0 / (0.5 * longest + l2)
    for t in range(most_steps):
        off = 1.0 / (1.0 + np.exp(-(np.add.reduceat(value * v[column], begins) + v[-1]))) - y
        gradient = np.bincount(column, weights=value * off[row], minlength=len(v)) / len(y) + l2 * v
        gradient[-1] = off.mean()
        if np.abs(gradient).max() < tolerance:
            break
        ahead = v - step * gradient
        w, v = ahead, ahead + t / (t + 3) * (ahead - w)
    return v


@cache
def usual_model() -> np.ndarray:
    return train_url_model()


def score_urls(df: DataFrame, host_col: str, path_col: str, weights: np.ndarray, out: str = "score") -> DataFrame:
    """Adds the model's probability that the URL is unwanted."""
    bits = int(len(weights) - 1).bit_length() - 1
    w = weights.astype(np.float64)

    @F.pandas_udf("double")
    def model(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            out = np.empty(len(hosts))
            for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                found, values = ngram_buckets(h or "", p or "", bits)
                out[i] = w[-1] + w[found] @ values
            yield pd.Series(1.0 / (1.0 + np.exp(-out)))

    return df.withColumn(out, model(F.col(host_col), F.col(path_col)))


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES, table=None, threshold: float = 0.5) -> DataFrame:
    """Keeps ``pages``' columns other than the five it sets: host, path, rule, score, verdict."""
    weights = usual_model() if table is None else train_url_model(table)
    url, by_rule = fresh_names(pages, "url_read", "by_rule")
    df = pages.withColumn(url, F.col(url_col)).drop("host", "path", "rule", "score", "verdict")
    df = df.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url))).drop(url)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    df = score_urls(df.withColumn("rule", rule).withColumn(by_rule, verdict), "host", "path", weights)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return df.withColumn("verdict", F.coalesce(by_rule, by_model)).drop(by_rule)


def op1_url_filter(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES: dict[str, str] = {}
