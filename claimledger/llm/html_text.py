"""Main-text extraction by a maximum-scoring contiguous region.

A page becomes a stream of words and tags.  Every word scores the log-odds, learnt from labelled pages,
that a block of text like its own is article text: by the tags and the class, id and role names of the
containers around it (other weights inside ``article`` and ``main``), the kind and length of the block,
and the share of its words in links.  Words of blocks that are likelier something else score nothing.
Every tag scores negative, the log of the share of its kind that stands in articles.  One linear scan (Kadane's)
finds the contiguous region of the greatest sum; its edges leave out stray blocks that cost more tags
than they have words.  Blocks inside it whose own words score nothing are left out; the tags of their containers score nothing
either, so that no length of an interruption parts the region.

Null html gives empty text, as do pages in which no word scores above zero.  Nothing is capped; each
page is handled alone, so repeated rows and ties (first region wins) are safe, and an empty table gives an empty one.
Columns other than the html pass through; those named like the result's are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import fresh_names, read_table

#: Fixed values of HTML: elements whose content is no text of the page, void elements, and block elements.
DROPPED = frozenset("head script style noscript template svg iframe canvas select textarea button title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
NAME_WORD = re.compile(r"[a-z]+")
#: Containers around a block that are features of its words, and blocks whose kind is one.
CONTAINERS = BLOCKS - {"html", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "tbody", "thead", "tfoot", "tr", "td", "th", "li", "dt", "dd"}
ARTICLE = ("article", "main")


@dataclass(frozen=True)
class Context:
    """The containers around a piece of text: their features, whether one is ``article`` or ``main``, and whether it is text at all."""

    features: frozenset[str] = frozenset()
    inside: bool = False
    dropped: bool = False

    def enter(self, tag: str, attrs: str) -> Context:
        if tag in DROPPED:
            return Context(self.features, self.inside, True)
        if tag in ARTICLE and not self.inside:
            return Context(self.features | {"in:article"}, True, self.dropped)
        found = set()
        if tag in CONTAINERS:
            found.add(tag)
            if attrs and "=" in attrs:
                for m in NAMED.finditer(attrs):
                    found.update(f"name:{w}" for w in NAME_WORD.findall((m[1] or m[2] or m[3] or "").lower()))
        if not found:
            return self
        side = "inside" if self.inside else "outside"
        return Context(self.features | {f"{side}:{x}" for x in found}, self.inside, self.dropped)


@dataclass
class Stream:
    """pieces: (context, block, kind of block, in a link?, text, offset); events: the order in which pieces and tags come."""

    pieces: list[tuple[Context, int, str, bool, str, int]] = field(default_factory=list)
    events: list[tuple[str, object, Context, int]] = field(default_factory=list)


def tokenize(page: str) -> Stream:
    """One pass over the page; unclosed and misnested tags are closed by their ancestors' ends."""
    out, block, at = Stream(), 0, 0
    stack: list[tuple[str, Context, str]] = []
    context, kind, opened = Context(), "", Counter()

    def text(upto: int) -> None:
        if upto > at and not context.dropped:
            out.pieces.append((context, block, kind, opened["a"] > 0, page[at:upto], at))
            out.events.append(("text", len(out.pieces) - 1, context, at))

    for m in TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if m["close"] or m["close2"] or tag in VOID:
            out.events.append(("tag", tag, context, m.start()))
        if tag == "br" and not context.dropped:
            out.pieces.append((context, block, kind, False, " ", m.start()))
            out.events.append(("text", len(out.pieces) - 1, context, m.start()))
        if tag in BLOCKS:
            block += 1
        if tag in VOID:
            continue
        if m["close"] or m["close2"]:
            if opened[tag]:
                while True:
                    name, context, kind = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
        elif attrs.endswith("/"):
            out.events.append(("tag", tag, context, m.start()))
        else:
            if tag == "p" and stack and stack[-1][0] == "p":
                name, context, kind = stack.pop()
                opened[name] -= 1
            stack.append((tag, context, kind))
            opened[tag] += 1
            context = context.enter(tag, attrs)
            kind = tag if tag in BLOCKS else kind
            out.events.append(("tag", tag, context, m.start()))
    text(len(page))
    return out


def block_features(s: Stream) -> dict[int, tuple[frozenset[str], int]]:
    """Of each block with words: its features and its number of words."""
    words, linked, first = Counter(), Counter(), {}
    for context, block, kind, link, text, _ in s.pieces:
        n = len(text.split())
        words[block] += n
        linked[block] += n if link else 0
        first.setdefault(block, (context, kind))
    out = {}
    for block, n in words.items():
        if n:
            context, kind = first[block]
            length = "short" if n < 10 else "long" if n >= 25 else "middle"
            share = "all" if linked[block] == n else "most" if 2 * linked[block] > n else "few"
            side = "inside" if context.inside else "outside"
            out[block] = context.features | {f"is:{kind}", f"{side}:{length}", f"{side}:links:{share}"}, n
    return out


# ---- labelled pages --------------------------------------------------------------------------------

#: Names that pages give to containers: of articles and their parts, of parts of other things whatever
#: they hold, and of things that are sometimes a part of an article.
ARTICLE_NAMES = "content post entry story text body page main article column wrapper container prose".split()
OTHER_NAMES = (
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos cookie cookies consent gdpr popup modal masthead sidebar "
    "breadcrumb breadcrumbs pagination pager toolbar navbar newsletter subscribe signup comment comments reply replies respond disqus complementary contentinfo"
).split()
MIXED_NAMES = "banner notice notices alert overlay nav navigation menu menus header footer side aside widget related recommended share sharing social login search form forms discussion copyright legal skip".split()
OTHER_TAGS = "nav header footer aside form menu dialog".split()


def _prose(n: int) -> str:
    return "word " * n


def _links(n: int) -> str:
    return "<ul>" + "<li><a href='/'>some link</a></li>" * n + "</ul>"


def labelled_pages() -> list[list[tuple[str, int]]]:
    """Training pages, made by rule: parts of a page in order, each with 1 if it is article text.

    Every wrapper of an article meets every kind of other part, before, inside and after it.
    """
    bodies = (
        ["<h1>A title of words</h1>", f"<p>{_prose(40)}</p>", "<p>Short one.</p>", f"<p>{_prose(18)} <a href='/'>link</a></p>", f"<h3>Part</h3><p>{_prose(60)}</p>"],
        ["<h1>Title</h1>", f"<p>{_prose(30)}", f"<p>{_prose(12)}", "<h2>Part</h2>", f"<ul><li>{_prose(6)}</li><li>item</li></ul>", f"<p>{_prose(35)}</p>", "<h4>End</h4>", "<p>few</p>"],
        [f"<h1>{_prose(6)}</h1>", f"<blockquote>{_prose(15)}</blockquote>", f"<section><h2>Two words</h2><p>{_prose(28)}</p></section>", "<pre>some code here</pre>", "<p><a href='/'>one link</a></p>"],
        [f"<div>{_prose(30)}</div>", f"<figure><img><figcaption>{_prose(7)}</figcaption></figure>", f"<table><tr><th>name</th><td>{_prose(3)}</td></tr></table>", f"<dl><dt>term</dt><dd>{_prose(9)}</dd></dl>", f"<div>{_prose(12)}</div>", "<div>few</div>"],
    )
    wrappers = [("", ""), ("<div>", "</div>"), ("<section>", "</section>")]
    wrappers += [(f"<div class='{n}'>", "</div>") for n in ARTICLE_NAMES] + [(f"<div id='{n}-{m}'><div>", "</div></div>") for n, m in zip(ARTICLE_NAMES, ARTICLE_NAMES[1:], strict=False)]
    inner = ["few", f"{_prose(12)}", f"<p>{_prose(40)}</p>", f"<h2>Title</h2><p>{_prose(15)}</p><div>{_prose(45)}</div>", _links(6), "<a href='/'>here</a>", "<h3>Title</h3>" + _links(3), "<h1>Name</h1>", "<p>Short text</p>"]
    others = [f"<{t}>{x}</{t}>" for t in OTHER_TAGS for x in inner] + [f"<div class='{n}'>{x}</div>" for n in OTHER_NAMES for x in inner]
    loose = [_links(8), "<div>" + _links(5) + "</div>", "<p>" + "<a href='/'>go</a> " * 6 + "</p>", "<ul><li>" + "<a href='/'>go</a> " * 2 + "</li></ul>"]
    loose += [f"<div class='{n}'>{x}</div>" for n in MIXED_NAMES for x in ("few", f"{_prose(12)}", "<p>Short text</p>", "<h3>Title</h3>" + _links(3), _links(6))]
    pages = []
    for i, other in enumerate(others + loose):
        for k in range(3):  # inside article or main, or one of the other wrappers
            body, cut = bodies[(i + k) % 4], (i + k) % 3 + 1
            whole = ARTICLE[i % 2] if k == 0 else ""
            tag, end = (f"<{whole}>", f"</{whole}>") if whole else wrappers[(i * 7 + 5 * k) % len(wrappers)]
            middle = (other, 0)
            if whole and i >= len(others):  # such a part belongs to the article it stands in
                middle = (f"<div class='{MIXED_NAMES[i % len(MIXED_NAMES)]}'><p>{_prose(1 + i % 40)}</p></div>", 1)
            elif whole and other.startswith("<header"):
                middle = (f"<header><h1>{_prose(6)}</h1><p>{_prose(3 + i % 20)}</p></header>", 1)
            pages.append([("<body>" + others[(i * 3 + k) % len(others)], 0), (tag + "".join(body[:cut]), 1), middle, ("".join(body[cut:]) + end, 1), ((others + loose)[(i * 5 + 1) % len(others)] + "</body>", 0)])
    for n in MIXED_NAMES:  # long prose is an article under any such name
        pages.append([("<body>" + _links(5), 0), (f"<p>Intro</p><div id='{n}'>{bodies[0][1]}{bodies[0][4]}</div><p>End</p>", 1), (f"<div class='{n}'>{_links(4)}</div></body>", 0)])
        pages.append([(f"<article><section id='{n}'><h2>{n}</h2><p>few words</p><p>{_prose(35)}</p></section></article>", 1)])
    pages += [[(b, 1)] for b in (*("".join(x) for x in bodies), "plain words", "plain words alone stand here too", "<p>one word</p>" * 3, "<p>word</p><p>word</p>")] * 8
    return pages


# ---- learning and scanning -------------------------------------------------------------------------


@dataclass(frozen=True)
class Weights:
    """Log-odds by feature of a block, the intercept, and the score of each tag."""

    words: dict[str, float]
    intercept: float
    tags: dict[str, float]

    def of_block(self, features: Iterable[str]) -> float:
        return self.intercept + sum(self.words.get(f, 0.0) for f in features)

    def of_container(self, context: Context) -> float:
        """Log-odds from the containers alone."""
        return sum(self.words.get(f, 0.0) for f in context.features)

    def of_tag(self, tag: str) -> float:
        return self.tags.get(tag, math.log(0.5))


def learn_weights(pages: Iterable[Iterable[tuple[str, int]]] | None = None, l2: float = 0.1, steps: int = 25, smooth: float = 1.0) -> Weights:
    """Logistic regression over blocks (Newton steps to convergence) and smoothed shares of tags in articles."""
    rows: dict[tuple[frozenset[str], int], int] = Counter()
    inside, all_ = Counter(), Counter()
    for page in pages if pages is not None else labelled_pages():
        parts = list(page)
        s = tokenize("".join(p for p, _ in parts))
        ends = np.cumsum([len(p) for p, _ in parts])
        label = lambda at, ends=ends, parts=parts: parts[min(int(np.searchsorted(ends, at, side="right")), len(parts) - 1)][1]
        where = {}
        for _, block, _, _, text, at in s.pieces:
            if text.strip():
                where.setdefault(block, label(at))
        for block, (features, _) in block_features(s).items():
            rows[features, where[block]] += 1
        for kind, what, _, at in s.events:
            if kind == "tag":
                all_[what] += 1
                inside[what] += label(at)
    names = sorted({f for features, _ in rows for f in features})
    if not names:
        return Weights({}, 0.0, {})
    number = {f: i for i, f in enumerate(names)}
    x, y, weight = np.zeros((len(rows), len(names) + 1)), np.zeros(len(rows)), np.zeros(len(rows))
    for i, ((features, good), n) in enumerate(sorted(rows.items(), key=lambda r: (sorted(r[0][0]), r[0][1]))):
        x[i, [number[f] for f in features]] = 1.0
        x[i, -1], y[i], weight[i] = 1.0, good, n
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(len(names), l2), 1e-6)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    tags = {t: math.log((inside[t] + smooth) / (n + 2 * smooth)) for t, n in all_.items()}
    return Weights(dict(zip(names, w.tolist(), strict=False)), float(w[-1]), tags)


@cache
def usual_weights() -> Weights:
    return learn_weights()


def scores(s: Stream, w: Weights) -> tuple[list[float], set[int]]:
    """(score of each event, blocks whose words score above zero)."""
    blocks = {b: w.of_block(features) for b, (features, _) in block_features(s).items()}
    good = {b for b, v in blocks.items() if v > 0}
    container: dict[Context, bool] = {}
    out = []
    for kind, what, context, _ in s.events:
        if kind == "text":
            _, block, _, _, text, _ = s.pieces[what]
            out.append(blocks[block] * len(text.split()) if block in good else 0.0)
            continue
        if context not in container:
            container[context] = not context.dropped and w.of_container(context) + w.intercept > 0
        out.append(w.of_tag(what) if container[context] else 0.0)
    return out, good


def best_region(values: Iterable[float]) -> tuple[int, int]:
    """(first, last) event of the region of the greatest sum; (0, -1) if no sum is above zero."""
    best, best_at, run, start = 0.0, (0, -1), 0.0, 0
    for i, v in enumerate(values):
        run += v
        if run <= 0.0:
            run, start = 0.0, i + 1
        elif run > best:
            best, best_at = run, (start, i)
    return best_at


def main_text(page: str | None, w: Weights) -> str:
    if not page:
        return ""
    s = tokenize(page)
    values, good = scores(s, w)
    first, last = best_region(values)
    blocks: dict[int, list[str]] = {}
    for kind, what, _, _ in s.events[first : last + 1]:
        if kind == "text" and s.pieces[what][1] in good:
            blocks.setdefault(s.pieces[what][1], []).append(s.pieces[what][4])
    lines = (" ".join(entities.unescape("".join(parts)).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text", labelled=None) -> DataFrame:
    """``pages`` without ``html_col``, with its main text and the text's code points ``n_chars``.

    ``labelled`` are pages in parts, [(html, is it article?), ...]; without them ``labelled_pages`` teach.
    """
    weights = usual_weights() if labelled is None else learn_weights(labelled)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: main_text(x, weights) if isinstance(x, str) else "").astype(object)

    (text,) = fresh_names(pages, "text")
    df = pages.withColumn(text, extract(F.col(html_col))).drop(html_col, "n_chars", *([out] if text != out else []))
    return df.withColumnRenamed(text, out).withColumn("n_chars", F.char_length(out).cast("long"))


def op2_html_text(spark, sf_dir):
    return extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op2_html_text": op2_html_text}
ORACLES: dict[str, str] = {}
