"""Scalar expressions (F1-F29): every function takes and returns Columns, none can fail under ANSI mode."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
ENTITY_PREFIX = "ocd-participation-window/federal/"
#: White space as the sources' regex dialect knows it: ASCII, no-break and zero-width spaces, separators.
WIDE_SPACE = r"[\s\x{00A0}\x{FEFF}\p{Z}]"
#: State names looked for in titles.
STATES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois",
    "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana",
    "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon",
    "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington", "West Virginia",
    "Wisconsin", "Wyoming",
)


def instant(value: datetime | str) -> Column:
    """A literal instant; ``now`` is always a parameter, never the wall clock."""
    return F.lit(value).cast("timestamp")


def canonical_hash(raw_json: Column) -> Column:
    """sha-256 of the JSON with sorted keys; null for text that is not JSON."""
    return parsed_hash(F.try_parse_json(raw_json))


def parsed_hash(v: Column) -> Column:
    """F1 of JSON that is parsed already."""
    return F.sha2(F.to_json(v).cast("binary"), 256)


def content_hash(fields: dict[str, Column]) -> Column:
    """sha-256 over the known fields in alphabetical order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def entity_key(document: Column, object_id: Column) -> Column:
    """the document number wins, else ``regs:`` and the object id, else null."""
    some = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(F.concat(F.lit(ENTITY_PREFIX), some(document)), F.concat(F.lit(ENTITY_PREFIX + "regs:"), some(object_id)))


def is_entity_key(key: Column) -> Column:
    """V2: the shape of an entity key; false for null."""
    return F.coalesce(key.rlike("^" + ENTITY_PREFIX + r"(regs:)?[^\s:/]+$"), F.lit(False))


def json_string(v: Column, path: str) -> Column:
    """a non-empty JSON string at ``path``; null for numbers, booleans and the rest."""
    at = F.try_variant_get(v, path, "variant")
    return F.when((F.schema_of_variant(at) == "STRING") & (F.try_variant_get(v, path, "string") != ""), F.try_variant_get(v, path, "string"))


def json_bool(v: Column, path: str) -> Column:
    """a JSON boolean at ``path``; null for anything else, ``"true"`` included."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def json_strings(v: Column, path: str) -> Column:
    """the string elements of a JSON array at ``path``; empty for anything else."""
    items = F.try_variant_get(v, path, "array<variant>")
    kept = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(kept, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def calendar_date(text: Column) -> Column:
    """``text`` if it is yyyy-mm-dd and a real day, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def utc_instant(text: Column) -> Column:
    """ISO instant with offset; null when malformed or rolled over."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), text))


def has_offset(text: Column) -> Column:
    """false for naive or date-only instants, which a differential must refuse."""
    return F.coalesce(text.rlike(r"[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"), F.lit(False))


def new_york_date(ts: Column) -> Column:
    """the calendar day in New York."""
    return F.to_date(F.from_utc_timestamp(ts, NEW_YORK))


def end_of_new_york_day(day: Column) -> Column:
    """F8: the instant of 23:59:59 in New York on a date (or date string that F5 let through)."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" 23:59:59"))), NEW_YORK)


def days_ago(now: Column, n: int) -> Column:
    """the New York day ``n`` days before ``now``."""
    return F.date_sub(new_york_date(now), n)


def lower_bound(cursor: Column, hours: int = 6) -> Column:
    """where an incremental read starts again."""
    return cursor - F.make_interval(hours=F.lit(hours))


def eastern_text(ts: Column) -> Column:
    """an instant as New York wall-clock text."""
    return F.date_format(F.from_utc_timestamp(ts, NEW_YORK), "yyyy-MM-dd HH:mm:ss")


def reliance_url(publication_date: Column, document: Column) -> Column:
    """null unless both parts are there and not empty.  The form of the address is a fixed value."""
    url = F.format_string("https://www.govinfo.gov/content/pkg/FR-%s/html/%s.htm", publication_date, document)
    return F.when((publication_date != "") & (document != ""), url)


def close_display(day: Column, inferred: bool = True) -> Column:
    """F13, fixed values: ``inferred`` from a date alone, or as the status source has it."""
    tail = " at 11:59 p.m. ET (inferred from FR date-only value)" if inferred else " (per Regulations.gov)"
    return F.concat(F.lit("closes "), day.cast("string"), F.lit(tail))


def same_close(a: Column, b: Column) -> Column:
    """null equals null."""
    return a.eqNullSafe(b)


def same_instant(a: Column, b: Column) -> Column:
    """null never equals."""
    return F.coalesce(a == b, F.lit(False))


def clean_list(items: Column) -> Column:
    """trimmed, blanks dropped; null becomes empty."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def first_or_null(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def references(text: Column, document: Column) -> Column:
    """F16: ``document`` occurs as a whole token, with an optional space after its first hyphen."""
    head, tail = F.substring_index(document, "-", 1), F.regexp_extract(document, "^[^-]*-(.*)$", 1)
    quoted = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    body = F.when(document.contains("-"), F.concat(quoted(F.concat(head, F.lit("-"))), F.lit(WIDE_SPACE + "?"), quoted(tail))).otherwise(quoted(document))
    return F.coalesce(F.regexp_like(text, F.concat(F.lit(r"(?<![\w-])"), body, F.lit(r"(?![\w-])"))) & (document != ""), F.lit(False))


def one_pattern(names: Sequence[str]) -> str:
    """The names as one regular expression whose shared beginnings are written once; of several at a place the longest is taken.

    At each letter it branches to the few that go on, so trying it costs about the same for fifty names as for thousands.
    """
    root: dict = {}
    for name in names:
        node = root
        for ch in name:
            node = node.setdefault(ch, {})
        node[""] = {}

    def write(node: dict) -> str:
        parts = [re.escape(ch) + write(node[ch]) for ch in sorted(node) if ch]
        if not parts:
            return ""
        return (parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})") + ("?" if "" in node else "")

    return write(root)


def names_in(text: Column, names: Sequence[str], whole_words: bool = True) -> Column:
    """the names that occur, in the order given, in one pass over the text; empty for null.

    Names may overlap, and one may be the beginning of another.  ``whole_words``: no letter, digit or underscore stands beside them.
    """
    names = list(dict.fromkeys(n for n in names if n))
    if not names:
        return F.array().cast("array<string>")
    before, behind = (r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])") if whole_words else ("", "")
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{before}(?=({one_pattern(names)}){behind})"), 1))
    # a name at whose place a longer one was taken
    ordered, short = sorted(names), {}
    for i, n in enumerate(ordered):
        for longer in itertools.takewhile(lambda x, n=n: x.startswith(n), ordered[i + 1 :]):
            if not whole_words or not re.match(r"[A-Za-z0-9_]", longer[len(n)]):
                short.setdefault(n, []).append(longer)
    if short:
        found = F.concat(found, F.array_compact(F.array(*[F.when(F.arrays_overlap(found, F.array(*map(F.lit, longer))), n) for n, longer in short.items()])))
    return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(F.array_intersect(F.array(*map(F.lit, names)), found))


def keywords_in(text: Column, stems: Sequence[str]) -> Column:
    """the stems that occur, in the order given; empty for null."""
    return names_in(F.lower(text), stems, whole_words=False)


def keywords_of(a: Column, b: Column, stems: Sequence[str]) -> Column:
    """the joined list of two texts' stems, those of the first text first, each once."""
    return F.array_distinct(F.concat(keywords_in(a, stems), keywords_in(b, stems)))


def cascade(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """the name of the first (name, pattern) that matches."""
    out = None
    for name, pattern in rules:
        hit = F.coalesce(text.rlike(pattern), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default) if out is not None else F.lit(default)


def false_positive_hint(title: Column, keywords: Column) -> Column:
    """why a title that holds a keyword may be no comment deadline, by six ordered rules; empty if none fires.

    The patterns and hints are fixed values.
    """
    t, has = F.lower(F.coalesce(title, F.lit(""))), lambda k: F.array_contains(keywords, k)
    moves = t.rlike(r"\b(comment|deadline|comment period|reopen)\b")
    collection = t.rlike(r"\b(information collection|paperwork reduction|omb (review|control)|currently approved collection|collection of information)\b")
    land = t.rlike(r"\b(public land|land order|\bacres?\b|mineral|national forest|reclamation|grazing|bureau of land management|\bblm\b)\b")
    approval = t.rlike(r"\bwithdrawal of (the )?(approval|application)|abbreviated new drug|self-regulatory|securities exchange\b")
    return (
        F.when(has("extension") & collection & ~moves, "likely PRA/info-collection extension (not a docket comment deadline)")
        .when(has("withdraw") & land, "likely land-withdrawal FP (not a comment deadline)")
        .when(has("withdraw") & approval, "likely approval/application withdrawal (not a comment deadline)")
        .when(has("withdraw") & ~moves, "withdrawal — confirm it touches a comment period")
        .when(has("correction") & ~moves & ~t.rlike(r"\b(extend|extension)\b"), "likely editorial/technical correction")
        .otherwise("")
    )


def squeeze(text: Column) -> Column:
    """white space runs to one space, trimmed; null for blanks."""
    flat = F.trim(F.regexp_replace(text, WIDE_SPACE + "+", " "))
    return F.when(flat != "", flat)


#: F20, in order.
STAGE_RULES = (
    ("NOI", r"(?i)notice of intent"),
    ("Draft Supplement", r"(?i)draft supplement"),
    ("Final Supplement", r"(?i)final supplement"),
    ("Draft", r"(?i)draft"),
    ("Final", r"(?i)final"),
)


def stage(title: Column) -> Column:
    """F20."""
    return cascade(title, STAGE_RULES, "—")


def states_in(title: Column, names: Sequence[str] = STATES) -> Column:
    """names that occur as whole words, in the order given."""
    return F.when(title.isNotNull(), names_in(title, names)).otherwise(F.array().cast("array<string>"))


def topic_bucket(kind: Column, title: Column) -> Column:
    """impact-statement notice, rulemaking type, or null."""
    eis = (kind == "Notice") & title.rlike(r"(?i)environmental impact statement|(?<![A-Za-z0-9_])eis(?![A-Za-z0-9_])")
    return F.when(F.coalesce(eis, F.lit(False)), "EIS").when(kind.isin("Rule", "Proposed Rule"), "Rulemaking")


def quarters(today: Column, n: int) -> Column:
    """array of (label, start, end) of the last ``n`` quarters, the current one cut at ``today``."""
    start = F.trunc(today, "quarter")
    starts = F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda k: F.add_months(start, -3 * k))
    label = lambda s: F.concat(F.year(s).cast("string"), F.lit("Q"), F.quarter(s).cast("string"))
    return F.transform(starts, lambda s: F.struct(label(s).alias("label"), s.alias("start"), F.least(F.date_sub(F.add_months(s, 3), 1), today).alias("end")))


def short_error(message: Column, most: int = 500) -> Column:
    """F24."""
    return F.substring(message, 1, most)


def names_joined(json_array: Column) -> Column:
    """names of a JSON array of objects, joined by ' / '."""
    return F.array_join(F.transform(F.from_json(json_array, "array<struct<name: string>>"), lambda x: x["name"]), " / ")


def first_name(json_array: Column) -> Column:
    """the first object's name; null without one."""
    return F.get(F.transform(F.from_json(json_array, "array<struct<name: string>>"), lambda x: x["name"]), F.lit(0))


def moved_count(history: Column) -> Column:
    """how often a close moved; 0 for null."""
    return F.greatest(F.coalesce(F.size(history), F.lit(0)), F.lit(0))


def head(text: Column, most: int = 300) -> Column:
    """the first characters of a text."""
    return F.substring(text, 1, most)


def days_left(close: Column, now: Column) -> Column:
    """whole days to the close, rounded up, 0 at least."""
    return F.greatest(F.lit(0), F.ceil((F.unix_timestamp(close) - F.unix_timestamp(now)) / 86400))


def days_between(a: Column, b: Column) -> Column:
    """rounded difference in days."""
    return F.round((F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400).cast("long")


#: F28, fixed values: what is said of each confidence.
HIGH_TEXT = "Both sources carry this window and agree on the same Eastern calendar date — the strongest signal the rulebook awards."
MEDIUM_TEXT = "One usable source with no contradiction (or full agreement with a minor caveat%s). Reliable, but not independently confirmed."
LOW_BOTH_TEXT = (
    "Regulations.gov lists this record but supplies no usable close date%s, so the deadline rests on the Federal Register's date-only value with the standard 11:59 p.m. ET convention. "
    "LOW means: correct as far as one source goes — verify before relying on it."
)
LOW_ONE_TEXT = (
    "Only the Federal Register carries this notice — there is no Regulations.gov record to cross-check (common for information-collection notices where comments go to OMB or an email address instead). "
    "The closing time is inferred from a date-only value via the 11:59 p.m. ET convention. LOW means: correct as far as one source goes — verify before relying on it."
)
CLASH_TEXT = "The two sources currently disagree about this window. Both values are kept and shown; nothing is guessed silently."
UNKNOWN_TEXT = "Neither source supplies a usable close date, so no deadline is asserted at all — an honest unknown beats a fabricated date."


def confidence_text(confidence: Column, flags: Column, status_document: Column) -> Column:
    """an explanation of a confidence from the flags and the status source's document id."""
    named = F.coalesce(F.array_join(flags, ", "), F.lit(""))
    caveat = lambda form: F.when(named != "", F.format_string(form, named)).otherwise("")
    listed = F.coalesce(status_document != "", F.lit(False))
    return (
        F.when(confidence == "high", HIGH_TEXT).when(confidence == "medium", F.format_string(MEDIUM_TEXT, caveat(": %s")))
        .when((confidence == "low") & listed, F.format_string(LOW_BOTH_TEXT, caveat(" (%s)"))).when(confidence == "low", LOW_ONE_TEXT)
        .when(confidence == "conflicting", CLASH_TEXT).otherwise(UNKNOWN_TEXT)
    )


def display_with_date(display: Column, close: Column) -> Column:
    """the New York day in front, unless the text has a date already."""
    return F.when(display.rlike(r"\d{4}-\d{2}-\d{2}"), display).otherwise(F.concat_ws(" · ", new_york_date(close).cast("string"), display))
