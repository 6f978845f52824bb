"""Rules as data (C1-C3, D2): lists of patterns folded into one expression per flag."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimledger.functions.scalars import WIDE_SPACE


@dataclass(frozen=True)
class Rule:
    """``flag`` is what a classifying rule sets; None makes it a denial."""

    name: str
    pattern: str
    flag: str | None = None
    #: Lower-case texts of which a match holds one; where none occurs the pattern is not tried.
    needles: tuple[str, ...] = ()


W, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: White space of any script, as F19 has it.
S = WIDE_SPACE
FLAGS = ("extension", "correction", "withdrawal", "reopening")
#: The notice vocabulary, each alternative a whole word.
NOTICE_RULES = (
    Rule("extension", rf"(?i){W}(extension|extend|extended|extending){E}", "extension"),
    Rule("correction", rf"(?i){W}(correction|correct|corrected|correcting){E}", "correction"),
    Rule("withdrawal", rf"(?i){W}(withdraw|withdrawal|withdrawn|withdrawing){E}", "withdrawal"),
    Rule("reopening", rf"(?i){W}(reopen|reopened|reopening|reopens){E}", "reopening"),
)
#: Land withdrawals, which are no comment-period notices.
DENIALS = (
    Rule("land order", rf"(?i){W}public{S}+lands?{S}+orders?{E}"),
    Rule("land withdrawal", rf"(?i){W}land({S}|-)?withdrawal{E}"),
    Rule("withdrawal of lands", rf"(?i){W}withdraw(al{S}+of|s|ing)?{S}+((certain|public|national|forest|system){S}+)*lands?{E}"),
    Rule("forest withdrawal", rf"(?i){W}national{S}+forest{E}[^.]*{W}withdrawal{E}|{W}withdrawal{E}[^.]*{W}national{S}+forest{E}"),
    Rule("notice of withdrawal", rf"(?i){W}notice{S}+of{S}+(proposed{S}+)?withdrawal{E}"),
)


def matches(text: Column, rules: Sequence[Rule]) -> Column:
    """True if any pattern occurs; false for null."""
    low = F.lower(text)

    def found(r: Rule) -> Column:
        near = reduce(or_, [F.contains(low, F.lit(n)) for n in r.needles]) if r.needles else F.lit(True)
        return F.coalesce(near & text.rlike(r.pattern), F.lit(False))

    return reduce(or_, map(found, rules), F.lit(False))


def notice_flags(text: Column, rules: Sequence[Rule] = NOTICE_RULES, flags: Sequence[str] = FLAGS) -> dict[str, Column]:
    """A boolean per flag; several can be true, denials play no part."""
    return {f: matches(text, [r for r in rules if r.flag == f]) for f in flags}


def primary_haystack(title: Column, kind: Column, action: Column) -> Column:
    """C2 for the primary source."""
    return F.concat_ws(" \n ", *[F.coalesce(c, F.lit("")) for c in (title, kind, action)])


def status_haystack(title: Column, kind: Column) -> Column:
    """C2 for the status source, whose withdrawal flag is also set by its own boolean."""
    return F.concat_ws(" \n ", *[F.coalesce(c, F.lit("")) for c in (title, kind)])


def is_denied(title: Column, dates_text: Column, rules: Sequence[Rule] = DENIALS) -> Column:
    """C3 over title and dates text."""
    return matches(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(dates_text, F.lit(""))), rules)
