from datetime import date, datetime

from pyspark.sql import functions as F

from claimledger.functions import rules as R
from claimledger.functions import scalars as S


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_calendar_dates(spark):
    got = values(spark, S.calendar_date(F.col("x")), ["2026-02-28", "2026-02-30", "2026-13-01", "2026-6-1", "", None, "2024-02-29"])
    assert got == ["2026-02-28", None, None, None, None, None, "2024-02-29"]


def test_instants(spark):
    got = values(spark, S.utc_instant(F.col("x")), ["2026-06-17T03:59:59Z", "2026-06-16T23:59:59-04:00", "2026-02-30T00:00:00Z", "2026-06-17", "x", None])
    assert got[0] == got[1] == datetime(2026, 6, 17, 3, 59, 59) and got[2] is None and got[3] == datetime(2026, 6, 17) and got[4:] == [None, None]


def test_new_york(spark):
    got = values(spark, S.new_york_date(F.col("x").cast("timestamp")), ["2026-06-17 03:59:59", "2026-06-17 04:00:00", "2026-01-17 04:59:59"])
    assert got == [date(2026, 6, 16), date(2026, 6, 17), date(2026, 1, 16)]
    ends = values(spark, S.end_of_new_york_day(F.col("x")), ["2026-06-16", "2026-01-16", "2026-03-08", None])
    assert ends == [datetime(2026, 6, 17, 3, 59, 59), datetime(2026, 1, 17, 4, 59, 59), datetime(2026, 3, 9, 3, 59, 59), None]


def test_strict_json(spark):
    rows = ['{"a": "x", "b": true, "c": ["u", 1, "v"]}', '{"a": 1, "b": "true", "c": "u"}', '{"a": "", "b": null}', "[]", "no", None]
    v = F.try_parse_json("x")
    assert values(spark, S.json_string(v, "$.a"), rows) == ["x", None, None, None, None, None]
    assert values(spark, S.json_bool(v, "$.b"), rows) == [True, None, None, None, None, None]
    assert values(spark, S.json_strings(v, "$.c"), rows) == [["u", "v"], [], [], [], [], []]


def test_canonical_hash(spark):
    a, b, other, bad = values(spark, S.canonical_hash(F.col("x")), ['{"b": 1, "a": [1, 2]}', '{"a": [1, 2], "b": 1}', '{"a": [2, 1], "b": 1}', "{"])
    assert a == b != other and len(a) == 64 and bad is None


def test_references(spark):
    rows = [("see FR 2025-00734 for", "2025-00734"), ("see 2025- 00734.", "2025-00734"), ("x2025-00734", "2025-00734"), ("2025-007345", "2025-00734"), (None, "2025-00734"), ("a.b", "a+b"), ("x", "")]
    assert values(spark, S.references(F.col("t"), F.col("d")), rows, "t string, d string") == [True, True, False, False, False, False, False]


def test_quarters(spark):
    got = spark.range(1).select(S.quarters(F.lit("2026-05-20").cast("date"), 3)).collect()[0][0]
    assert [(q.label, str(q.start), str(q.end)) for q in got] == [("2025Q4", "2025-10-01", "2025-12-31"), ("2026Q1", "2026-01-01", "2026-03-31"), ("2026Q2", "2026-04-01", "2026-05-20")]


def test_rules(spark):
    flags = R.notice_flags(F.col("x"))
    rows = spark.createDataFrame([("Extension of comment period; correction",), ("Reopening",), ("Withdrawn",), ("preextension",), (None,)], "x string")
    got = [tuple(r) for r in rows.select(*[flags[f] for f in R.FLAGS]).collect()]
    assert got == [(True, True, False, False), (False, False, False, True), (False, False, True, False), (False,) * 4, (False,) * 4]


def test_denials(spark):
    rows = [("Public Land Order No. 7963", None), ("Notice of Proposed Withdrawal", None), ("Withdrawal of certain public lands", None), ("Flathead National Forest Plan; Withdrawal", None), ("Withdrawal of proposed rule", None), (None, "land-withdrawal"), (None, None)]
    assert values(spark, R.is_denied(F.col("t"), F.col("d")), rows, "t string, d string") == [True, True, True, True, False, True, False]


def test_small_ones(spark):
    assert values(spark, S.stage(F.col("x")), ["Notice of Intent", "Final Supplement to", "A draft thing", "x", None]) == ["NOI", "Final Supplement", "Draft", "—", "—"]
    assert values(spark, S.states_in(F.col("x")), ["West Virginia and Ohio", None, "Ohioan"]) == [["Ohio", "Virginia", "West Virginia"], [], []]
    assert values(spark, S.squeeze(F.col("x")), ["  a  b ", "  ", None]) == ["a b", None, None]
    assert values(spark, S.clean_list(F.split("x", ",")), [" a ,, b", None]) == [["a", "b"], []]
    assert values(spark, S.entity_key(F.col("a"), F.col("b")), [("d", "o"), (None, "o"), (" ", None)], "a string, b string") == [S.ENTITY_PREFIX + "d", S.ENTITY_PREFIX + "regs:o", None]
