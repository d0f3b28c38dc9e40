"""The four general problems: against plain Python, on edge rows, and with their skew paths forced."""

import datetime as dt
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stratalog.functions.cells import split_quoted
from stratalog.operators import orphans as orphans_module
from stratalog.operators.copies import copy_differences
from stratalog.operators.history import attribute_history
from stratalog.operators.joins import guarded_join, split_join
from stratalog.operators.orphans import orphan_references, orphan_report
from stratalog.operators.parse_failures import loaded_rows, parse_failures
from stratalog.session import table

D = lambda s: dt.date.fromisoformat(s)
T = lambda s: dt.datetime.fromisoformat(s)


# History ------------------------------------------------------------------------------------------------------------


def versions(spark, rows, kind="date"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"k long, v string, at {kind}, seen timestamp, id long, valid_from string, __at int")
    return sorted((r.k, r.v, r.valid_from, r.valid_to) for r in attribute_history(df, ["k"], ["v"], "at", ["seen", "id"]).collect())


def test_history(spark):
    t = T("2020-01-01")
    rows = [
        (1, "a", D("2020-01-01"), t, 1), (1, "a", D("2020-02-01"), t, 2), (1, "b", D("2020-03-01"), t, 3), (1, None, D("2020-04-01"), t, 4), (1, None, D("2020-05-01"), t, 5),
        (1, "b", D("2020-06-01"), t, 6), (1, "z", D("2020-06-01"), None, 7), (1, "q", None, t, 8), (2, None, D("2020-01-01"), t, 9), (3, "", D("2020-01-01"), t, 10), (3, "A", D("2020-01-02"), t, 11), (3, "a", D("2020-01-03"), t, 12),
        (4, "x", D("2020-01-01"), t, 13), (4, "y", D("2020-01-01"), T("2020-01-02"), 12),
    ]
    want = [
        (1, "a", "2020-01-01", "2020-03-01"), (1, "b", "2020-03-01", "2020-04-01"), (1, "b", "2020-06-01", "9999-12-31"),
        (3, "", "2020-01-01", "2020-01-02"), (3, "A", "2020-01-02", "2020-01-03"), (3, "a", "2020-01-03", "9999-12-31"), (4, "y", "2020-01-01", "9999-12-31"),
    ]
    assert versions(spark, rows) == want
    assert versions(spark, rows + rows) == want
    assert versions(spark, []) == []


def test_history_of_timestamps_collapses_by_month(spark):
    rows = [(1, "a" if i < 50 or i >= 70 else "b", T("2020-01-01") + dt.timedelta(days=i), None, i) for i in range(100)]
    assert versions(spark, rows, "timestamp") == [
        (1, "a", "2020-01-01 00:00:00", "2020-02-20 00:00:00"),
        (1, "a", "2020-03-11 00:00:00", "9999-12-31"),
        (1, "b", "2020-02-20 00:00:00", "2020-03-11 00:00:00"),
    ]


# Copies -------------------------------------------------------------------------------------------------------------


def compared(spark, left, right, **options):
    schema = "k string, a string, b string, seen long, pos int, side string"
    frame = lambda rows: spark.createDataFrame([(*r, 1, "s") for r in rows], schema)
    found = copy_differences(frame(left), frame(right), "k", ["a", "b"], ["seen"], ["seen"], "one", "two", **options)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("options", [{}, {"bits_per_round": 1, "leaf_rows": 1}, {"bits_per_round": 3, "leaf_rows": 50}])
def test_copies_against_plain_python(spark, options):
    left = [(f"k{i}", str(i % 7), None if i % 11 == 0 else "v", 1) for i in range(500)]
    right = [(k, "other" if i % 90 == 5 else a, "v" if i % 110 == 0 else b, 1) for i, (k, a, b, _) in enumerate(left) if i % 83]
    right += [("extra", "1", "2", 1), (None, "1", "2", 1), ("k1", "old", "old", 0), right[3], right[3]]
    one, two = {r[0]: r[1:3] for r in left}, {r[0]: r[1:3] for r in right if r[0] and r[3]}
    want = [(k, "row", "missing_in_two") for k in one.keys() - two.keys()] + [(k, "row", "missing_in_one") for k in two.keys() - one.keys()]
    want += [(k, f, "differs") for k in one.keys() & two.keys() for i, f in enumerate("ab") if one[k][i] != two[k][i]]
    assert compared(spark, left, right, **options) == sorted(want)


def test_copies_tell_nulls_from_any_text(spark):
    for text in ("\x00null", "null", "", "0", "1"):
        assert compared(spark, [("k", None, "b", 1)], [("k", text, "b", 1)]) == [("k", "a", "differs")]
    assert compared(spark, [("k", "v", None, 1)], [("k", None, "v", 1)]) == [("k", "a", "differs"), ("k", "b", "differs")]


def test_copies_edge_tables(spark):
    rows = [("k", "1", None, 1)]
    assert compared(spark, rows, rows) == compared(spark, [], []) == []
    assert compared(spark, rows, []) == [("k", "row", "missing_in_two")]
    assert compared(spark, [], rows) == [("k", "row", "missing_in_one")]


# Orphans ------------------------------------------------------------------------------------------------------------


def orphaned(spark, refs, targets, **options):
    r = spark.createDataFrame([(*x, 5) for x in refs], "id long, k string, at timestamp, s int")
    t = spark.createDataFrame([(*x, 6) for x in targets], "k string, s timestamp, e timestamp, at int")
    return sorted((x.id, x.reason) for x in orphan_references(r, t, "k", "at", "s", "e", **options).collect())


@pytest.mark.parametrize("options", [{}, {"heavy_share": 0.0}, {"heavy_share": 0.0, "broadcast_rows": 0}, {"heavy_share": 0.2, "broadcast_rows": 0}])
def test_orphans(spark, options):
    targets = [("a", T("2020-01-10"), None), ("b", T("2020-01-10"), T("2020-02-10")), ("b", T("2020-02-01"), T("2020-03-01")), ("b", T("2020-05-01"), None), ("c", T("2020-01-01"), T("2020-01-01")), (None, T("2020-01-01"), None)]
    refs = [(1, "a", T("2020-01-10")), (2, "a", T("2020-01-09")), (3, "b", T("2020-02-20")), (4, "b", T("2020-03-01")), (5, "b", T("2020-06-01")), (6, "c", T("2020-02-01")), (7, "x", T("2020-02-01")), (8, None, T("2020-02-01")), (9, "a", None), (10, "x", None)]
    refs += [(20, "a", T("2020-03-01"))] * 30 + [(21, "x", T("2020-03-01"))] * 2
    assert orphaned(spark, refs, targets, **options) == [(2, "late"), (4, "deleted"), (6, "deleted"), (7, "missing"), (10, "missing"), (21, "missing"), (21, "missing")]


def test_orphans_of_empty_tables(spark):
    assert orphaned(spark, [], [("a", T("2020-01-10"), None)]) == []
    assert orphaned(spark, [(1, "a", T("2020-01-10"))], []) == [(1, "missing")]


def test_orphan_report_keeps_groups_without_orphans(spark):
    refs = spark.createDataFrame([("t", "p", 1), ("t", None, 2)], "t string, p string, id int")
    found = refs.where("id = 2").withColumn("reason", F.lit("late"))
    assert sorted(map(tuple, orphan_report(refs, found, ["t", "p"]).collect()), key=str) == [("t", "p", 1, 0, 0, 0), ("t", None, 1, 0, 1, 0)]


def test_standing_periods_merge(spark):
    rows = [("k", T(f"2020-0{m}-0{d}"), T(f"2020-0{m}-0{d + 2}")) for m in (1, 2) for d in (1, 2, 3, 6)] + [("k", T("2020-01-07"), T("2020-02-01"))]
    df = spark.createDataFrame(rows, "k string, s timestamp, e timestamp")
    got = sorted((r.s.isoformat()[:10], r.e.isoformat()[:10]) for r in orphans_module.standing_periods(df, "k", "s", "e").collect())
    assert got == [("2020-01-01", "2020-01-05"), ("2020-01-06", "2020-02-05"), ("2020-02-06", "2020-02-08")]


# Parsing ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "line,cells",
    [("a,b", ["a", "b"]), ("", [""]), (",", ["", ""]), ('"a,b",c', ["a,b", "c"]), ('"a""b"', ['a"b']), ('a"b,c', ['a"b', "c"]), ('"a"b,c', None), ('"a', None), ('"",""', ["", ""]), ('"a",', ["a", ""]), ('a,"', None)],
)
def test_split_quoted(line, cells):
    assert split_quoted(line, ",") == cells


def day(text, pattern, order):
    m = re.fullmatch(pattern, text, re.A)
    try:
        return bool(m) and bool(dt.date(*[int(m[i]) + (2000 if i == order[0] and len(m[i]) == 2 else 0) for i in order]))
    except ValueError:
        return False


def expected_failures(lines, loads):
    iso = lambda v: day(v, r"([0-9]{4})-([0-9]{2})-([0-9]{2})", (1, 2, 3))
    number = lambda v: v == "" or bool(re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", v))
    digits = lambda v: bool(re.fullmatch(r"[0-9]+", v))
    accession = lambda v: bool(re.fullmatch(r"[0-9]{10}-[0-9]{2}-[0-9]{6}", v))

    def valid(code, c):
        if code == "SOI":
            return (
                accession(c["adsh"]) and bool(re.fullmatch("[0-9]{1,10}", c["cik"])) and all(iso(c[x]) for x in ("ddate", "filed", "period")) and digits(c["qtrs"])
                and (c["Investment Maturity Date"] == "" or iso(c["Investment Maturity Date"])) and all(number(v) for v in list(c.values())[17:20])
            )
        if code == "NUM":
            return (
                accession(c["adsh"]) and all(c[x] for x in ("tag", "version", "uom")) and day(c["ddate"], r"([0-9]{4})([0-9]{2})([0-9]{2})", (1, 2, 3)) and digits(c["qtrs"])
                and number(c["value"]) and digits(c["footlen"]) and int(c["footlen"]) == len(c["footnote"].encode())
            )
        return bool(re.fullmatch("[0-9]{10}", c["CIK"])) and c["Registrant_Name"] != "" and day(c["Filing Date"], r"([0-9]{2})/([0-9]{2})/([0-9]{2})", (3, 1, 2))

    out = {}
    for load, number_, line in lines:
        code, delimiter, header = loads[load]
        cells = split_quoted(line[:-1] if line.endswith("\r") else line, delimiter)
        if cells is None:
            out[load, number_] = "quoting"
        elif len(cells) != len(header):
            out[load, number_] = "field_count"
        elif not valid(code, dict(zip(header, cells))):
            out[load, number_] = "invalid_value"
    return out


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_failures_of_whole_table(spark, sf_dir):
    from stratalog.plans.problems import p6_found, p6_loaded

    loads = {r.table_load_id: (r.table_code, r.delimiter, r.header) for r in table(spark, sf_dir, "table_load").collect()}
    lines = [(r.table_load_id, r.line_number, r.raw_line) for r in table(spark, sf_dir, "tsv_line").collect()]
    want = expected_failures(lines, loads)
    assert {(r.table_load_id, r.line_number): r.reason for r in p6_found(spark, sf_dir).collect()} == want
    assert {(r.table_load_id, r.line_number) for r in p6_loaded(spark, sf_dir).collect()} == {x[:2] for x in lines} - set(want)


def test_failures_on_edge_rows(spark):
    loads = spark.createDataFrame([(1, "NEW", ",", ["a", "b"]), (2, "NEW", "||", ["a", "b"]), (3, "NEW", ",", None), (4, "NUMS", ",", ["n", "n|x"])], "load long, table_code string, delimiter string, header array<string>")
    rows = [(1, 1, "x,y"), (1, 2, "x,y\r"), (1, 3, "x\ry,"), (1, 4, None), (1, 5, ""), (2, 1, '"a||b"||c'), (2, 2, "a|b"), (3, 1, "a"), (9, 1, "a,b"), (None, 1, "a"), (1, 6, "é" * 50_000 + ",b"), (4, 1, "5,q"), (4, 2, "five,q"), (4, 2, "five,q")]
    lines = spark.createDataFrame([(*r, "c") for r in rows], "load long, n long, line string, code string")
    formats = {"NUMS": {"n": "digits"}}
    failed = sorted(((r.load, r.n, r.reason, r.detail) for r in parse_failures(lines, loads, "load", ["load", "n"], "line", formats).collect()), key=str)
    structural = [(1, 4), (1, 5), (2, 2), (3, 1), (9, 1), (None, 1)]
    assert failed == sorted([(*k, "field_count", None) for k in structural] + [(4, 2, "invalid_value", "n: digits")], key=str)
    good = {(r.load, r.n): r.record for r in loaded_rows(lines, loads, "load", ["load", "n"], "line", formats).collect()}
    assert set(good) == {(1, 1), (1, 2), (1, 3), (1, 6), (2, 1), (4, 1)} and good[2, 1] == {"a": "a||b", "b": "c"} and good[1, 2]["b"] == "y"
    assert parse_failures(lines.limit(0), loads, "load", ["load", "n"], "line").collect() == []
    assert len(parse_failures(lines, loads.limit(0), "load", ["load", "n"], "line").collect()) == len(rows)


def test_line_ends_and_marks_in_values_are_invalid(spark):
    header = ["a", "b"]
    loads = spark.createDataFrame([(1, "X", ",", header)], "load long, table_code string, delimiter string, header array<string>")
    ends = ["\u2028", "\u0085", "\r", "\u2029", " "]
    for rule, good in (("digits", "123"), ("cik", "123"), ("cik10", "0123456789"), ("accession", "0123456789-12-123456"), ("decimal_or_empty", "-1.5"), ("iso_day", "2020-02-29"), ("compact_day", "20200229"), ("us_day", "02/29/20")):
        lines = spark.createDataFrame([(1, n, f"{good}{end},x") for n, end in enumerate(["", *ends])], "load long, n long, line string")
        failed = {(r.n, r.reason) for r in parse_failures(lines, loads, "load", ["load", "n"], "line", {"X": {"a": rule}}).collect()}
        assert failed == {(n, "invalid_value") for n in range(1, len(ends) + 1)}, rule
    lines = spark.createDataFrame([(1, n, x) for n, x in enumerate(["2,éa", "3,éa", "3|3,éa", "3\u2028,éa", "|3,éa", "-3,éa"])], "load long, n long, line string")
    assert {r.n for r in parse_failures(lines, loads, "load", ["load", "n"], "line", {"X": {"a|b": "byte_length"}}).collect()} == {0, 2, 3, 4, 5}


# Joins --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_guarded_join_is_the_same_salted(spark, how):
    many = spark.createDataFrame([(i % 7 if i % 3 else None, i) for i in range(100)], "k long, v long")
    few = spark.createDataFrame([(k, w) for k in (0, 1, 5, None) for w in (1, 2)], "k long, w long")
    plain = sorted(map(str, many.join(few, "k", how).collect()))
    for rows in (0, 1000):
        assert sorted(map(str, guarded_join(many, few, ["k"], how, rows).collect())) == plain
        extra = guarded_join(many, few, ["k"], how, rows, extra=F.col("v") > F.col("w") * 40).collect()
        counts = defaultdict(int)
        for r in extra:
            counts[r.k, r.v] += 1
        matches = {(r.k, r.v): sum(1 for k in (0, 1, 5) for w in (1, 2) if k == r.k and r.v > w * 40) for r in many.collect()}
        want = {x: {"inner": n, "left": max(n, 1), "left_semi": min(n, 1), "left_anti": int(n == 0)}[how] for x, n in matches.items()}
        assert counts == {x: n for x, n in want.items() if n}


def test_split_join_spreads_equal_rows_of_a_hot_key(spark):
    many = spark.createDataFrame([("hot", 1)] * 400 + [(str(i), 1) for i in range(50)], "k string, v int")
    few = spark.createDataFrame([("hot", 2), ("3", 2)], "k string, w int")
    joined = split_join(many, few, ["k"], hot_share=0.1)
    assert joined.count() == 401
    assert many.limit(0).count() == split_join(many.limit(0), few, ["k"]).count() == split_join(many, few.limit(0), ["k"]).count() == 0


def test_load_units_append_once(spark, sf, tmp_path):
    from stratalog.plans.load import Unit, append_unit

    unit = Unit(table(spark, sf, "tsv_line"), table(spark, sf, "table_load"), table(spark, sf, "filing"), "SOI")
    assert all(df.isEmpty() for df in unit.checks().values())
    assert append_unit(unit, str(tmp_path), "b1") and not append_unit(unit, str(tmp_path), "b1")
    told = spark.read.parquet(f"{tmp_path}/soi_coverage").agg({"landed": "sum", "projected": "sum", "set_aside": "sum"}).first()
    assert told["sum(landed)"] == told["sum(projected)"] + told["sum(set_aside)"] == spark.read.parquet(f"{tmp_path}/soi_tabular_rows").count() > 0
    nothing = Unit(table(spark, sf, "tsv_line").limit(0), table(spark, sf, "table_load"), table(spark, sf, "filing"), "NUM")
    assert nothing.observations().isEmpty() and {r.coverage_state for r in nothing.coverage().collect()} <= {"EMPTY", "SCHEMA_DRIFT"}
