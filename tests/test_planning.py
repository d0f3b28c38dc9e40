"""Plans of appends, and properties of the line splitter and of releases of scratch tables."""

import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.functions.cells import split_quoted
from stratalog.operators import planning


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_fact_role(spark):
    values = [["PRINCIPAL_AMOUNT", "FAIR_VALUE", "INDUSTRY"], ["PRINCIPAL_AMOUNT", "FAIR_VALUE", "SPREAD"], ["SPREAD", "INDUSTRY"], ["PIK_RATE"], ["PIK_RATE", "SPREAD"], ["SPREAD", "SPREAD"], ["PRINCIPAL_AMOUNT"], [], None, ["PRINCIPAL_AMOUNT", "FAIR_VALUE", "OTHER"]]
    assert column(spark, values, "array<string>", planning.fact_role) == ["BALANCE", None, "SPREAD", "PIK", None, None, None, None, None, None]


def test_natural_key(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", None), ("a", ""), ("a|v1:b", "c"), ("a", "bc")], "x string, y string")
    keys = [r[0] for r in df.select(planning.natural_key(F.col("x"), F.col("y"))).collect()]
    assert len(set(keys)) == 5 and keys[0] == keys[5]


def test_batches(spark):
    df = spark.createDataFrame([(3, "b"), (1, "b"), (2, "a"), (4, None), (5, ""), (6, "c"), (6, "d")], "id int, t string")
    assert rows(planning.hashed_batches(df, "id", "t"), "text", "ids", "problem") == sorted([("b", [1, 3], None), ("a", [2], None), (None, [4, 5], "NO_TEXT"), ("c", [6], "REPEATED_ID"), ("d", [6], "REPEATED_ID")], key=str)
    targets = spark.createDataFrame([(1, "n"), (2, "r"), (3, "two"), (4, "bare")], "id int, t string")
    known = spark.createDataFrame([(10, "r", "E"), (11, "two", "E"), (12, "two", "F"), (13, "x", "G"), (14, "bare", None)], "id int, t string, e string")
    got = rows(planning.name_batches(targets, known, "id", "t", "e"), "text", "mode", "entity", "target_ids", "known_ids", "problem")
    assert got == [("bare", "reuse", None, [4], [14], "NO_ENTITY"), ("n", "new", None, [1], [], None), ("r", "reuse", "E", [2], [10], None), ("two", "reuse", "E", [3], [11, 12], "SEVERAL_ENTITIES"), ("x", "reuse", "G", [], [13], "NOT_A_TARGET")]


def test_pending_series(spark):
    df = spark.createDataFrame([(1, "a", "d1"), (2, "a", "d2"), (3, "b", "d1"), (4, "b", "d1"), (5, None, "d1"), (6, "c", "d1")], "id int, k string, d string")
    assert rows(planning.pending_series(df, ["k"], "d", "id")) == [("a", 2, 1), ("c", 1, 6), (None, 1, 5)]
    decided = spark.createDataFrame([(1,), (6,)], "id int")
    assert rows(planning.pending_series(df, ["k"], "d", "id", decided)) == [("a", 2, 1), (None, 1, 5)]
    assert rows(planning.pending_series(df, ["k"], "d", "id", limit=1)) == [("a", 2, 1)]


def test_actions(spark):
    df = spark.createDataFrame([(0, None), (1, True), (1, False), (1, None), (2, True)], "n int, same boolean")
    assert [r[0] for r in df.select(planning.head_action(F.col("n"), F.col("same"))).collect()] == ["INSERT", "KEEP", "CONFLICT", "CONFLICT", "CONFLICT"]
    outcomes = spark.createDataFrame([("a", 1, "X"), ("b", 1, "X"), ("c", 2, None), ("d", 1, None)], "s string, rule int, state string")
    heads = spark.createDataFrame([(7, "a", 1, "X"), (8, "b", 1, "Y"), (9, "c", 1, None)], "id int, s string, rule int, state string")
    assert rows(planning.outcome_plan(outcomes, heads, "s", "rule", ["state"]), "s", "action", "supersedes_id") == [("a", "SKIP", None), ("b", "INSERT", 8), ("c", "INSERT", 9), ("d", "INSERT", None)]


def test_headings_and_traces(spark):
    h = lambda *x: [{"slot": s, "row": r, "text": t} for s, r, t in x]
    values = [h((3, 1, "Maturity"), (3, 2, "Date")), h((3, 2, "Date"), (3, 1, "Maturity")), h((3, 1, "Maturity"), (3, 3, "Date")), h((3, 1, "Maturity"), (4, 2, "Date")), h((3, 1, "Date")), h((3, 1, "Purchase Date")), h((3, 1, "")), [], None]
    got = column(spark, values, "array<struct<slot:int,row:int,text:string>>", planning.heading_field)
    assert got == ["MATURITY_DATE", "MATURITY_DATE", None, None, None, "ACQUISITION_DATE", None, None, None]
    df = spark.createDataFrame([(1, "F", 2), (1, "F", 1), (2, "F", 3)], "p int, f string, id int")
    assert [(r.p, [t.id for t in r.traces]) for r in planning.field_traces(df, ["p", "f"], ["id"]).orderBy("p").collect()] == [(1, [1, 2]), (2, [3])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab", \té', max_size=6), min_size=1, max_size=5))
def test_split_undoes_quoting(cells):
    out = io.StringIO()
    csv.writer(out, delimiter=",", quoting=csv.QUOTE_ALL, lineterminator="").writerow(cells)
    assert split_quoted(out.getvalue(), ",") == cells


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab",', max_size=20))
def test_split_loses_nothing(line):
    cells = split_quoted(line, ",")
    if cells is not None and '"' not in line:
        assert ",".join(cells) == line
