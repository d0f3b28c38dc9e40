"""The operators of the evidence model on made-up rows: states, chains, periods, matching, cells, profiles and functions."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stratalog.functions import text as tx
from stratalog.functions import values as vx
from stratalog.operators import cells, chains, integrity, matching, periods, profile, reading, states
from stratalog.session import at_most, cut, shared_dir

D = dt.date.fromisoformat


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Chains


def test_current_heads_and_violations(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "a"), (3, 2, "b"), (4, 4, "c"), (5, 99, "d"), (6, 1, "a"), (7, None, "a"), (8, None, None), (9, None, None)], "id long, supersedes_id long, s string")
    assert rows(chains.current_heads(df).select("id")) == [(3,), (5,), (6,), (7,), (8,), (9,)]
    got = rows(chains.supersession_violations(df, ["s"]))
    assert got == sorted([(4, "SELF"), (5, "DANGLING"), (3, "SUBJECT"), (2, "FORK"), (6, "FORK"), (1, "SECOND_ROOT"), (7, "SECOND_ROOT"), (8, "SECOND_ROOT"), (9, "SECOND_ROOT")], key=str)
    assert rows(chains.supersession_violations(df.limit(0), ["s"])) == rows(chains.current_heads(df.limit(0))) == []


def test_chain_heads(spark):
    chain = [(i, i - 1 if i else None) for i in range(20)] + [(100, None), (101, 100), (102, 100), (200, 201), (201, 200)]
    df = spark.createDataFrame(chain, "id long, supersedes_id long")
    assert rows(chains.chain_heads(df)) == [(0, 19, 20), (100, 101, 2), (100, 102, 2)]
    loop = spark.createDataFrame([(1, None), (2, 1), (3, 2), (2, 3)], "id long, supersedes_id long")
    with pytest.raises(ValueError):
        chains.chain_heads(loop, depth=64).collect()


def test_latest_and_absent(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, None, "n"), ("b", None, "q")], "k string, at int, v string")
    assert rows(chains.latest_by(df, ["k"], ["at"])) == [("a", 2, "z"), ("b", None, "q"), (None, None, "n")]
    assert rows(chains.insert_absent(df, spark.createDataFrame([("b",)], "k string"), ["k"], ["at"])) == [("a", 1, "x")]


def test_upsert_stream(spark):
    heads = spark.createDataFrame([(1, "same", "v"), (2, "one", "old"), (3, "two", "p"), (4, "two", "q"), (5, "gone", "v"), (6, None, "n")], "id long, s string, v string")
    source = spark.createDataFrame([("same", "v"), ("same", "v"), ("one", "new"), ("two", "p"), ("two", "r"), ("fresh", "a"), ("fresh", "b"), (None, None)], "s string, v string")
    got = rows(chains.upsert_stream(source, heads, ["s"], ["v"]))
    assert got == sorted([("one", "new", 2, "SUPERSEDES"), ("two", "r", 4, "SUPERSEDES"), ("fresh", "a", None, "ADDED"), ("fresh", "b", None, "ADDED"), ("gone", "v", 5, "ABSENT"), (None, None, 6, "SUPERSEDES")], key=str)


# States


def test_states(spark):
    df = spark.createDataFrame([("none", None, None), ("one", "REPORTED", "v"), ("hollow", "REPORTED", None), ("two", "REPORTED", "v"), ("two", "REPORTED", "v"), ("na", "NOT_APPLICABLE", None)], "k string, s string, v string")
    got = rows(df.groupBy("k").agg(states.three_state(F.col("v")), states.four_state(F.col("s"), F.col("v")), states.exactly_one(F.col("v")), states.single_value(F.col("v"))))
    assert got == [("hollow", "UNKNOWN", "UNKNOWN", None, None), ("na", "UNKNOWN", "NOT_APPLICABLE", None, None), ("none", "UNKNOWN", "UNKNOWN", None, None), ("one", "REPORTED", "REPORTED", "v", "v"), ("two", "REPORTED", "MULTIPLE_VALUES", None, "v")]


def test_guarded_total(spark):
    data = [("all", 1, True, "USD"), ("all", 2, True, "USD"), ("gap", 1, True, "USD"), ("gap", None, True, "USD"), ("not", 1, None, "USD"), ("mix", 1, True, "USD"), ("mix", 2, True, "EUR"), ("unit", 1, True, "USD"), ("unit", 1, True, None)]
    df = spark.createDataFrame(data, "k string, v int, ok boolean, u string")
    state, total, unit = states.guarded_total(F.col("v"), F.col("ok"), F.col("u"))
    assert rows(df.groupBy("k").agg(state, total, unit)) == [("all", "TOTAL", 3, "USD"), ("gap", "INCOMPLETE", None, None), ("mix", "MIXED_UNITS", None, None), ("not", "INCOMPLETE", None, None), ("unit", "UNKNOWN_UNIT", None, None)]
    assert df.limit(0).agg(state.alias("s"), total.alias("t")).first().asDict() == {"s": "EMPTY", "t": None}


def test_grid_pivot_and_presence(spark):
    subjects, fields = spark.createDataFrame([(1,), (2,)], "s int"), spark.createDataFrame([("a",), ("b",)], "f string")
    known = spark.createDataFrame([(1, "a", "REPORTED")], "s int, f string, st string")
    assert rows(states.status_grid(subjects, fields, known, ["s", "f"], "st")) == [(1, "a", "REPORTED"), (1, "b", "UNKNOWN"), (2, "a", "UNKNOWN"), (2, "b", "UNKNOWN")]
    assert states.status_grid(subjects, fields.limit(0), known, ["s", "f"], "st").count() == 0
    df = spark.createDataFrame([(1, "P", "REPORTED", "5"), (1, "C", "REPORTED", "1"), (1, "C", "REPORTED", "1"), (2, "P", "UNKNOWN", None)], "k int, f string, s string, v string")
    assert rows(states.pivot_heads(df, ["k"], "f", {"P": "p", "C": "c"}, "s", "v")) == [(1, "REPORTED", "5", "MULTIPLE_VALUES", None), (2, "UNKNOWN", None, "UNKNOWN", None)]
    assert rows(states.pivot_states(df, ["k"], "f", "v", ["P", "C"])) == [(1, "REPORTED", "5", "REPORTED", "1"), (2, "UNKNOWN", None, "UNKNOWN", None)]
    assert rows(states.cell_presence(df, ["k"], [], {"p": F.col("v") == "5"})) == [(1, 1)]
    assert rows(states.field_coverage(df, ["k"], ["REPORTED"], "s")) == [(1, 3, 3, 0), (2, 1, 0, 1)]


# Periods


def test_consecutive_pairs(spark):
    data = [("pair", 1, D("2020-01-31")), ("pair", 2, D("2020-04-30")), ("block", 3, D("2020-01-31")), ("block", 4, D("2020-02-29")), ("block", 5, D("2020-02-29")), ("block", 6, D("2020-03-31")), ("lone", 7, D("2020-01-31")), ("pair", 8, None), (None, 9, D("2020-01-01")), (None, 10, D("2020-01-02"))]
    df = spark.createDataFrame([(*r, "x") for r in data], "k string, id int, at date, n string")
    assert rows(periods.consecutive_pairs(df, ["k"], "at", "id").select("k", "earlier_id", "later_id")) == [("pair", 1, 2), (None, 9, 10)]
    assert periods.consecutive_pairs(df.limit(0), ["k"], "at", "id").count() == 0


def test_comparisons(spark):
    df = spark.createDataFrame([(1, 2, "U", "U"), (1, None, "U", "U"), (1, 2, "U", "E"), (1, 2, None, None), (0, 2, "U", "U")], "a int, b int, u string, w string")
    got = df.select(periods.comparable(F.col("a"), F.col("b"), F.col("u"), F.col("w")), periods.comparable(F.col("a"), F.col("b")), periods.percent_change(F.col("a"), F.col("b")), periods.ratio(F.col("b"), F.col("a")))
    no, yes = "INSUFFICIENT_DATA", "COMPARABLE"
    assert [tuple(r) for r in got.collect()] == [(yes, yes, 100, 2), (no, no, None, None), (no, yes, 100, 2), (no, yes, 100, 2), (yes, yes, None, None)]


def test_changes_first_gaps(spark):
    data = [("new", 1, "d2", "v"), ("gone", 2, "d1", "v"), ("same", 3, "d1", None), ("same", 4, "d2", None), ("diff", 5, "d1", "v"), ("diff", 6, "d2", None), ("many", 7, "d1", "v"), ("many", 8, "d1", "v"), ("other", 9, "d9", "v")]
    df = spark.createDataFrame(data, "k string, id int, at string, v string")
    assert rows(periods.period_changes(df, ["k"], "at", "id", "v", "d1", "d2")) == [("diff", "CHANGED", 5, 6), ("gone", "NO_LONGER", 2, None), ("many", "AMBIGUOUS", None, None), ("new", "NEW", None, 1), ("same", "UNCHANGED", 3, 4)]
    dated = spark.createDataFrame([("a", 1, D("2020-02-29")), ("a", 2, D("2020-02-29")), ("a", 3, D("2020-11-30")), ("a", 4, None), ("b", 5, D("2020-05-15")), (None, 6, D("2021-01-01"))], "k string, id int, at date")
    assert rows(periods.first_observed(dated, ["k"], "at").select("id")) == [(1,), (2,), (5,), (6,)]
    assert rows(periods.quarter_gaps(dated, ["k"], "at")) == [("a", D("2020-05-31")), ("a", D("2020-08-31"))]
    assert rows(periods.date_uniqueness(dated, ["k"], "at").select("k", "is_unique")) == [("a", False), ("b", True), (None, True)]


# Matching


def test_unique_match_and_shared(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 6), (3, "k", 7), (4, "z", 5), (5, "k", None), (6, "k", 5)], "id int, k string, v int")
    right = spark.createDataFrame([("k", 5, 50), ("k", 6, 60), ("k", 6, 61), ("q", 1, 1)], "k string, w int, r int")
    bound = matching.unique_match(left, right, "id", ["k"], "v", "w", "r")
    assert rows(bound) == [(1, "BOUND", 50), (2, "MULTIPLE", None), (3, "NOT_EQUAL", None), (4, "NO_CANDIDATE", None), (5, "NOT_EQUAL", None), (6, "BOUND", 50)]
    assert rows(matching.reject_shared(bound, "matched").where("shared")) == [(1, "BOUND", None, True), (6, "BOUND", None, True)]


def test_bind_by_fields(spark):
    left = spark.createDataFrame([(1, "d", "cost", "5"), (1, "d", "value", "6"), (2, "d", "cost", "9"), (3, "d", "cost", "7"), (4, "d", "rate", "1"), (5, "e", "cost", "5"), (6, "d", "x", "1"), (7, "d", "x", "1")], "id int, doc string, field string, value string")
    right = spark.createDataFrame([(10, "d", "cost", "5"), (10, "d", "value", "6"), (11, "d", "cost", "5"), (11, "d", "value", "0"), (12, "d", "cost", "9"), (13, "d", "cost", "9"), (14, "d", "x", "1")], "row int, doc string, field string, value string")
    assert rows(matching.bind_by_fields(left, right, "id", "row", ["doc"])) == [(1, "BOUND", 10), (2, "SEVERAL_ROWS", None), (3, "NO_ROW", None), (4, "NO_ROW", None), (5, "NO_ROW", None), (6, "SHARED_ROW", None), (7, "SHARED_ROW", None)]


def test_canonical(spark):
    edges = [(i, i + 1) for i in range(10)] + [(20, 21), (21, 20), (30, 20), (40, 40)]
    got = {r.node: (r.canonical, r.is_cyclic) for r in matching.canonical(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {**{i: (10, False) for i in range(11)}, **{i: (None, True) for i in (20, 21, 30, 40)}}
    assert rows(integrity.cyclic(spark.createDataFrame(edges, "a int, b int"), "a", "b")) == [(20,), (21,), (30,), (40,)]


def test_approved_targets_plans_and_groups(spark):
    decisions = spark.createDataFrame([(1, "a", "MATCHED", "x", None), (2, "a", "PROBABLE", "y", 1), (3, "b", "MATCHED", "z", None), (4, "c", "PROBABLE", "w", None), (5, "d", "REJECTED", None, None)], "id int, s string, state string, target string, supersedes_id int")
    heads = chains.current_heads(decisions)
    assert rows(matching.approved_target(heads, decisions, "s")) == [("a", "x"), ("b", "z")]
    seen = spark.createDataFrame([("g1", None), ("g2", "A"), ("g2", "B"), ("g3", "C"), ("g4", "D"), ("g5", "E")], "g string, n string")
    aliases = spark.createDataFrame([("C", 1), ("C", 2), ("D", 3), ("D", 3)], "alias string, entity int")
    assert rows(matching.plan_entities(seen, aliases, "g", "n").select("g", "plan", "name")) == [("g1", "NO_NAME", None), ("g2", "CONFLICTING_NAMES", None), ("g3", "AMBIGUOUS_ALIAS", "C"), ("g4", "EXISTING", "D"), ("g5", "NEW", "E")]
    facts = [
        ("ok", None, 1, "BALANCE", ["p"]), ("ok", " ", 2, "SPREAD", ["s"]), ("ok", "", 3, "PIK", ["k"]), ("overlap", "x", 4, "BALANCE", ["p"]), ("overlap", "x", 5, "SPREAD", ["p"]), ("lone", "x", 6, "BALANCE", ["p"]),
        (None, "x", 7, "BALANCE", ["p"]), (None, "x", 8, "SPREAD", ["s"]), (" ", "x", 9, "BALANCE", ["p"]), (" ", "x", 10, "SPREAD", ["s"]), ("ok", "x", 11, "BALANCE", ["p"]), ("ok", "x", 12, "BALANCE", ["s"]), ("ok", "y", 13, "BALANCE", ["p"]), ("ok", "y", 14, None, ["s"]),
    ]
    groups = matching.fact_groups(spark.createDataFrame(facts, "k string, axis string, id int, role string, m array<string>"), ["k"], ["axis"], "id", "role", "m")
    assert rows(groups) == sorted([("ok", None, "GROUPED", 1, 2, 3), ("overlap", "x", "COMMON_MEASURE", None, None, None), ("ok", "x", "ROLE_SHAPE", None, None, None), ("ok", "y", "UNKNOWN_ROLE", None, None, None)], key=str)
    assert groups.limit(0).count() == 0


def test_what_cannot_be_read_is_told(spark):
    rows_ = spark.createDataFrame([(1, ["a"], ["x"]), (2, None, ["x"]), (3, ["a"], None), (4, ["a", "b"], ["x"])], "id int, h array<string>, c array<string>")
    assert rows(cells.unpivot_rejects(rows_, ["id"], "h", "c")) == [(2, "NO_HEADER"), (3, "NO_CELLS"), (4, "WIDTH")]
    assert rows(cells.array_rejects(rows_, ["id"], ["h", "c"])) == [(2, "NO_ARRAY"), (3, "NO_ARRAY"), (4, "UNEQUAL_LENGTHS")]
    docs = spark.createDataFrame([(1, '{"a": 1.50, "b": 1e3, "c": [true, null]}'), (2, None), (3, "{"), (4, "")], "id int, d string")
    assert rows(cells.json_rejects(docs, ["id"], "d")) == [(2, "NO_TEXT"), (3, "MALFORMED"), (4, "MALFORMED")]
    assert {r.path: (r.type, r.text) for r in cells.flatten_json(docs, ["id"], "d").collect() if r.type in ("number", "boolean")} == {'$."a"': ("number", "1.50"), '$."b"': ("number", "1e3"), '$."c"[0]': ("boolean", "true")}


def test_chain_ends(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 5), (7, 5)], "id int, supersedes_id int")
    assert rows(chains.chain_ends(df)) == [(1, 4), (2, 4), (3, 4), (4, 4), (5, 6), (5, 7), (6, 6), (7, 7)]
    assert chains.chain_ends(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chains.chain_ends(spark.createDataFrame([(1, 2), (2, 1)], "id int, supersedes_id int"), depth=8)


def test_near_names(spark):
    df = spark.createDataFrame([(1, "Nim Vor, LLC"), (2, "NIM VOR Inc."), (3, "Nim Vor LLC"), (4, "Quel"), (5, None), (6, "LLC")], "id int, n string")
    joined = lambda x: F.array_join(x, " ")
    assert rows(matching.near_name_pairs(df, "id", joined(tx.core_tokens(F.col("n"))), joined(tx.suffix_tokens(F.col("n"))))) == [(1, 2, "NIM VOR")]


# Cells, profiles, reading


def test_cells(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"], ["1", "", "3"]), (2, ["a"], ["1", "2"]), (3, None, None)], "id int, h array<string>, c array<string>")
    assert rows(cells.unpivot_cells(df, ["id"], "h", "c")) == [(1, "a", "1"), (1, "a", "3")]
    mapping = spark.createDataFrame([("b", "B")], "label string, code string")
    assert rows(cells.unpivot_cells(df, ["id"], "h", "c", mapping)) == []
    arrays = spark.createDataFrame([(1, ["x", "y"], [1, 2]), (2, ["x"], [1, 2]), (3, None, [1])], "id int, p array<string>, q array<int>")
    assert rows(cells.arrays_to_rows(arrays, ["id"], ["p", "q"])) == [(1, 0, "x", 1), (1, 1, "y", 2)]
    docs = spark.createDataFrame([(1, '{"a":1}'), (2, "{"), (3, None)], "id int, d string")
    assert rows(cells.flatten_json(docs, ["id"], "d").select("id", "path", "text")) == [(1, "$", None), (1, '$."a"', "1")]


def test_profiles(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 2, 3, None)] + [("b", 1), ("b", 9), (None, 4)], "k string, v int")
    assert rows(profile.upper_median(df, ["k"], "v")) == [("a", 4, 1, 2, 3), ("b", 2, 1, 9, 9), (None, 1, 4, 4, 4)]
    assert rows(profile.candidate_keys(df, {"k": ["k"], "kv": ["k", "v"]})) == [("k", 8, 2, 2), ("kv", 8, 5, 1)]
    assert rows(profile.candidate_keys(df.limit(0), {"k": ["k"]})) == [("k", 0, 0, 0)]
    with pytest.raises(ValueError):
        profile.require_empty(df, "no rows")
    extra, missing = profile.header_difference(F.array(F.lit("b"), F.lit("c")), ["a", "b"])
    assert tuple(spark.range(1).select(extra, missing).first()) == (["c"], ["a"])


def test_reading(spark):
    df = spark.createDataFrame([(1, "Nim", 1), (1, "Vor", 2), (2, "Quel", 3), (2, "Quel", 3), (3, None, 4)], "g int, a string, d int")
    assert rows(reading.alias_search(df, ["g"], "a", "nI", {"n": F.col("d")})) == [(1, ["Nim", "Vor"], 2, None)]
    assert rows(reading.page(df, ["d", "a"], 2, 2)) == [(2, "Quel", 3), (2, "Quel", 3)]
    with pytest.raises(ValueError):
        reading.page(df, ["d"], 1, 51)
    assert rows(reading.bands(df, [], ["d"], "g")) == [(1, 1, 2), (2, 2, 2), (3, 3, 1)]
    assert rows(reading.signals(df, ["g"], {"BIG": (F.col("d") > 3, F.col("d")), "NAMED": (F.col("a") == "Nim", F.col("a"))})) == [(1, "NAMED", "Nim"), (3, "BIG", "4")]
    assert rows(reading.timeline(("x", df.select("g", "d")), ("y", df.select("d", "a").limit(0)))) == [("x", 1), ("x", 2), ("x", 3), ("x", 3), ("x", 4)]
    assert [r.json for r in reading.documents(df.where("g = 1"), ["g"], ["a"], ["d"]).collect()] == ['{"g":1,"items":[{"a":"Nim"},{"a":"Vor"}]}']
    many = spark.createDataFrame([(1, i, f"n{i}") for i in range(40)] + [(2, 0, "x"), (None, 0, "y")], "g int, d int, a string")
    parts = reading.documents(many, ["g"], ["a"], ["d"], most=10).collect()
    assert {(r.g, r.parts) for r in parts} == {(1, 8), (2, 1), (None, 1)} and len(parts) > 4
    assert sorted(x["a"] for r in parts for x in json.loads(r.json)["items"]) == sorted(r.a for r in many.collect())
    assert all([int(x["a"][1:]) for x in json.loads(r.json)["items"]] == sorted(int(x["a"][1:]) for x in json.loads(r.json)["items"]) for r in parts if r.g == 1)


def test_integrity(spark):
    kids, parents = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id int, p string"), spark.createDataFrame([("a",), ("b",)], "k string")
    assert rows(integrity.missing_parents(kids, "p", parents, "k")) == [(2, "z")]
    assert rows(integrity.without_children(parents, "k", kids, "p")) == [("b",)]
    landed = spark.createDataFrame([("x\ty", ["x", "y"], ["h", "i"], "OK"), ("x", ["q"], ["h", "i"], "OK")], "line string, cells array<string>, header array<string>, status string").withColumn("line_sha256", F.sha2("line", 256))
    assert rows(integrity.bad_rows(landed).select("line", "rule")) == [("x", "SPLIT"), ("x", "WIDTH")]
    seen = spark.createDataFrame([(1, "x"), (2, "no"), (9, "x")], "row int, v string")
    source = spark.createDataFrame([(1, ["h"], ["x"]), (2, ["h"], ["y"])], "row int, header array<string>, cells array<string>")
    assert rows(integrity.not_as_in_source(seen, source, "row", {"v": "h"})) == [(2, "no"), (9, "x")]
    batches = spark.createDataFrame([("r", 1, 1, 10), ("r", 2, 11, 20), ("r", 4, 15, 30)], "r string, i int, a int, b int")
    assert rows(integrity.gaps_in_batches(batches, "r", "i", "a", "b")) == [("r", 4, 15, 30)]
    art = spark.createDataFrame([(1, "u", "s", 1, None), (2, "u", "t", 2, 1), (3, "w", "q", 3, 1), (4, "u", "t", 4, 2)], "id int, url string, sha string, at int, prev int")
    assert rows(integrity.changed_lineage(art, "url", "sha", "at", "prev", "id").select("id")) == [(3,), (4,)]


# Functions


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_text_functions(spark):
    assert column(spark, ["0", "-0.00", ".0", "0e5", "00", "0.1", "", "zero", None], tx.is_zero_text) == [True, True, True, True, True, False, False, False, None]
    assert column(spark, ["", "12", "-1.5", "3%", "2099-01-31", "1/2/99", "9999999901-99-000001", "https://x", "TRUE", "x", None], tx.lexical_class) == ["EMPTY", "INTEGER", "DECIMAL", "PERCENT", "ISO_DATE", "US_DATE", "ACCESSION", "URL", "BOOLEAN", "TEXT", None]
    assert column(spark, [0.0, 0.5, 1.0, 99.0, -1e8, 5e10, None], tx.magnitude_band, "double") == ["ZERO", "BELOW_1", "1E0", "1E1", "1E8", "1E9+", None]
    assert column(spark, ["A=1;InvestmentIdentifier(us)=Nim;", "InvestmentIdentifier=Vor", "InvestmentIdentifier=;", "XInvestmentIdentifier=no", None], tx.segment_member) == ["Nim", "Vor", None, None, None]
    assert column(spark, [" é ", " ab ", "\xa0x", "", None], tx.nfc_trimmed) == ["é", "ab", "\xa0x", "", None]
    assert column(spark, ["a[0].b[12]"], tx.source_field) == ["a[*].b[*]"]
    assert column(spark, ["USD", "usd", "pure"], tx.iso_currency) == ["USD", None, None]
    assert column(spark, ["First Lien (2)(15)", "Plain"], lambda v: F.array(*tx.trailing_markers(v))) == [["First Lien", "(2)(15)"], ["Plain", ""]]
    assert column(spark, ["<b>Nim</b>&amp;Vor", "x"], lambda v: tx.contains_needle(v, F.lit("&Vor"))) == [True, False]


def test_value_functions(spark):
    dates = column(spark, ["3/2101", "3/31/2101", "13/2101", "2/30/2101", "2101-03-31", "", None], vx.disclosed_date)
    assert [d and (d.precision, d.day, d.year, d.month) for d in dates] == [("MONTH", None, 2101, 3), ("DAY", D("2101-03-31"), 2101, 3), None, None, None, None, None]
    windows = column(spark, ["2099q4", "2099_02", "2099_13", "2099q5", None], vx.release_window)
    assert [w and (w.cadence, str(w.starts), str(w.ends)) for w in windows] == [("QUARTER", "2099-10-01", "2099-12-31"), ("MONTH", "2099-02-01", "2099-02-28"), None, None, None]
    numbers = column(spark, ["1,234.50", "(7)", "$ 3", "—", "n/a", "", None], lambda v: vx.displayed_decimal(v, 3))
    assert numbers == [Decimal(1234500), Decimal(-7000), Decimal(3000), Decimal(0), None, None, None]
    assert column(spark, ["-0.00", "-1.5", "2", "x"], vx.decimal_sign) == [0, -1, 1, None]
    assert column(spark, ["é", "ab"], lambda v: vx.length_matches(v, F.lit("2"))) == [True, True]


def test_session(spark):
    df = cut(spark.range(5), "t")
    assert at_most(df, 5) and not at_most(df, 4) and shared_dir(spark)
