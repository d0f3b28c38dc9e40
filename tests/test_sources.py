"""Sources, sinks, streams and the document parsers, on made-up files."""

import datetime as dt
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from stratalog.functions.inline_xbrl import context_rows, document_blocks, document_facts, schedule_blocks, shown_dates
from stratalog.model import rules, vocabulary
from stratalog.model.vocabulary import FILING_ARRAYS, NUM_HEADER, SOI_HEADER
from stratalog.operators.cells import flatten
from stratalog.sources import archives, documents, sinks
from stratalog.streaming import ingest


@pytest.fixture
def archive(tmp_path):
    soi = "\t".join([*SOI_HEADER, "Extra"]) + "\n" + "\t".join(["x"] * 22) + "\n" + "\t".join(["y\r"] * 21) + "\n"
    wide = ["a", "t", "v", "20990331", "0", "USD", "", "0", "1", '"q\tw"', "3"]
    num = "\t".join(NUM_HEADER) + "\n" + "\t".join(wide) + "\nshort\n"
    path = tmp_path / "zips" / "2099_01_bdc.zip"
    path.parent.mkdir()
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("soi.tsv", soi)
        z.writestr("datasets/num.tsv", num)
        z.writestr("drift.tsv", "a\tb\n1\t2\n")
        z.writestr("empty.tsv", "")
        z.writestr("bad.tsv", b"h\n\xff\n")
    return str(path.parent)


def test_archives(spark, archive):
    members = {r.member: (r.size, r.sha256) for r in archives.archive_members(spark, archive).collect()}
    assert set(members) == {"soi.tsv", "datasets/num.tsv", "drift.tsv", "empty.tsv", "bad.tsv"} and members["empty.tsv"][1] == hashlib.sha256(b"").hexdigest()
    lines = archives.member_lines(spark, archive, "soi.tsv", rows=2)
    assert [r.line_number for r in lines.orderBy("line_number").collect()] == [1, 2, 3]
    loads, rows = archives.land(lines, "SOI")
    assert [r.parse_status for r in loads.collect()] == ["OK"]
    assert [(r.line_number, r.status, r.cells[0]) for r in rows.orderBy("line_number").collect()] == [(2, "OK", "x"), (3, "FIELD_COUNT_MISMATCH", "y\r")]
    loads, rows = archives.land(archives.member_lines(spark, archive, "datasets/num.tsv"), "NUM")
    got = {r.line_number: (r.status, len(r.cells), r.recovered) for r in rows.collect()}
    assert got[2][:2] == ("QUOTED_RECOVERY", 12) and got[2][2][9] == "q\tw" and got[3] == ("FIELD_COUNT_MISMATCH", 1, None)
    loads, rows = archives.land(archives.member_lines(spark, archive, "drift.tsv"), "SOI")
    assert [r.parse_status for r in loads.collect()] == ["SCHEMA_DRIFT"] and rows.count() == 0
    assert [(r.line_number, r.valid) for r in archives.member_lines(spark, archive, "bad.tsv").orderBy("line_number").collect()] == [(1, True), (2, False)]
    assert archives.member_lines(spark, archive, "empty.tsv").count() == archives.member_lines(spark, archive, "none.tsv").count() == 0


def test_csv_records(spark, tmp_path):
    text = '﻿a,"b\r\nc",""\r\n"say ""x""",,\n'
    assert archives.csv_records(text) == [('a,"b\r\nc",""', ["a", "b\r\nc", ""]), ('"say ""x""",,', ['say "x"', "", ""])]
    assert archives.csv_records("") == []
    for bad in ('a"b', '"a', '"a"b'):
        with pytest.raises(ValueError):
            archives.csv_records(bad)
    (tmp_path / "r.csv").write_bytes(text.encode())
    assert [(r.record_number, r.cells[0]) for r in archives.csv_table(spark, str(tmp_path / "r.csv")).collect()] == [(1, "a"), (2, 'say "x"')]


def test_submissions(spark):
    arrays = {n: [f"{n}1", f"{n}2"] for n in FILING_ARRAYS}
    main = {"cik": "9999999901", "name": "Nim", "filings": {"recent": arrays, "files": [{"name": "p1.json", "filingCount": 3}]}}
    short = json.loads(json.dumps(main))
    short["filings"]["recent"]["form"] = ["one"]
    df = spark.createDataFrame([("a", json.dumps(main)), ("b", json.dumps(short)), ("c", "{"), ("d", json.dumps({**main, "cik": "7"})), ("e", None)], "id string, text string")
    parsed = documents.submissions(df)
    assert {r.id: r.problem for r in parsed.collect()} == {"a": None, "b": "UNEQUAL_ARRAYS", "c": "NOT_JSON", "d": "BAD_CIK", "e": "NOT_JSON"}
    assert sorted((r.cik, r.pos, r.accessionNumber, r.form) for r in documents.filing_rows(parsed).collect()) == [("9999999901", 0, "accessionNumber1", "form1"), ("9999999901", 1, "accessionNumber2", "form2")]
    state = lambda n: documents.history_state(parsed, spark.createDataFrame([("p1.json", n)], "name string, n_filings long")).first().state
    assert state(3) == "COVERED" and state(2) == "NOT_INGESTED"
    pages = spark.createDataFrame([("9", json.dumps(arrays))], "cik string, text string")
    assert documents.page_rows(pages).count() == 2


def test_pages_log_and_store(spark, tmp_path):
    html = '<a class="x" href="/f/2099_02_bdc.zip">Feb <b>2099</b></a> <A HREF="/f/2099q3_bdc.zip">Q3</A><a href="/f/2099_02_bdc.zip">again</a><a href="/o">other</a>'
    pages = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert sorted((r.pos, r.href, r.label) for r in documents.page_anchors(pages, "id", "html").collect())[0] == (0, "/f/2099_02_bdc.zip", "Feb  2099")
    got = {r.release: (r.window.cadence, str(r.window.starts), str(r.window.ends)) for r in documents.release_anchors(pages, "id", "html").collect()}
    assert got == {"2099_02": ("MONTH", "2099-02-01", "2099-02-28"), "2099q3": ("QUARTER", "2099-07-01", "2099-09-30")}

    lines, before = [], None
    for seq in (1, 2, 3):
        lines.append(json.dumps({"seq": seq, "url": f"u{seq}", "prev_sha256": before}))
        before = hashlib.sha256(lines[-1].encode()).hexdigest()
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join(lines) + "\n")
    assert [r.url for r in documents.fetch_log(spark, str(log)).orderBy("seq").collect()] == ["u1", "u2", "u3"]
    log.write_text("\n".join([lines[0], lines[2]]) + "\n")
    with pytest.raises(ValueError):
        documents.fetch_log(spark, str(log))

    store = tmp_path / "raw" / "aa"
    store.mkdir(parents=True)
    (store / hashlib.sha256(b"x").hexdigest()).write_bytes(b"x")
    (store / "0000").write_bytes(b"y")
    assert sorted(r.intact for r in documents.stored_bytes(spark, str(tmp_path / "raw")).collect()) == [False, True]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "id int, x string")
    table, ledger = str(tmp_path / "t"), str(tmp_path / "ledger")
    assert sinks.append_once(df, table, ledger, "one") and not sinks.append_once(df, table, ledger, "one")
    assert spark.read.parquet(table).count() == 2
    with pytest.raises(ValueError):
        sinks.append_once(df, table, ledger, "two", {"no nulls": df.where("x is null")})
    sinks.append(df, str(tmp_path / "u"))
    sinks.append(df, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 4
    assert [r.json for r in sinks.json_rows(df, ["id"]).collect()][1] == '{"id":2,"x":null}'
    assert sinks.report(df, "T").splitlines()[4] == "| 1 | a\\|b |"


def test_streams(spark, tmp_path):
    source, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    make = lambda lo, hi: spark.range(lo, hi).select("id", F.timestamp_seconds(F.col("id") * 600).alias("at"))
    make(0, 10).write.parquet(source)
    for rows in (10, 15, 15):
        ingest.load_available(ingest.new_files(spark, source, "id long, at timestamp"), target, state).awaitTermination()
        assert spark.read.parquet(target).count() == rows
        if rows == 10:
            make(10, 15).write.mode("append").parquet(source)
    stream = ingest.windowed_counts(ingest.new_files(spark, source, "id long, at timestamp"), "at", [])
    stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("counted").collect()) == [3, 6, 6]
    assert ingest.sessions(make(0, 5).union(make(100, 102)), "at", []).count() == 2


def test_late_events_are_kept(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("events", "late", "ck"))
    at = lambda i, hour: spark.createDataFrame([(i, dt.datetime(2099, 1, 1, hour))], "id long, at timestamp").coalesce(1).write.mode("append").parquet(source)
    for i, hour in ((1, 2), (2, 9), (3, 8), (4, 3)):
        at(i, hour)
        ingest.keep_late(ingest.new_files(spark, source, "id long, at timestamp"), "at", target, checkpoint, "2 hours").awaitTermination()
    assert [r.id for r in spark.read.parquet(target).collect()] == [4]


def test_report_of_any_size(spark, tmp_path):
    df = spark.range(50).select("id", F.lit("a|b").alias("t"))
    sinks.write_report(df, str(tmp_path / "r"), ["id"])
    lines = [x.value for x in spark.read.text(str(tmp_path / "r")).collect()]
    assert {x for x in lines if x[2:3].isdigit()} == {f"| {i} | a\\|b |" for i in range(50)} and "| id | t |" in lines


def test_rules_and_vocabularies(spark):
    one = rules.rule("r", "NORMALISE", "1", "a")
    catalogue = rules.rules_frame(spark, [one])
    assert rules.register(catalogue, rules.rules_frame(spark, [one, rules.rule("r", "NORMALISE", "2", "b")])).count() == 1
    with pytest.raises(ValueError):
        rules.register(catalogue, rules.rules_frame(spark, [rules.rule("r", "NORMALISE", "1", "b")]))
    fields = "id int, state string, raw_text string, number decimal(38,10), date date, text string, scale_state string, precision string, reason string, currency_state string, currency_code string"
    rows = [
        (1, "REPORTED", "0.00", 0, None, None, "KNOWN", None, None, "FROM_FILING", "USD"), (2, "REPORTED", None, 1, None, None, "KNOWN", None, None, None, None), (3, "UNKNOWN", None, 1, None, None, None, None, None, None, None),
        (4, "REPORTED", "n/a", 0, None, None, "KNOWN", None, None, "UNKNOWN", "USD"), (5, "REPORTED", "3/2099", None, None, None, None, "MONTH", None, None, None),
    ]
    from decimal import Decimal

    df = spark.createDataFrame([tuple(Decimal(x) if i == 3 and x is not None else x for i, x in enumerate(r)) for r in rows], fields)
    got = sorted((r.id, r.rule) for r in vocabulary.value_shape_violations(df).collect())
    assert got == [(2, "REPORTED_WITHOUT_TEXT"), (3, "UNKNOWN_WITHOUT_REASON"), (3, "UNKNOWN_WITH_VALUE"), (4, "CURRENCY_STATE"), (4, "ZERO_NOT_DISCLOSED")]
    assert vocabulary.outside_vocabulary(df, "state", ("REPORTED",)).count() == 1


def test_flatten():
    assert flatten({"a": [1, None, "x"], "b": {"c": True}})[1:] == [
        ('$."a"', "$", None, "array", None), ('$."a"[0]', '$."a"', 0, "number", "1"), ('$."a"[1]', '$."a"', 1, "null", None), ('$."a"[2]', '$."a"', 2, "string", "x"),
        ('$."b"', "$", None, "object", None), ('$."b"."c"', '$."b"', None, "boolean", "true"),
    ]


def context(i, domain, end="2099-03-31"):
    return (
        f'<xbrli:context id="{i}"><xbrli:entity><xbrli:segment><xbrldi:typedMember dimension="us-gaap:InvestmentIdentifierAxis"><us-gaap:InvestmentIdentifierAxis.domain>{domain}</us-gaap:InvestmentIdentifierAxis.domain>'
        f"</xbrldi:typedMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>{end}</xbrli:instant></xbrli:period></xbrli:context>"
    )


def tr(*cells):
    return "<tr>" + "".join(f'<td colspan="2">{c}</td>' for c in cells) + "</tr>"


def fact(i, c, text):
    return f'<ix:nonFraction id="{i}" contextRef="{c}" name="us-gaap:FairValue" scale="3">{text}</ix:nonFraction>'


HTML = (
    context("c1", "Nim &amp; Vor, First Lien")
    + context("c2", "Quel, Equity")
    + "<table>"
    + tr("Portfolio Company, Location<br/>and Industry(1)", "Type of Investment", "Fair Value (2)", "Maturity")
    + tr("Software", "", "", "")
    + tr("Nim &amp; Vor", "", "", "")
    + tr("Chemicals", "First Lien", fact("f1", "c1", "1,200"), "3/31/2101")
    + tr("", "", fact("f9", "c9", "1,200"), "")
    + tr("Total Chemicals", "", "9", "")
    + tr("Quel", "", "", "")
    + tr("", "Equity", fact("f2", "c2", "(7)"), "4/2102")
    + tr("Broken", "", "", "")
    + "<tr><td><table><tr><td>x</td></tr></table></td></tr>"
    + "</table>"
)


def test_schedule_blocks(spark):
    blocks, refusals, excluded = schedule_blocks(HTML)
    assert [(b["company"], [r["kind"] for r in b["rows"]]) for b in blocks] == [
        ("Nim & Vor", ["COMPANY", "INVESTMENT_LINE_WITH_IDENTIFIER", "TOTAL_OR_SUBTOTAL"]),
        ("Quel", ["COMPANY", "INVESTMENT_LINE_WITH_IDENTIFIER"]),
    ]
    assert blocks[0]["rows"][1]["lines"] == [{"context": "c1", "domain": "Nim & Vor, First Lien"}]
    assert [r["reason"] for r in refusals] == ["nested table"]
    assert [(x["kind"], x["text"]) for x in excluded] == [("SECTION_LABEL", "Software"), ("SECTION_BOUNDARY", "Total Chemicals")]
    df = spark.createDataFrame([("d", HTML, 1), ("n", None, 1), ("e", "", 1)], "doc string, html string, row int")
    assert document_blocks(df, "doc", "html").where("domain is not null").count() == 2
    assert {(r.context, r.period_end, r.text) for r in document_facts(df, "doc", "html").collect()} == {("c1", "2099-03-31", "1,200"), ("c9", None, "1,200"), ("c2", "2099-03-31", "(7)")}


def test_shown_dates():
    assert shown_dates("due 3/31/2030, 12/2031 or 1/2/20 (/4/5/2032/) 13/14/15/2033 x7/2034y 123/2035 //") == (["3/31/2030", "4/5/2032"], ["12/2031", "7/2034"])
    assert shown_dates("") == ([], [])


def test_context_rows():
    rows = context_rows(HTML)
    assert [(r["contexts"], r["dates"], r["months"], r["maturity_column"]) for r in rows] == [(["c1"], ["3/31/2101"], [], 6), (["c9"], [], [], 6), (["c2"], [], ["4/2102"], 6)]
    assert context_rows(context("c1", "a") * 2 + "<table>" + tr(fact("f", "c1", "1")) + "</table>")[0]["period_ends"] == [None]
    assert context_rows("") == context_rows("<tr><td>unclosed") == []
