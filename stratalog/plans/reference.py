"""Queries of the evidence model's operators over the test tables, each with its SQL.

The star-schema tables have no domain columns, so an operator runs there on an analogue: a customer is a position, an order one of
its observations, an order's priority its unit, events are a log of grants. The disclosure tables are used as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import text as tx
from stratalog.operators import cells, chains, matching, periods, profile, states
from stratalog.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def quotient(a: str, b: str) -> str:
    """SQL of a / b, both given to at most eight digits, to six digits, rounded half up in whole numbers; null for a zero divisor."""
    n, d = f"CAST(({a}) * 100000000 AS HUGEINT)", f"CAST(({b}) * 100000000 AS HUGEINT)"
    return f"(CASE WHEN {d} <> 0 THEN CAST(CAST(sign({n}) * sign({d}) AS INT) * ((2 * abs({n}) * 1000000 + abs({d})) // (2 * abs({d}))) AS DECIMAL(30, 0)) * CAST(0.000001 AS DECIMAL(7, 6)) END)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate")).withColumn("value", F.col("o_totalprice").cast("decimal(18,2)"))


# Consecutive periods ------------------------------------------------------------------------------------------------

_PAIRS = """
WITH d AS (SELECT o_custkey, o_orderdate::DATE AS day, count(*) AS n, min(o_orderkey) AS id FROM orders GROUP BY ALL),
p AS (SELECT a.o_custkey, a.day AS d1, b.day AS d2, a.id AS i1, b.id AS i2 FROM d a JOIN d b ON a.o_custkey = b.o_custkey AND a.day < b.day AND a.n = 1 AND b.n = 1
  WHERE NOT EXISTS (SELECT 1 FROM d c WHERE c.o_custkey = a.o_custkey AND c.day > a.day AND c.day < b.day))
"""


@query(_PAIRS + "SELECT o_custkey AS position_id, strftime(d1, '%Y-%m-%d') AS earlier_date, strftime(d2, '%Y-%m-%d') AS later_date, i1 AS earlier_id, i2 AS later_id FROM p")
def consecutive_pairs(spark, sf):
    pairs = periods.consecutive_pairs(_orders(spark, sf), ["o_custkey"], "day", "o_orderkey")
    return pairs.select(F.col("o_custkey").alias("position_id"), F.col("earlier_date").cast("string"), F.col("later_date").cast("string"), "earlier_id", "later_id")


@query(
    _PAIRS
    + """SELECT p.o_custkey AS position_id, i1 AS earlier_id, i2 AS later_id,
  CASE WHEN a.o_orderpriority = b.o_orderpriority THEN 'COMPARABLE' ELSE 'INSUFFICIENT_DATA' END AS comparison_state,
  CASE WHEN a.o_orderpriority = b.o_orderpriority THEN (b.o_totalprice::DECIMAL(18,2) - a.o_totalprice::DECIMAL(18,2))::DOUBLE END AS delta,
  CASE WHEN a.o_orderpriority = b.o_orderpriority THEN a.o_totalprice::DECIMAL(18,2) <> b.o_totalprice::DECIMAL(18,2) END AS changed
FROM p JOIN orders a ON a.o_orderkey = i1 JOIN orders b ON b.o_orderkey = i2"""
)
def pair_deltas_currency_gate(spark, sf):
    orders = _orders(spark, sf)
    pairs = periods.consecutive_pairs(orders, ["o_custkey"], "day", "o_orderkey")
    both = periods.with_both_sides(pairs, orders, "o_orderkey", ["value", "o_orderpriority"])
    state = periods.comparable(F.col("e_value"), F.col("l_value"), F.col("e_o_orderpriority"), F.col("l_o_orderpriority"))
    ok = state == "COMPARABLE"
    return both.select(
        F.col("o_custkey").alias("position_id"), "earlier_id", "later_id", state.alias("comparison_state"),
        F.when(ok, (F.col("l_value") - F.col("e_value")).cast("double")).alias("delta"), F.when(ok, ~F.col("e_value").eqNullSafe(F.col("l_value"))).alias("changed"),
    )


_CENTS = "CAST({0}.o_totalprice AS DECIMAL(18, 2))"


@query(
    _PAIRS
    + f"""SELECT p.o_custkey AS position_id, i2 AS later_id, {quotient(f"({_CENTS.format('b')} - {_CENTS.format('a')}) * 100", _CENTS.format('a'))}::VARCHAR AS percent, {quotient(_CENTS.format('b'), _CENTS.format('a'))}::VARCHAR AS ratio
FROM p JOIN orders a ON a.o_orderkey = i1 JOIN orders b ON b.o_orderkey = i2"""
)
def percent_change(spark, sf):
    orders = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    both = periods.with_both_sides(periods.consecutive_pairs(orders, ["o_custkey"], "day", "o_orderkey"), orders, "o_orderkey", ["o_totalprice"])
    a, b = (F.col(f"{side}_o_totalprice").cast("decimal(18,2)") for side in "el")
    return both.select(F.col("o_custkey").alias("position_id"), "later_id", periods.percent_change(a, b).cast("string").alias("percent"), periods.ratio(b, a).cast("string").alias("ratio"))


_CHANGES = """
WITH c AS (
  SELECT user_id, count(*) FILTER (WHERE day = '2024-01-02') AS n0, count(*) FILTER (WHERE day = '2024-01-03') AS n1, min(event_id) FILTER (WHERE day = '2024-01-02') AS id0, min(event_id) FILTER (WHERE day = '2024-01-03') AS id1,
    min(event_type) FILTER (WHERE day = '2024-01-02') AS v0, min(event_type) FILTER (WHERE day = '2024-01-03') AS v1
  FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events) WHERE day IN ('2024-01-02', '2024-01-03') GROUP BY user_id),
r AS (SELECT user_id, CASE WHEN n0 > 1 OR n1 > 1 THEN 'AMBIGUOUS' WHEN n0 = 0 THEN 'NEW' WHEN n1 = 0 THEN 'NO_LONGER' WHEN v0 IS NOT DISTINCT FROM v1 THEN 'UNCHANGED' ELSE 'CHANGED' END AS change, id0, id1 FROM c)
"""


def _changes(spark, sf):
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    return periods.period_changes(events, ["user_id"], "day", "event_id", "event_type", "2024-01-02", "2024-01-03")


@query(_CHANGES + "SELECT user_id, change, CASE WHEN change <> 'AMBIGUOUS' THEN id0 END AS earlier_id, CASE WHEN change <> 'AMBIGUOUS' THEN id1 END AS later_id FROM r")
def period_changes(spark, sf):
    return _changes(spark, sf)


@query(_CHANGES + "SELECT change, count(*) AS n FROM r GROUP BY change")
def period_summary(spark, sf):
    return _changes(spark, sf).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderdate::DATE = (SELECT min(o_orderdate::DATE) FROM orders p WHERE p.o_custkey = o.o_custkey)")
def first_observed_ties(spark, sf):
    return periods.first_observed(_orders(spark, sf), ["o_custkey"], "day").select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, count(*) AS n_rows, count(DISTINCT o_orderdate::DATE) AS n_dates FROM orders GROUP BY o_custkey HAVING count(*) = count(DISTINCT o_orderdate::DATE)")
def unique_date_series(spark, sf):
    return periods.date_uniqueness(_orders(spark, sf), ["o_custkey"], "day").where("is_unique").drop("is_unique")


@query("SELECT o_custkey, count(*) AS n_rows, count(DISTINCT o_orderdate::DATE) AS n_dates FROM orders GROUP BY o_custkey HAVING count(*) <> count(DISTINCT o_orderdate::DATE)")
def duplicate_date_series(spark, sf):
    return periods.date_uniqueness(_orders(spark, sf), ["o_custkey"], "day").where("not is_unique").drop("is_unique")


@query(
    """WITH s AS (SELECT o_custkey, last_day(o_orderdate::DATE) AS m FROM orders GROUP BY ALL), b AS (SELECT o_custkey, min(m) AS lo, max(m) AS hi FROM s GROUP BY o_custkey),
e AS (SELECT o_custkey, last_day((date_trunc('month', lo) + to_months(CAST(3 * i AS INTEGER)))::DATE) AS m, hi FROM b, generate_series(0, 400) g(i))
SELECT o_custkey, strftime(e.m, '%Y-%m-%d') AS missing FROM e WHERE e.m <= e.hi AND NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = e.o_custkey AND s.m = e.m)"""
)
def quarter_gaps(spark, sf):
    return periods.quarter_gaps(_orders(spark, sf), ["o_custkey"], "day").select("o_custkey", F.col("missing").cast("string").alias("missing"))


# Chains -------------------------------------------------------------------------------------------------------------

_CHAIN = "WITH c AS (SELECT event_id, user_id, event_type, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS supersedes_id FROM events)\n"


def _chain(spark, sf, group=("user_id", "event_type")):
    return chains.previous_in_group(table(spark, sf, "events"), group, ["ts", "event_id"], "event_id")


@query(_CHAIN + "SELECT event_id, user_id, event_type FROM c WHERE NOT EXISTS (SELECT 1 FROM c s WHERE s.supersedes_id = c.event_id)")
def current_heads_events(spark, sf):
    return chains.current_heads(_chain(spark, sf), "event_id").select("event_id", "user_id", "event_type")


@query(
    "WITH c AS (SELECT event_id, user_id, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS supersedes_id FROM events) "
    "SELECT c.event_id AS id, 'SUBJECT' AS violation FROM c JOIN c p ON p.event_id = c.supersedes_id WHERE p.event_type IS DISTINCT FROM c.event_type "
    "UNION ALL SELECT event_id, 'SECOND_ROOT' FROM c WHERE supersedes_id IS NULL AND (user_id, event_type) IN (SELECT (user_id, event_type) FROM c WHERE supersedes_id IS NULL GROUP BY user_id, event_type HAVING count(*) > 1)"
)
def supersession_violations(spark, sf):
    return chains.supersession_violations(_chain(spark, sf, ("user_id",)), ["user_id", "event_type"], "event_id")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_grant(spark, sf):
    return chains.latest_by(table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query(
    """WITH l AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1),
f AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 50) AS a, bool_or(event_type = 'click' AND value > 50) AS p FROM l GROUP BY user_id)
SELECT user_id, CASE WHEN a THEN 'ADMIN' WHEN p THEN 'PRO' ELSE 'MEMBER' END AS role FROM f"""
)
def access_roles(spark, sf):
    latest = chains.latest_by(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])
    high = lambda kind: F.bool_or((F.col("event_type") == kind) & (F.col("value") > 50))
    flags = latest.groupBy("user_id").agg(high("purchase").alias("a"), high("click").alias("p"))
    return flags.select("user_id", states.first_match((F.col("a"), "ADMIN"), (F.col("p"), "PRO"), otherwise="MEMBER").alias("role"))


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 3 AS b FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey // 3 > 0),
w AS (SELECT a AS node, b AS goal FROM e UNION ALL SELECT w.node, e.b FROM w JOIN e ON e.a = w.goal),
n AS (SELECT a AS node FROM e UNION SELECT b FROM e)
SELECT n.node, coalesce((SELECT min(goal) FROM w WHERE w.node = n.node), n.node) AS canonical FROM n"""
)
def canonical_closure(spark, sf):
    edges = table(spark, sf, "customer").where("c_custkey % 4 <> 0 and c_custkey div 3 > 0").select(F.col("c_custkey").alias("a"), F.expr("c_custkey div 3").alias("b"))
    return matching.canonical(edges, "a", "b").select("node", "canonical")


# States and totals --------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, CASE count(DISTINCT l_returnflag) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'REPORTED' ELSE 'MULTIPLE_VALUES' END AS state, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS value FROM lineitem GROUP BY l_orderkey")
def three_state_attribute(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(states.three_state(F.col("l_returnflag")).alias("state"), states.single_value(F.col("l_returnflag")).alias("value"))


@query(
    """SELECT l_orderkey, CASE WHEN count(*) = 0 THEN 'UNKNOWN' WHEN count(*) > 1 THEN 'MULTIPLE_VALUES' ELSE min(CASE WHEN l_linestatus = 'O' THEN 'REPORTED' ELSE 'NOT_APPLICABLE' END) END AS state,
CASE WHEN count(*) = 1 THEN min(l_partkey) END AS only_part FROM lineitem GROUP BY l_orderkey"""
)
def four_state_field(spark, sf):
    state = F.when(F.col("l_linestatus") == "O", "REPORTED").otherwise("NOT_APPLICABLE")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(states.four_state(state, F.col("l_partkey").cast("string")).alias("state"), states.exactly_one(F.col("l_partkey")).alias("only_part"))


@query(
    "SELECT l_orderkey, "
    + ", ".join(
        f"CASE count(DISTINCT l_linestatus) FILTER (WHERE l_returnflag = '{x}') WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'REPORTED' ELSE 'MULTIPLE_VALUES' END AS {x.lower()}_state, "
        f"CASE WHEN count(DISTINCT l_linestatus) FILTER (WHERE l_returnflag = '{x}') = 1 THEN min(l_linestatus) FILTER (WHERE l_returnflag = '{x}') END AS {x.lower()}_value"
        for x in "ANR"
    )
    + " FROM lineitem GROUP BY l_orderkey"
)
def conditional_pivot(spark, sf):
    return states.pivot_states(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linestatus", ["A", "N", "R"])


@query(
    """SELECT l_orderkey, CASE WHEN NOT bool_and(l_quantity > 5) THEN 'INCOMPLETE' WHEN count(DISTINCT l_linestatus) > 1 THEN 'MIXED_UNITS' ELSE 'TOTAL' END AS state,
CASE WHEN bool_and(l_quantity > 5) AND count(DISTINCT l_linestatus) = 1 THEN sum(l_extendedprice::DECIMAL(18,2))::DOUBLE END AS total,
CASE WHEN bool_and(l_quantity > 5) AND count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS unit FROM lineitem GROUP BY l_orderkey"""
)
def guarded_total(spark, sf):
    state, total, unit = states.guarded_total(F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity") > 5, F.col("l_linestatus"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(state.alias("state"), total.cast("double").alias("total"), unit.alias("unit"))


@query(
    """WITH k AS (SELECT c_nationkey, o_orderpriority, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 'REPORTED' ELSE 'MULTIPLE_VALUES' END AS state FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT n.n_nationkey, p.o_orderpriority, coalesce(k.state, 'UNKNOWN') AS state FROM nation n CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p LEFT JOIN k ON k.c_nationkey = n.n_nationkey AND k.o_orderpriority = p.o_orderpriority"""
)
def grid_status(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    known = orders.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority").agg(states.three_state(F.col("o_orderstatus")).alias("state"))
    return states.status_grid(table(spark, sf, "nation").select("n_nationkey"), orders.select("o_orderpriority").distinct(), known, ["n_nationkey", "o_orderpriority"], "state")


@query(
    """WITH f AS (SELECT c_nationkey, c_custkey, bool_or(o_orderpriority = '1-URGENT') AS urgent, bool_or(o_totalprice > 200000) AS large FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT c_nationkey, count(*) FILTER (WHERE urgent) AS with_urgent, count(*) FILTER (WHERE NOT urgent) AS without_urgent, count(*) FILTER (WHERE large) AS with_large, count(*) FILTER (WHERE NOT large) AS without_large FROM f GROUP BY c_nationkey"""
)
def cell_coverage(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return states.cell_presence(rows, ["c_custkey"], ["c_nationkey"], {"urgent": F.col("o_orderpriority") == "1-URGENT", "large": F.col("o_totalprice") > 200000})


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'AUTHORITATIVE' WHEN l_linestatus = 'F' THEN 'REPORTED_STRUCTURED' WHEN l_discount = 0 THEN 'NOT_APPLICABLE' WHEN l_tax > 0.05 THEN 'PROVISIONAL' ELSE 'UNRESOLVED' END AS authority FROM lineitem"""
)
def authority_case(spark, sf):
    final = F.col("l_linestatus") == "F"
    case = states.first_match((final & (F.col("l_returnflag") == "A"), "AUTHORITATIVE"), (final, "REPORTED_STRUCTURED"), (F.col("l_discount") == 0, "NOT_APPLICABLE"), (F.col("l_tax") > 0.05, "PROVISIONAL"), otherwise="UNRESOLVED")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", case.alias("authority"))


@query("SELECT o_orderpriority, count(*) AS population, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS n_other FROM orders GROUP BY o_orderpriority")
def field_coverage(spark, sf):
    return states.field_coverage(table(spark, sf, "orders"), ["o_orderpriority"], ["F", "O"], "o_orderstatus")


# Counts, arrays, pages ----------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_groups(spark, sf):
    return profile.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent FROM orders GROUP BY 1")
def date_counts(spark, sf):
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent")]
    return _orders(spark, sf).groupBy(F.col("day").cast("string").alias("day")).agg(*counts)


@query("SELECT year(l_shipdate)::INTEGER AS year, count(*) AS n FROM lineitem GROUP BY 1")
def year_buckets(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def market_distinct_per_date(spark, sf):
    return _orders(spark, sf).groupBy(F.col("day").cast("string").alias("day")).agg(F.count_distinct("o_custkey").alias("n"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 100")
def holdings_page(spark, sf):
    return table(spark, sf, "customer").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").offset(100).limit(50).select("c_custkey", "c_name")


@query(
    """WITH p AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 50)
SELECT p.o_orderkey, c.c_name, n.n_name FROM p JOIN customer c ON c.c_custkey = p.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey"""
)
def keyset_then_enrich(spark, sf):
    page = table(spark, sf, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").offset(50).limit(50)
    named = F.broadcast(page).join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))  # a page has 50 rows
    return named.join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT n_nationkey, s.s_suppkey FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) AS rn FROM supplier) s ON s.s_nationkey = n_nationkey AND rn = 1")
def top1_document(spark, sf):
    top = chains.latest_by(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"], ["s_acctbal", "s_suppkey"])
    return table(spark, sf, "nation").join(top, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "s_suppkey")


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '|') AS priorities, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey")
def sorted_distinct_arrays(spark, sf):
    kept = F.array_sort(F.collect_set("o_orderpriority"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(kept, "|").alias("priorities"), F.size(kept).cast("long").alias("n"))


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ' · ' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def string_agg_distinct(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), " · ").alias("segments"))


@query("SELECT o_custkey, (SELECT o_orderpriority FROM orders p WHERE p.o_custkey = o.o_custkey AND o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 1) AS earliest FROM orders o GROUP BY o_custkey")
def earliest_text(spark, sf):
    final = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by(F.when(final, F.col("o_orderpriority")), F.when(final, F.struct("o_orderdate", "o_orderkey"))).alias("earliest"))


@query(
    """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(DISTINCT o_orderdate::DATE) FROM orders WHERE o_custkey = c_custkey) AS n_dates,
(SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders WHERE o_custkey = c_custkey) AS last_date, (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey) AS n_lines,
EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_urgent FROM customer"""
)
def inventory_correlated_counts(spark, sf):
    orders = _orders(spark, sf)
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    per = orders.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_distinct("day").alias("n_dates"), F.max("day").cast("string").alias("last_date"), F.sum("lines").alias("n_lines"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("has_urgent")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return table(spark, sf, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", zero("n_orders"), zero("n_dates"), "last_date", zero("n_lines"), F.coalesce("has_urgent", F.lit(False)).alias("has_urgent"))


@query("SELECT c_custkey AS key, c_nationkey AS left_value, s_nationkey AS right_value FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_nationkey IS DISTINCT FROM s_nationkey")
def filing_history_disagree(spark, sf):
    both = table(spark, sf, "customer").join(table(spark, sf, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    return both.where(~F.col("c_nationkey").eqNullSafe(F.col("s_nationkey"))).select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("left_value"), F.col("s_nationkey").alias("right_value"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_orphans(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def semi_links(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_quantity >= 49")
    return table(spark, sf, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query(
    """WITH t AS (SELECT 'ORDER' AS kind, o_custkey AS subject, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS moment, o_orderkey AS ref FROM orders UNION ALL SELECT 'EVENT', user_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), event_id FROM events)
SELECT * FROM t"""
)
def union_event_timeline(spark, sf):
    orders = table(spark, sf, "orders").select(F.lit("ORDER").alias("kind"), F.col("o_custkey").alias("subject"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("moment"), F.col("o_orderkey").alias("ref"))
    events = table(spark, sf, "events").select(F.lit("EVENT").alias("kind"), F.col("user_id").alias("subject"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("moment"), F.col("event_id").alias("ref"))
    return orders.unionByName(events)


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%0001%' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority ILIKE '%urg%' AND o_totalprice > 300000)")
def search_ilike(spark, sf):
    hits = table(spark, sf, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("kinds"))
    joined = table(spark, sf, "customer").join(hits, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where(F.col("c_name").ilike("%0001%") | F.coalesce(F.exists("kinds", lambda x: x.ilike("%urg%")), F.lit(False))).select("c_custkey")


# Matching and names -------------------------------------------------------------------------------------------------


@query(
    """WITH f AS (SELECT l_partkey AS k, l_quantity AS v, count(*) AS n, min(l_orderkey) AS one FROM lineitem GROUP BY ALL), a AS (SELECT DISTINCT l_partkey AS k FROM lineitem)
SELECT p_partkey, CASE WHEN a.k IS NULL THEN 'NO_CANDIDATE' WHEN f.n IS NULL THEN 'NOT_EQUAL' WHEN f.n > 1 THEN 'MULTIPLE' ELSE 'BOUND' END AS outcome, CASE WHEN f.n = 1 THEN f.one END AS matched
FROM part LEFT JOIN a ON a.k = p_partkey LEFT JOIN f ON f.k = p_partkey AND f.v = p_size"""
)
def unique_match_bind(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("size"))
    facts = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").cast("double").alias("quantity"), "l_orderkey")
    return matching.unique_match(parts, facts, "p_partkey", ["k"], "size", "quantity", "l_orderkey")



@query("SELECT bno_id, array_to_string(list_filter(regexp_extract_all(upper(normalized_text), '[A-Z0-9]+'), lambda x: x NOT IN ('LLC','INC','CORP','CORPORATION','LTD','LIMITED','LP','LLP','CO','COMPANY','PLC','HOLDINGS')), ' ') AS core FROM p6_names WHERE normalized_text IS NOT NULL")
def core_tokens(spark, sf):
    return table(spark, sf, "p6_names").where("normalized_text is not null").select("bno_id", F.array_join(tx.core_tokens(F.col("normalized_text")), " ").alias("core"))


@query(
    """WITH t AS (SELECT bno_id, regexp_extract_all(upper(normalized_text), '[A-Z0-9]+') AS w FROM p6_names WHERE normalized_text IS NOT NULL),
c AS (SELECT min(bno_id) AS id, array_to_string(list_filter(w, lambda x: x NOT IN ('LLC','INC','CORP','CORPORATION','LTD','LIMITED','LP','LLP','CO','COMPANY','PLC','HOLDINGS')), ' ') AS core,
  array_to_string(list_filter(w, lambda x: x IN ('LLC','INC','CORP','CORPORATION','LTD','LIMITED','LP','LLP','CO','COMPANY','PLC','HOLDINGS')), ' ') AS suffix FROM t GROUP BY 2, 3)
SELECT a.id AS id_a, b.id AS id_b, a.core FROM c a JOIN c b ON a.core = b.core AND a.id < b.id AND a.suffix <> b.suffix WHERE a.core <> ''"""
)
def near_name_candidates(spark, sf):
    names = table(spark, sf, "p6_names").where("normalized_text is not null")
    joined = lambda x: F.array_join(x, " ")
    return matching.near_name_pairs(names, "bno_id", joined(tx.core_tokens(F.col("normalized_text"))), joined(tx.suffix_tokens(F.col("normalized_text"))))


@query("SELECT doc_id, trim(nfc_normalize(text), ' ') AS name FROM documents")
def registrant_name_nfc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.nfc_trimmed(F.col("text")).alias("name"))


@query("SELECT a.doc_id AS id_a, b.doc_id AS id_b FROM (SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1) a JOIN (SELECT sha256(text) AS h, doc_id FROM documents WHERE text IS NOT NULL) b ON a.h = b.h AND a.doc_id <> b.doc_id")
def line_hash_equivalence(spark, sf):
    hashed = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    classes = hashed.groupBy("h").agg(F.min("doc_id").alias("id_a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return hashed.join(classes, "h").where("doc_id <> id_a").select("id_a", F.col("doc_id").alias("id_b"))


# Profiles -----------------------------------------------------------------------------------------------------------

_CLASS = """CASE WHEN x = '' THEN 'EMPTY' WHEN regexp_full_match(x, '-?[0-9]+') THEN 'INTEGER' WHEN regexp_full_match(x, '-?[0-9]+\\.[0-9]+') THEN 'DECIMAL' WHEN regexp_full_match(x, '-?[0-9]+(\\.[0-9]+)?%') THEN 'PERCENT'
WHEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'ISO_DATE' WHEN regexp_full_match(x, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}') THEN 'US_DATE' WHEN regexp_full_match(x, '[0-9]{10}-[0-9]{2}-[0-9]{6}') THEN 'ACCESSION'
WHEN regexp_matches(x, '^https?://') THEN 'URL' WHEN lower(x) IN ('true', 'false') THEN 'BOOLEAN' WHEN x IS NOT NULL THEN 'TEXT' END"""


@query(f"SELECT c AS \"column\", {_CLASS} AS class, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS x FROM sj_filing" for c in ("accession_number", "report_date", "sj_form", "act", "file_number")) + ") GROUP BY 1, 2")
def lexical_profile(spark, sf):
    return profile.class_profile(table(spark, sf, "sj_filing"), ["accession_number", "report_date", "sj_form", "act", "file_number"], tx.lexical_class)


@query("SELECT CASE WHEN c_acctbal = 0 THEN 'ZERO' WHEN abs(c_acctbal) < 1 THEN 'BELOW_1' ELSE '1E' || floor(log10(abs(c_acctbal)))::INTEGER END AS band, count(*) AS n FROM customer GROUP BY 1")
def magnitude_bands(spark, sf):
    return table(spark, sf, "customer").groupBy(tx.magnitude_band(F.col("c_acctbal")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'order_line' AS candidate, sum(n)::BIGINT AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_repeated FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL SELECT 'order_line_part', sum(n)::BIGINT, count(*), count(*) FILTER (WHERE n > 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey)"""
)
def candidate_keys(spark, sf):
    return profile.candidate_keys(table(spark, sf, "lineitem"), {"order_line": ["l_orderkey", "l_linenumber"], "order_line_part": ["l_orderkey", "l_linenumber", "l_partkey"]})


@query("SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS least, list_sort(list(o_totalprice))[(count(*) // 2) + 1] AS median, max(o_totalprice) AS greatest FROM orders GROUP BY o_orderpriority")
def exact_median(spark, sf):
    return profile.upper_median(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")


@query("SELECT c_nationkey, count(*) AS n_expected, count(o) AS n_received, round(count(o) * 10000.0 / count(*)) / 100 AS percent FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey GROUP BY c_nationkey")
def coverage_percent(spark, sf):
    return profile.coverage_percent(table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", ["c_nationkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_discount::DECIMAL(9,2)::VARCHAR AS text, l_discount::DECIMAL(9,2) = 0 AS is_zero FROM lineitem")
def zero_text(spark, sf):
    text = F.col("l_discount").cast("decimal(9,2)").cast("string")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"), tx.is_zero_text(text).alias("is_zero"))


@query("SELECT event_id, '$.\"k\"' AS path, 'number' AS type, json_extract_string(props, '$.k') AS text FROM events WHERE props IS NOT NULL")
def json_flatten(spark, sf):
    flat = cells.flatten_json(table(spark, sf, "events"), ["event_id"], "props")
    return flat.where("container <> ''").select("event_id", "path", "type", "text")
