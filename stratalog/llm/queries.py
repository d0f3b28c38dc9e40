"""The queries of the text problems over the test tables (p2, p5, p7, p8, p9)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.encoding import decode_corpus, encode_corpus
from stratalog.llm.leakage import item_matches, leaked_items
from stratalog.llm.lookalike import form_sql, lookalike_pairs, with_form
from stratalog.llm.names import name_of_line
from stratalog.llm.resolution import resolve_names, same_entity_pairs
from stratalog.llm.spans import shared_characters
from stratalog.session import table


def _named_rows(spark: SparkSession, sf: str) -> DataFrame:
    """id, text of p6_names; where a name was not extracted, it is read from the schedule line."""
    names = table(spark, sf, "p6_names").select(F.col("bno_id").alias("id"), "soi_row_id", "normalized_text")
    known = names.where("normalized_text is not null").select("id", F.col("normalized_text").alias("text"))
    lines = table(spark, sf, "soi_row_observation").select("soi_row_id", "identifier_raw").where("identifier_raw is not null")
    open_names = names.where("normalized_text is null").join(lines, "soi_row_id")

    @F.pandas_udf("string")
    def named(line: pd.Series, _: pd.Series) -> pd.Series:
        return line.map(name_of_line)

    # The id keeps the function above the join, so that only the lines of open names reach it.
    return known.unionByName(open_names.select("id", named("identifier_raw", "id").alias("text")))


def p2_entities(spark: SparkSession, sf: str) -> DataFrame:
    """bno_id and the number of rows of its borrower, under the least bno_id of them."""
    resolved = resolve_names(_named_rows(spark, sf))
    least = resolved.groupBy("entity").agg(F.min("id").alias("entity_id"), F.count(F.lit(1)).alias("n_rows"))
    return resolved.join(least, "entity").select(F.col("id").alias("bno_id"), "entity_id", "n_rows")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_entity_pairs(resolve_names(_named_rows(spark, sf)), "bno_id_a", "bno_id_b")


def _visible_rows(spark: SparkSession, sf: str) -> DataFrame:
    soi = table(spark, sf, "soi_row_observation").select(F.lit("soi").alias("record_kind"), F.col("filing_id").alias("scope"), F.col("soi_row_id").alias("id"), F.col("identifier_raw").alias("raw"))
    names = table(spark, sf, "p6_names").select(F.lit("name").alias("record_kind"), F.lit(0).cast("long").alias("scope"), F.col("bno_id").alias("id"), F.col("normalized_text").alias("raw"))
    return soi.unionByName(names)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_pairs(_visible_rows(spark, sf))


def p5_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Each row's text in its one form."""
    return with_form(_visible_rows(spark, sf)).select("record_kind", "id", "form")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def p7_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and the text that its ids decode to."""
    ids = p7_ids(spark, sf)
    return decode_corpus(ids, "doc_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_item"), "item_id", "item_text")


def p8_matches(spark: SparkSession, sf: str) -> DataFrame:
    return item_matches(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_item"), "item_id", "item_text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_characters(table(spark, sf, "documents"), "doc_id", "text", 300)


QUERIES = {f.__name__: f for f in (p2_found, p2_entities, p5_found, p5_forms, p7_ids, p7_roundtrip, p8_found, p8_matches, p9_found)}

_FORMS = f"""
WITH rows AS (SELECT 'soi' AS record_kind, filing_id AS scope, soi_row_id AS id, identifier_raw AS raw FROM soi_row_observation UNION ALL SELECT 'name', 0, bno_id, normalized_text FROM p6_names),
forms AS (SELECT record_kind, scope, id, raw, {form_sql("raw")} AS form FROM rows)
"""

SQL = {
    # The form itself is tested against plain Python; here the pairs are what is compared.
    "p5_found": _FORMS + "SELECT a.record_kind, a.id AS id_a, b.id AS id_b FROM forms a JOIN forms b ON a.record_kind = b.record_kind AND a.scope = b.scope AND a.form = b.form AND a.raw <> b.raw AND a.id < b.id",
    "p5_forms": _FORMS + "SELECT record_kind, id, form FROM forms",
    "p7_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_found": r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(item_text, '[\p{L}\p{Nd}]+'), lambda x: lower(x)) AS w FROM eval_item),
dg AS (SELECT doc_id, array_to_string(w[s:s + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS s FROM d)),
ig AS (SELECT item_id, array_to_string(w[s:s + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
    "p8_matches": r"""
WITH d AS (SELECT DISTINCT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT DISTINCT item_id, list_transform(regexp_extract_all(item_text, '[\p{L}\p{Nd}]+'), lambda x: lower(x)) AS w FROM eval_item),
dw AS (SELECT doc_id, pos, w[pos] AS a, w[pos + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d)),
iw AS (SELECT item_id, i, w[i] AS a, w[i + 1] AS b FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
f AS (SELECT a, b, count(*) AS n FROM dw GROUP BY a, b),
r AS (SELECT item_id, i, coalesce(n, 0) * 100000 + i AS rank FROM iw LEFT JOIN f USING (a, b) WHERE iw.b IS NOT NULL),
best AS (SELECT item_id, min(rank) OVER v AS rank, count(*) OVER v AS size FROM r WINDOW v AS (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING)),
anchor AS (SELECT DISTINCT item_id, rank % 100000 AS i FROM best WHERE size = 11 AND rank >= 100000),
al AS (SELECT DISTINCT doc_id, item_id, dw.pos - iw.i AS shift FROM anchor JOIN iw USING (item_id, i) JOIN dw ON dw.a = iw.a AND dw.b = iw.b),
ex AS (SELECT al.doc_id, al.item_id, shift, i, i - row_number() OVER (PARTITION BY al.doc_id, al.item_id, shift ORDER BY i) AS island
       FROM al JOIN iw ON iw.item_id = al.item_id JOIN dw ON dw.doc_id = al.doc_id AND dw.pos = iw.i + shift AND dw.a = iw.a AND dw.b = iw.b),
phrase AS (SELECT doc_id, item_id, max(n) + 1 AS n_words FROM (SELECT doc_id, item_id, shift, island, count(*) AS n FROM ex GROUP BY ALL) WHERE n >= 11 GROUP BY ALL),
fw AS (SELECT a, count(*) AS n FROM dw GROUP BY a),
rw AS (SELECT item_id, i, coalesce(n, 0) * 100000 + i AS rank FROM iw LEFT JOIN fw USING (a)),
two AS (SELECT item_id, list_sort(list(rank) OVER v) AS ranks FROM rw WINDOW v AS (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
loose AS (SELECT DISTINCT doc_id, item_id, dw.pos - iw.i AS shift, second FROM (SELECT DISTINCT item_id, ranks[1] % 100000 AS i, ranks[2] % 100000 AS second FROM two WHERE len(ranks) = 12 AND ranks[1] >= 100000) s JOIN iw USING (item_id, i) JOIN dw ON dw.a = iw.a),
ok AS (SELECT DISTINCT l.doc_id, l.item_id, shift FROM loose l JOIN iw ON iw.item_id = l.item_id AND iw.i = l.second JOIN dw ON dw.doc_id = l.doc_id AND dw.a = iw.a AND abs(dw.pos - iw.i - shift) <= 3),
near AS (SELECT ok.doc_id, ok.item_id, shift, count(DISTINCT i) AS n FROM ok JOIN iw ON iw.item_id = ok.item_id JOIN dw ON dw.doc_id = ok.doc_id AND dw.a = iw.a AND abs(dw.pos - iw.i - shift) <= 3 GROUP BY ALL)
SELECT doc_id, item_id, 'phrase' AS kind, n_words FROM phrase
UNION ALL SELECT doc_id, item_id, 'proximity', max(n) FROM near WHERE n >= 12 AND NOT EXISTS (SELECT 1 FROM phrase p WHERE p.doc_id = near.doc_id AND p.item_id = near.item_id) GROUP BY doc_id, item_id
""",
    "p9_found": """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 300),
g AS (SELECT doc_id, s, md5(substr(text, s, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, n - 298)) AS s FROM d)),
m AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
k AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS later FROM g SEMI JOIN m USING (h))
SELECT doc_id, sum(least(300, coalesce(later - s, 300)))::BIGINT AS shared_chars FROM k GROUP BY doc_id
""",
}
