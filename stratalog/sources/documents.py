"""Submission JSON, listing pages, the fetch log and the store of fetched bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.values import release_window
from stratalog.model.vocabulary import FILING_ARRAYS
from stratalog.operators.cells import arrays_to_rows
from stratalog.operators.profile import require_empty

_STRINGS = T.ArrayType(T.StringType())
_ARRAYS = T.StructType([T.StructField(n, _STRINGS) for n in FILING_ARRAYS])
_FILES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "filingCount", "filingFrom", "filingTo")]))
_MAIN = T.StructType(
    [*[T.StructField(n, T.StringType()) for n in ("cik", "name", "fiscalYearEnd", "stateOfIncorporation")], T.StructField("tickers", _STRINGS), T.StructField("exchanges", _STRINGS)]
    + [T.StructField("formerNames", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "from", "to")])))]
    + [T.StructField("filings", T.StructType([T.StructField("recent", _ARRAYS), T.StructField("files", _FILES)]))]
)


def submissions(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with `main`, the parsed submissions object, and `problem`: NOT_JSON, BAD_CIK, UNEQUAL_ARRAYS or null."""
    parsed = documents.withColumn("main", F.from_json(text, _MAIN))
    recent = F.col("main.filings.recent")
    sizes = F.array_distinct(F.array(*[F.size(recent[n]) for n in FILING_ARRAYS]))
    problem = F.when(F.col("main.cik").isNull(), "NOT_JSON").when(~F.col("main.cik").rlike(r"^[0-9]{10}\z"), "BAD_CIK").when(F.size(sizes) != 1, "UNEQUAL_ARRAYS")
    return parsed.withColumn("problem", problem)


def filing_rows(submissions_: DataFrame) -> DataFrame:
    """cik, pos and one column per array: a row per filing of every sound main object."""
    sound = submissions_.where("problem is null").select("main.cik", "main.filings.recent.*")
    return arrays_to_rows(sound, ["cik"], FILING_ARRAYS)


def page_rows(pages: DataFrame, text: str = "text", key: str = "cik") -> DataFrame:
    """The same of page files, which are the bare object of arrays."""
    return arrays_to_rows(pages.withColumn("__a", F.from_json(text, _ARRAYS)).select(key, "__a.*"), [key], FILING_ARRAYS)


def history_state(mains: DataFrame, pages: DataFrame) -> DataFrame:
    """cik, state: COVERED if every listed page is there with the filings it promises, else NOT_INGESTED. pages: name, n_filings."""
    listed = mains.where("problem is null").select("main.cik", F.explode_outer("main.filings.files").alias("f")).select("cik", "f.name", F.col("f.filingCount").try_cast("long").alias("promised"))
    joined = listed.join(pages.select("name", "n_filings"), "name", "left")
    whole = F.col("name").isNull() | F.coalesce(F.col("promised") == F.col("n_filings"), F.lit(False))
    return joined.groupBy("cik").agg(F.when(F.bool_and(whole), "COVERED").otherwise("NOT_INGESTED").alias("state"))


def page_anchors(pages: DataFrame, key: str, html: str, pattern: str = r'<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>') -> DataFrame:
    """key, pos, href, label of every anchor, the first of each href. Tags inside the label are dropped."""
    whole = F.regexp_extract_all(html, F.lit("(?is)" + pattern), F.lit(0))
    found = pages.select(key, F.posexplode(whole).alias("pos", "a"))
    part = lambda i: F.regexp_extract("a", "(?is)" + pattern, i)
    found = found.select(key, "pos", part(1).alias("href"), F.btrim(F.regexp_replace(part(2), "<[^>]+>", " ")).alias("label"))
    return found.groupBy(key, "href").agg(F.min(F.struct("pos", "label")).alias("first")).select(key, "first.pos", "href", "first.label")


#: Fixed value: how an archive of a release is named at the end of its address.
_ARCHIVE = r"/([0-9]{4}(?:q[1-4]|_[0-9]{2}))_bdc\.zip\z"


def release_anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Anchors that name an archive `<label>_bdc.zip`, with label and window (cadence, starts, ends)."""
    anchors = page_anchors(pages, key, html).withColumn("release", F.regexp_extract("href", _ARCHIVE, 1)).where("release <> ''")
    return anchors.select(key, "pos", "href", F.col("release"), release_window(F.col("release")).alias("window"))


_LOG = "seq long, session_id string, requested_at string, url string, final_url string, http_status int, content_type string, last_modified string, etag string, byte_size long, sha256 string, storage_key string, source_type string, context string, prev_sha256 string"


def fetch_log(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a fetch log (JSON lines); raises if a number is missing or stands twice, or a line does not name the hash of the line before it.

    Each line meets the one before it by its number, so the log is spread like any other table.
    """
    lines = spark.read.option("lineSep", "\n").text(path).where("value <> ''").withColumn("e", F.from_json("value", _LOG))
    numbered = lines.select(F.col("e.seq").alias("seq"), F.col("e.prev_sha256").alias("prev"), F.sha2("value", 256).alias("hash"))
    before = numbered.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before")).dropDuplicates(["seq"])
    checked = numbered.join(before, "seq", "left")
    broken = checked.where(F.col("seq").isNull() | F.when(F.col("seq") == 1, F.col("prev").isNotNull()).otherwise(F.col("before").isNull() | ~F.col("prev").eqNullSafe(F.col("before")))).select("seq")
    broken = broken.union(numbered.groupBy("seq").count().where("count > 1").select("seq"))
    require_empty(broken, "the fetch log is broken")
    return lines.select("e.*")


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256, intact of the files of a content-addressed store: each file is named by the hash of its bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    hashed = files.select("path", "content", F.sha2("content", 256).alias("sha256"))
    return hashed.withColumn("intact", F.element_at(F.split("path", "/"), -1) == F.col("sha256"))
