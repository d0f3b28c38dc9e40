"""Writers: append only, checked first, each batch written once."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators.profile import require_empty


def append(df: DataFrame, path: str, checks: dict[str, DataFrame] | None = None, partition_by: Sequence[str] = ()) -> None:
    """Append df to a Parquet table after all checks (name: violations) came back empty. There is no other write mode."""
    for name, violations in (checks or {}).items():
        require_empty(violations, name)
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_once(df: DataFrame, path: str, ledger: str, block: str, checks: dict[str, DataFrame] | None = None) -> bool:
    """append, unless the ledger (a Parquet table of blocks) names the block already; returns whether it wrote.

    The block is part of the path, so that a run that died before its ledger entry is replaced, not doubled.
    """
    spark = df.sparkSession
    known = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    exists = known.getFileSystem(spark._jsc.hadoopConfiguration()).exists(known)
    if exists and not spark.read.parquet(ledger).where(F.col("block") == block).isEmpty():
        return False
    for name, violations in (checks or {}).items():
        require_empty(violations, name)
    df.write.mode("overwrite").parquet(f"{path}/block={block}")
    spark.range(1).select(F.lit(block).alias("block"), F.current_timestamp().alias("recorded_at")).coalesce(1).write.mode("append").parquet(ledger)
    return True


def json_rows(df: DataFrame, order: Sequence[str], name: str = "json") -> DataFrame:
    """One JSON text per row, in order; for readers of documents rather than of tables."""
    return df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def _markdown(columns: Sequence[str]) -> Column:
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def report(df: DataFrame, title: str, rows: int = 1000) -> str:
    """A small result as a Markdown table in one text; a result with more rows than it says goes through write_report."""
    taken = df.select(_markdown(df.columns).alias("line")).take(rows + 1)
    if len(taken) > rows:
        raise ValueError(f"more than {rows} rows: write_report takes any number")
    line = lambda xs: "| " + " | ".join(xs) + " |"
    return "\n".join([f"## {title}", "", line(df.columns), line(["---"] * len(df.columns)), *[r["line"] for r in taken], ""])


def write_report(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A result of any size as Markdown table lines in text files, in order through the files, written by the executors. Each file begins with the table's head."""
    head = "\n".join(["| " + " | ".join(df.columns) + " |", "| " + " | ".join(["---"] * len(df.columns)) + " |"])
    lines = df.orderBy(*order).select(_markdown(df.columns).alias("line"))

    def with_head(batches):
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([head], batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    lines.mapInArrow(with_head, "line string").write.text(path)
