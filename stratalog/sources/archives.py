"""Archives and delimited members: landed line by line without loss."""

from __future__ import annotations

import hashlib
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.cells import split_quoted
from stratalog.model.vocabulary import SOURCE_TABLES


def _opened(path: str):
    """The file under a URI, opened for reading at any place; nothing of it is held in memory."""
    filesystem, at = fs.FileSystem.from_uri(path)
    return filesystem.open_input_file(at)


def _paths(spark: SparkSession, path: str) -> DataFrame:
    """One row per file under a path; only the names are read here, each file is opened by its task."""
    return spark.read.format("binaryFile").load(path).select("path").repartition(spark.sparkContext.defaultParallelism)


def _sha256(file) -> str:
    digest = hashlib.sha256()
    while block := file.read(1 << 20):
        digest.update(block)
    return digest.hexdigest()


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, size, sha256 of every member of the ZIP files under a path."""

    def describe(batches):
        for batch in batches:
            rows = []
            for archive in batch["path"]:
                with _opened(archive) as f, zipfile.ZipFile(f) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            with z.open(i) as member:
                                rows.append((archive, i.filename, i.file_size, _sha256(member)))
            yield pd.DataFrame(rows, columns=["archive", "member", "size", "sha256"])

    return _paths(spark, path).mapInPandas(describe, "archive string, member string, size long, sha256 string")


def member_lines(spark: SparkSession, path: str, member: str, rows: int = 20_000) -> DataFrame:
    """archive, line_number, line, valid of a text member of the ZIP files under a path, streamed in blocks.

    Lines end with a line feed only; a carriage return stays in its line; a final empty line is none; line 1 is the header. valid is
    false where a line is no UTF-8 (its bytes then stand as replacement characters).
    """

    def read(batches):
        for batch in batches:
            for archive in batch["path"]:
                with _opened(archive) as f, zipfile.ZipFile(f) as z:
                    if member not in z.namelist():
                        continue
                    block = []
                    with z.open(member) as file:
                        for number, raw in enumerate(file, 1):
                            raw = raw[:-1] if raw.endswith(b"\n") else raw
                            try:
                                block.append((archive, number, raw.decode("utf-8"), True))
                            except UnicodeDecodeError:
                                block.append((archive, number, raw.decode("utf-8", "replace"), False))
                            if len(block) == rows:
                                yield pd.DataFrame(block, columns=["archive", "line_number", "line", "valid"])
                                block = []
                    yield pd.DataFrame(block, columns=["archive", "line_number", "line", "valid"])

    return _paths(spark, path).mapInPandas(read, "archive string, line_number long, line string, valid boolean")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file and line of plain text files; lines end with a line feed only. Splittable, so without line numbers."""
    return spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def land(lines: DataFrame, code: str, key: str = "archive") -> tuple[DataFrame, DataFrame]:
    """(loads, rows) of one table's lines.

    loads: key, header, parse_status (OK, EMPTY without any line, SCHEMA_DRIFT if the header is not the documented one; SCHEMA_DRIFT loads have no
    rows). rows: key, line_number, line, line_sha256, cells, status (OK, FIELD_COUNT_MISMATCH, QUOTED_RECOVERY), recovered. Cells come from plain splitting, byte for
    byte; a NUM line of the wrong width whose quoted reading has the right one keeps its plain cells and gets recovered.
    """
    documented, open_ended, delimiter = SOURCE_TABLES[code]
    heads = lines.where("line_number = 1").select(key, F.split("line", delimiter, -1).alias("header"))
    start = F.slice("header", 1, len(documented)) if open_ended else F.col("header")
    same = start == F.array(*[F.lit(x) for x in documented])
    loads = lines.select(key).distinct().join(heads, key, "left").withColumn("parse_status", F.when(F.col("header").isNull() | (F.array_join("header", "") == ""), "EMPTY").when(same, "OK").otherwise("SCHEMA_DRIFT"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def quoted(line: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else split_quoted(x, delimiter) for x in line], dtype=object)

    rows = lines.where("line_number > 1").join(loads.where("parse_status = 'OK'").select(key, F.size("header").alias("width")), key)
    rows = rows.withColumn("cells", F.split("line", delimiter, -1))
    wrong = F.size("cells") != F.col("width")
    rows = rows.withColumn("__quoted", quoted(F.when(wrong & F.col("line").contains('"') & F.lit(code == "NUM"), F.col("line"))))
    saved = wrong & (F.size("__quoted") == F.col("width"))
    status = F.when(~wrong, "OK").when(F.coalesce(saved, F.lit(False)), "QUOTED_RECOVERY").otherwise("FIELD_COUNT_MISMATCH")
    rows = rows.select(key, "line_number", "line", F.sha2("line", 256).alias("line_sha256"), "cells", status.alias("status"), F.when(status == "QUOTED_RECOVERY", F.col("__quoted")).alias("recovered"))
    return loads, rows


def csv_records(text: str) -> list[tuple[str, list[str]]]:
    """(raw text, cells) of every record: quoted cells may hold delimiters and line ends, a leading byte order mark is none of the text."""
    text, out, i = text.removeprefix("﻿"), [], 0
    while i < len(text):
        begin, cells = i, []
        while True:
            if text.startswith('"', i):
                j = i + 1
                while (k := text.find('"', j)) >= 0 and text.startswith('"', k + 1):
                    j = k + 2
                if k < 0:
                    raise ValueError(f"a quoted cell that begins at {i} never ends")
                cells.append(text[i + 1 : k].replace('""', '"'))
                i = k + 1
            else:
                j = i
                while j < len(text) and text[j] not in ",\r\n":
                    if text[j] == '"':
                        raise ValueError(f"a quotation mark inside an unquoted cell at {j}")
                    j += 1
                cells.append(text[i:j])
                i = j
            if text.startswith(",", i):
                i += 1
                continue
            break
        end = i
        if text.startswith("\r\n", i):
            i += 2
        elif i < len(text):
            if text[i] not in "\r\n":
                raise ValueError(f"text after a quoted cell at {i}")
            i += 1
        out.append((text[begin:end], cells))
    return out


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """file, record_number, raw, cells of CSV files with their raw text kept; each file is read by one task. Broken files raise."""

    def read(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                records = csv_records(bytes(content).decode("utf-8"))
                yield pd.DataFrame([(file, n, raw, cells) for n, (raw, cells) in enumerate(records, 1)], columns=["file", "record_number", "raw", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, record_number long, raw string, cells array<string>")
