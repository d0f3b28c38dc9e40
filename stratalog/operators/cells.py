"""Rows of labelled cells, columnar arrays and JSON documents turned into long tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unpivot_cells(rows: DataFrame, keys: Sequence[str], header: str, cells: str, mapping: DataFrame | None = None, label: str = "label") -> DataFrame:
    """keys, label, value of every cell that is not empty; with a mapping (label, further columns) only mapped labels, with its columns.

    Rows whose width differs from their header, and null headers or cells, are told by unpivot_rejects instead. Labels that stand twice in a header give two rows.
    """
    zipped = F.arrays_zip(F.col(header).alias("label"), F.col(cells).alias("value"))
    long = rows.where(F.size(header) == F.size(cells)).select(*keys, F.explode(zipped).alias("__c")).select(*keys, F.col("__c.label").alias(label), F.col("__c.value").alias("value"))
    long = long.where("value <> ''")
    return long if mapping is None else long.join(mapping, label)


def unpivot_rejects(rows: DataFrame, keys: Sequence[str], header: str, cells: str) -> DataFrame:
    """keys, reason of the rows that unpivot_cells cannot read: NO_HEADER, NO_CELLS or WIDTH."""
    reason = F.when(F.col(header).isNull(), "NO_HEADER").when(F.col(cells).isNull(), "NO_CELLS").when(F.size(header) != F.size(cells), "WIDTH")
    return rows.select(*keys, reason.alias("reason")).where("reason is not null")


def array_rejects(df: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """keys, reason of the rows that arrays_to_rows cannot read: NO_ARRAY (one is null) or UNEQUAL_LENGTHS."""
    missing, first = F.lit(False), F.size(arrays[0])
    differ = F.lit(False)
    for c in arrays:
        missing, differ = missing | F.col(c).isNull(), differ | (F.size(c) != first)
    return df.select(*keys, F.when(missing, "NO_ARRAY").when(differ, "UNEQUAL_LENGTHS").alias("reason")).where("reason is not null")


def json_rejects(df: DataFrame, keys: Sequence[str], document: str) -> DataFrame:
    """keys, reason of the documents that flatten_json cannot read: NO_TEXT or MALFORMED."""
    reason = F.when(F.col(document).isNull(), "NO_TEXT").when(F.try_parse_json(document).isNull(), "MALFORMED")
    return df.select(*keys, reason.alias("reason")).where("reason is not null")


def arrays_to_rows(df: DataFrame, keys: Sequence[str], arrays: Sequence[str], position: str = "pos") -> DataFrame:
    """One row per position of parallel arrays; rows whose arrays differ in length (or are null) are told by array_rejects instead."""
    first = F.size(arrays[0])
    same = first >= 0
    for c in arrays[1:]:
        same = same & (F.size(c) == first)
    zipped = df.where(same).select(*keys, F.posexplode(F.arrays_zip(*[F.col(c) for c in arrays])).alias(position, "__r"))
    return zipped.select(*keys, position, *[F.col(f"__r.{c}").alias(c) for c in arrays])


class _Number(str):
    """A number as it is spelt in a document."""


def flatten(document) -> list[tuple[str, str, int | None, str, str | None]]:
    """(path, container, index, type, text) of every node of a parsed JSON document; scalars only have text."""
    out: list[tuple[str, str, int | None, str, str | None]] = []
    stack: list[tuple[str, str, int | None, object]] = [("$", "", None, document)]
    while stack:
        path, container, index, node = stack.pop()
        if isinstance(node, dict):
            out.append((path, container, index, "object", None))
            stack += [(f"{path}.{json.dumps(k, ensure_ascii=False)}", path, None, v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            out.append((path, container, index, "array", None))
            stack += [(f"{path}[{i}]", path, i, v) for i, v in reversed(list(enumerate(node)))]
        else:
            kind = "null" if node is None else "boolean" if isinstance(node, bool) else "number" if isinstance(node, (_Number, int, float)) else "string"
            out.append((path, container, index, kind, None if node is None else json.dumps(node) if kind == "boolean" else str(node)))
    return out


_NODE = T.StructType([T.StructField(n, T.IntegerType() if n == "index" else T.StringType()) for n in ("path", "container", "index", "type", "text")])


@F.pandas_udf(T.ArrayType(_NODE))
def _flat(text: pd.Series) -> pd.Series:
    def one(x):
        try:
            nodes = flatten(json.loads(x, parse_float=_Number, parse_int=_Number, parse_constant=_Number))
        except (TypeError, ValueError):
            return None
        return [dict(zip(("path", "container", "index", "type", "text"), n)) for n in nodes]

    return pd.Series([one(x) for x in text], dtype=object)


def flatten_json(df: DataFrame, keys: Sequence[str], document: str) -> DataFrame:
    """keys, path, container, index, type, text of all nodes; null and malformed documents are told by json_rejects instead. Numbers keep their spelling.

    In Python, in Arrow batches: a variant keeps a number's value only, and is taken apart one level at a time.
    """
    return df.select(*keys, F.inline(_flat(F.col(document))))
