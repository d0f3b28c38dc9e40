"""Cells of delimited lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Delimiters split inside the JVM without a regular expression per row.
_PLAIN = ("\t", ",", ";", "|")


def split_quoted(line: str, delimiter: str) -> list[str] | None:
    """Cells of one line; None if a quoted cell never ends or is followed by anything but the delimiter or the end.

    A cell is quoted if it begins with a quotation mark; inside, a doubled one stands for one. Elsewhere the mark is ordinary.
    """
    cells, i, n, step = [], 0, len(line), len(delimiter)
    while True:
        if line.startswith('"', i):
            j = i + 1
            while True:
                k = line.find('"', j)
                if k < 0:
                    return None
                if not line.startswith('"', k + 1):
                    break
                j = k + 2
            cells.append(line[i + 1 : k].replace('""', '"'))
            i = k + 1
            if i == n:
                return cells
            if not line.startswith(delimiter, i):
                return None
            i += step
        else:
            k = line.find(delimiter, i)
            if k < 0:
                cells.append(line[i:])
                return cells
            cells.append(line[i:k])
            i = k + step


@F.pandas_udf(T.ArrayType(T.StringType()))
def _quoted_cells(line: pd.Series, delimiter: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else split_quoted(x, d) for x, d in zip(line, delimiter)], dtype=object)


def line_cells(line: Column, delimiter: Column) -> Column:
    """Cells of each line, null where the quoting is broken or the line is null.

    Only lines that hold a quotation mark go to Python (in Arrow batches); all others are split in the JVM.
    """
    quoted = line.contains('"')
    split = F.lit(None).cast("array<string>")
    for d in _PLAIN:
        split = F.when(delimiter == d, F.split(line, "\\" + d if d == "|" else d, -1)).otherwise(split)
    other = F.split(line, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")), F.lit(-1))
    return F.when(quoted, _quoted_cells(F.when(quoted, line), delimiter)).otherwise(F.coalesce(split, other))


def cell(cells: Column, header: Column, label: str) -> Column:
    """The cell under a label; null if the header has no such label or the row is too short."""
    at = F.array_position(header, F.lit(label)).cast("int")
    return F.when(at > 0, F.get(cells, at - 1))
