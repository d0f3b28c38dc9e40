"""Tables, facts and contexts of inline-XBRL filings, read in one pass over the document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: The named entities that filings use; others stay as they are written.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
#: Labels of schedule columns; a footnote number in brackets may follow.
PORTFOLIO_LABEL, TYPE_LABEL, VALUE_LABEL = "Portfolio Company, Location and Industry", "Type of Investment", "Fair Value"
MATURITY_LABELS = ("Maturity", "Maturity/Expiration Date")
_ISO = re.compile(r"\d{4}-\d{2}-\d{2}")


def shown_dates(text: str) -> tuple[list[str], list[str]]:
    """The days (M/D/YYYY) and the months (M/YYYY) that a text shows: runs of digits and slashes that are one of them as a whole, but for slashes around."""
    runs = [run.strip("/").split("/") for run in re.findall("[0-9/]+", text)]
    short = lambda part: 1 <= len(part) <= 2
    dated = [run for run in runs if len(run) in (2, 3) and len(run[-1]) == 4 and all(map(short, run[:-1]))]
    return ["/".join(run) for run in dated if len(run) == 3], ["/".join(run) for run in dated if len(run) == 2]


@dataclass
class Fact:
    id: str | None
    name: str | None
    context: str | None
    scale: str | None
    sign: str | None
    format: str | None
    text: str = ""


@dataclass
class Cell:
    slot: int
    colspan: int
    rowspan: int
    column: int
    text: str = ""
    spaced: str = ""
    untagged: str = ""
    facts: list[Fact] = field(default_factory=list)


@dataclass
class Row:
    ordinal: int
    table: int | None
    cells: list[Cell] = field(default_factory=list)
    refused: str | None = None
    untagged: str = ""

    @property
    def width(self) -> int:
        return sum(c.colspan for c in self.cells)

    def text_at(self, slot: int) -> str:
        return next((c.text for c in self.cells if c.slot <= slot < c.slot + c.colspan), "")

    @property
    def facts(self) -> list[Fact]:
        return [f for c in self.cells for f in c.facts]


@dataclass
class Context:
    id: str
    domain: str | None = None
    period_end: str | None = None
    repeated: bool = False


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.rows: list[Row] = []
        self.contexts: dict[str, Context] = {}
        self._tables: list[int] = []
        self._n_tables = 0
        self._row: Row | None = None
        self._cell: Cell | None = None
        self._facts: list[Fact] = []
        self._context: Context | None = None
        self._typed = False
        self._part: str | None = None
        self._busy: dict[int, dict[int, set[int]]] = {}
        self._line = 0

    # Structure
    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            if self._row is not None:
                self._row.refused = self._row.refused or "nested table"
            self._tables.append(self._n_tables)
            self._n_tables += 1
            self._line = 0
        elif tag == "tr" and not (self._row is not None and self._row.refused):
            self._row = Row(len(self.rows) + 1, self._tables[-1] if self._tables else None)
            self.rows.append(self._row)
            self._cell = None
        elif tag in ("td", "th") and self._row is not None and not self._row.refused:
            if self._cell is not None:
                self._row.refused = "unclosed cell"
            else:
                self._open_cell(a)
        elif tag == "br" and self._cell is not None:
            self._cell.spaced += " "
        elif tag in ("ix:nonfraction", "ix:nonnumeric"):
            self._facts.append(Fact(a.get("id"), a.get("name"), a.get("contextref"), a.get("scale"), a.get("sign"), a.get("format")))
            if self._cell is not None:
                self._cell.facts.append(self._facts[-1])
        elif tag == "xbrli:context" and a.get("id"):
            known = self.contexts.get(a["id"])
            if known:
                known.repeated = True
            self._context = Context(a["id"])
            self.contexts.setdefault(a["id"], self._context)
        elif self._context is not None:
            if tag == "xbrldi:typedmember":
                self._typed = a.get("dimension") == "us-gaap:InvestmentIdentifierAxis"
            elif self._typed and tag.endswith("investmentidentifieraxis.domain"):
                self._part, self._context.domain = "domain", ""
            elif tag in ("xbrli:instant", "xbrli:enddate"):
                self._part = "instant" if tag.endswith("instant") else "end"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in ("br",):
            self.handle_endtag(tag)

    def _open_cell(self, a):
        span = lambda name: max(1, int(a[name])) if (a.get(name) or "").isdecimal() else 1
        row = self._row
        busy = self._busy.setdefault(row.table if row.table is not None else -1, {})
        taken = busy.setdefault(self._line, set())
        column = row.cells[-1].column + row.cells[-1].colspan if row.cells else 0
        while column in taken:
            column += 1
        self._cell = Cell(row.width, span("colspan"), span("rowspan"), column)
        for later in range(1, self._cell.rowspan):
            busy.setdefault(self._line + later, set()).update(range(column, column + self._cell.colspan))
        row.cells.append(self._cell)

    def handle_endtag(self, tag):
        if tag == "table" and self._tables:
            self._tables.pop()
        elif tag == "tr" and self._row is not None:
            if self._cell is not None:
                self._row.refused = self._row.refused or "unclosed cell"
            self._row, self._cell = None, None
            self._line += 1
        elif tag in ("td", "th"):
            self._cell = None
        elif tag in ("ix:nonfraction", "ix:nonnumeric") and self._facts:
            self._facts.pop()
        elif tag == "xbrli:context":
            self._context, self._typed, self._part = None, False, None
        elif tag == "xbrldi:typedmember":
            self._typed = False
        elif self._part and tag.startswith(("xbrli:", "us-gaap:")):
            self._part = None

    # Text
    def handle_data(self, data):
        if self._context is not None and self._part:
            if self._part == "domain":
                self._context.domain += data if data.strip() else ""
            elif self._context.period_end is None or self._part == "instant":
                self._context.period_end = data.strip() if _ISO.fullmatch(data.strip()) else None
            return
        for fact in self._facts:
            fact.text += data
        if self._row is not None and not self._facts:
            self._row.untagged += data
        if self._cell is not None:
            if data.strip():
                self._cell.text += data
                self._cell.spaced += data
            if not self._facts:
                self._cell.untagged += data

    def handle_entityref(self, name):
        self.handle_data(ENTITIES.get(name, f"&{name};"))

    def handle_charref(self, name):
        code = int(name[1:], 16) if name[:1] in "xX" else int(name)
        self.handle_data(chr(code) if code < 0x110000 else f"&#{name};")


def read_document(html: str) -> tuple[list[Row], dict[str, Context]]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    squeeze = lambda s: re.sub(r"\s+", " ", s).strip()
    for row in reader.rows:
        row.untagged = squeeze(row.untagged)
        for cell in row.cells:
            cell.spaced, cell.untagged = squeeze(cell.spaced), squeeze(cell.untagged)
            for fact in cell.facts:
                fact.text = squeeze(fact.text)
    for context in reader.contexts.values():
        if context.repeated:
            context.period_end = None
    return reader.rows, reader.contexts


# Schedule blocks ----------------------------------------------------------------------------------------------------


@dataclass
class _Columns:
    ordinal: int
    width: int
    portfolio: int
    type: int
    label: str


def _columns(row: Row) -> _Columns | None:
    """The columns of a schedule's header row; None if the row is none."""
    if row.refused:
        return None
    found = {}
    for cell in row.cells:
        bare = re.sub(r" ?\(\d+\)$", "", cell.spaced)
        if bare in (PORTFOLIO_LABEL, TYPE_LABEL, VALUE_LABEL):
            found.setdefault(bare, cell)
    if len(found) < 3:
        return None
    return _Columns(row.ordinal, row.width, found[PORTFOLIO_LABEL].slot, found[TYPE_LABEL].slot, found[PORTFOLIO_LABEL].spaced)


def _stretches(rows: list[Row]) -> Iterator[tuple[_Columns, Row, list[Row], Row | None]]:
    """Under each header: every row that names something without a type, the rows that belong to it, and the row that broke it off, if refused."""
    columns: _Columns | None = None
    start: Row | None = None
    body: list[Row] = []
    for row in [*rows, None]:
        header = _columns(row) if row is not None else None
        same = row is not None and not header and columns is not None and not row.refused and row.width == columns.width
        begins = same and row.text_at(columns.portfolio) != "" and row.text_at(columns.type) == ""
        if start is not None and (not same or begins):
            yield columns, start, body, row if row is not None and row.refused else None
            start, body = None, []
        if header:
            columns = header
        elif begins:
            start = row
        elif same and start is not None:
            body.append(row)


def schedule_blocks(html: str) -> tuple[list[dict], list[dict], list[dict]]:
    """(blocks, refusals, excluded rows) of the schedules in a filing.

    A company row has its name in the portfolio column and nothing else; its block runs to the next row that names something
    without a type, the next header, or a row of another width. A name without any typed row after it is a section label; a
    filled naming row right after a block is a section boundary. A block that meets a row which cannot be read is refused.
    """
    rows, contexts = read_document(html)
    blocks, refusals, excluded = [], [], []
    after_block = False
    for columns, start, body, broken in _stretches(rows):
        name = start.text_at(columns.portfolio)
        filled = [c for c in start.cells if c.text != ""]
        if len(filled) != 1 or filled[0].slot != columns.portfolio or filled[0].spaced == columns.label:
            if after_block:
                excluded.append({"row": start.ordinal, "kind": "SECTION_BOUNDARY", "text": name})
            after_block = after_block and not body
            continue
        after_block = False
        if broken is not None:
            refusals.append({"start": start.ordinal, "row": broken.ordinal, "reason": broken.refused})
        elif not any(r.text_at(columns.type) for r in body):
            excluded.append({"row": start.ordinal, "kind": "SECTION_LABEL", "text": name})
        else:
            after_block = True
            lines = [_described(r, columns, contexts) for r in body]
            first = {"row": start.ordinal, "kind": "COMPANY", "portfolio": name, "lines": []}
            blocks.append({"header": columns.ordinal, "start": start.ordinal, "end": body[-1].ordinal, "company": name, "rows": [first, *lines]})
    return blocks, refusals, excluded


def _described(row: Row, columns: _Columns, contexts: dict[str, Context]) -> dict:
    domains = {f.context: contexts[f.context].domain for f in row.facts if f.context in contexts and contexts[f.context].domain}
    portfolio, kind = row.text_at(columns.portfolio), "OTHER"
    if domains:
        kind = "INVESTMENT_LINE_WITH_IDENTIFIER"
    elif row.text_at(columns.type):
        kind = "INVESTMENT_LINE_WITHOUT_IDENTIFIER"
    elif row.facts and not portfolio:
        kind = "TOTAL_OR_SUBTOTAL"
    return {"row": row.ordinal, "kind": kind, "portfolio": portfolio, "lines": [{"context": c, "domain": d} for c, d in domains.items()]}


# Rows with facts ----------------------------------------------------------------------------------------------------


def context_rows(html: str) -> list[dict]:
    """Every table row with facts: its contexts and their period ends, facts, dates outside facts, and the table's maturity column (None unless there is exactly one)."""
    rows, contexts = read_document(html)
    columns: dict[int, set[int]] = {}
    for row in rows:
        for cell in row.cells:
            if row.table is not None and cell.untagged in MATURITY_LABELS:
                columns.setdefault(row.table, set()).add(cell.column)
    out = []
    for row in rows:
        facts = [f for f in row.facts if f.id and f.context]
        if not facts:
            continue
        ids = list(dict.fromkeys(f.context for f in facts))
        only = columns.get(row.table, set())
        out.append(
            {
                "row": row.ordinal, "table": row.table, "contexts": ids, "period_ends": [contexts[i].period_end if i in contexts else None for i in ids], "facts": [vars(f) for f in facts],
                **dict(zip(("dates", "months"), shown_dates(row.untagged))), "maturity_column": next(iter(only)) if len(only) == 1 else None,
            }
        )
    return out


_FACTS = "row int, table int, context string, period_end string, fact_id string, name string, text string, scale string, sign string, format string"


def document_facts(documents: DataFrame, key: str, html: str) -> DataFrame:
    """key and one row per fact inside a table row. Null documents have none. Each document is read by itself, in Arrow batches."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[html]):
                for row in context_rows(text) if text is not None else []:
                    ends = dict(zip(row["contexts"], row["period_ends"]))
                    out += [(k, row["row"], row["table"], f["context"], ends[f["context"]], f["id"], f["name"], f["text"], f["scale"], f["sign"], f["format"]) for f in row["facts"]]
            yield pd.DataFrame(out, columns=[key, *[c.split()[0] for c in _FACTS.split(", ")]])

    return documents.select(key, html).mapInPandas(run, f"{key} {kind}, {_FACTS}")


def document_blocks(documents: DataFrame, key: str, html: str) -> DataFrame:
    """key, company, start, row, kind, context, domain of every row of every schedule block (one row per identifier on it)."""
    kind = documents.schema[key].dataType.simpleString()
    names = ["company", "start", "row", "kind", "context", "domain"]

    def run(batches):
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[html]):
                for block in schedule_blocks(text)[0] if text is not None else []:
                    for row in block["rows"]:
                        for line in row["lines"] or [{"context": None, "domain": None}]:
                            out.append((k, block["company"], block["start"], row["row"], row["kind"], line["context"], line["domain"]))
            yield pd.DataFrame(out, columns=[key, *names])

    return documents.select(key, html).mapInPandas(run, f"{key} {kind}, company string, start int, row int, kind string, context string, domain string")
