"""Visually identical text with different characters, brought to one form by DuckDB inside Arrow partitions."""

from __future__ import annotations

import bisect
import secrets
import sys
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.operators.joins import guarded_join
from stratalog.session import BROADCAST_ROWS, cut

#: Letters of the Cyrillic, Greek, Armenian, Cherokee, Lisu and Coptic alphabets that are drawn like a Latin letter, and that letter; as the
#: Unicode confusables list them, less those that common typefaces draw apart.
SAME_SHAPE = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "Т": "T", "У": "Y", "Х": "X", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ӏ": "I",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "Ս": "U", "զ": "q", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "ց": "g", "օ": "o",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X",
}
#: Characters without a shape of their own that are no format controls (category Cf), as ranges, and the format controls that have one.
INVISIBLE = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0xFE00, 0xFE0F), (0xE0000, 0xE0FFF))
VISIBLE_CONTROLS = ((0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F))
#: Hyphens that look like the hyphen-minus, and a symbol that looks like a blank.
HYPHENS, BLANK = "‐‑﹣－", "\u2800"


@cache
def invisible() -> tuple[tuple[int, int], ...]:
    """Ranges of all characters that cannot be seen: those above, and those that are no more than another writing of one (such as the Hangul fillers)."""
    among = lambda code, ranges: any(a <= code <= b for a, b in ranges)
    unseen = lambda code: among(code, INVISIBLE) or unicodedata.category(chr(code)) == "Cf" and not among(code, VISIBLE_CONTROLS)
    codes = [c for c in range(0x80, sys.maxunicode + 1) if unseen(c) or all(unseen(ord(x)) for x in unicodedata.normalize("NFKC", chr(c)))]
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return tuple((a, b) for a, b in ranges)


def _unseen(code: int) -> bool:
    ranges = invisible()
    at = bisect.bisect_right(ranges, (code, sys.maxunicode + 1)) - 1
    return at >= 0 and ranges[at][0] <= code <= ranges[at][1]


@cache
def mappings() -> tuple[dict[str, str], dict[str, str]]:
    """Character to character, and character to several (ligatures and the like), by rule from the Unicode data.

    Blanks are those of category Zs and the tab and line controls. Wide, narrow and letter-only compatibility forms map to their
    decomposition; a letter whose base letter has a Latin twin maps to the twin with the same accents.
    """
    single, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs") or _unseen(code):
            continue
        if kind == "Zs" or kind in ("Zl", "Zp") or code == 0x85:
            single[ch] = " "
            continue
        tag, _, rest = unicodedata.decomposition(ch).rpartition(">")
        form = ch
        if tag in ("<wide", "<narrow"):
            form = unicodedata.normalize("NFKC", ch)
        elif tag == "<compat" and all(unicodedata.category(chr(int(x, 16)))[0] == "L" for x in rest.split()):
            form = unicodedata.normalize("NFKC", ch)
        form = unicodedata.normalize("NFC", "".join(SAME_SHAPE.get(x, x) for x in unicodedata.normalize("NFD", form))) if len(form) == 1 and kind[0] == "L" else form
        if form != ch and form != unicodedata.normalize("NFC", ch):
            (single if len(form) == 1 else several)[ch] = form
    single |= {ch: "-" for ch in HYPHENS} | {ch: " " for ch in BLANK + "\t\n\v\f\r"}
    return single, several


def visible_form(text: str) -> str:
    """The form of one text, in plain Python: for tests and for code that runs in Python anyway."""
    single, several = mappings()
    text = "".join(x for x in text if ord(x) < 0x80 or not _unseen(ord(x)))
    text = "".join(several.get(x) or single.get(x, x) for x in text)
    return unicodedata.normalize("NFC", text).strip(" ")


@cache
def form_sql(column: str = "raw") -> str:
    """The DuckDB expression of a text's form."""
    single, several = mappings()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    points = lambda a, b: f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "")
    text = f"regexp_replace({column}, '[{''.join(points(*r) for r in invisible())}]', '', 'g')"
    chain = text
    for ch, form in several.items():
        chain = f"replace({chain}, {quoted(ch)}, {quoted(form)})"
    some = "[" + "".join(points(ord(ch), ord(ch)) for ch in several) + "]"
    text = f"CASE WHEN regexp_matches({column}, '{some}') THEN {chain} ELSE {text} END"
    blanks = {ch for ch in single if ch < "\x20"}
    source = "".join(ch for ch in single if ch not in blanks)
    text = f"translate({text}, {quoted(source)}, {quoted(''.join(single[ch] for ch in source))})"
    text = f"trim(regexp_replace(nfc_normalize({text}), '[\\t\\n\\v\\f\\r]', ' ', 'g'), ' ')"
    plain = f"trim(regexp_replace({column}, '[\\t\\n\\v\\f\\r]', ' ', 'g'), ' ')"
    return f"CASE WHEN regexp_matches({column}, '[^\\x00-\\x7F]') THEN {text} ELSE {plain} END"


def _mapped(df: DataFrame, text: str, made: dict[str, str], types: dict[str, T.DataType], kept: list[str]) -> DataFrame:
    """The kept columns of df and made ones (name: DuckDB expression on the column `text`), computed by DuckDB on each Arrow batch of a partition."""
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, types[n]) for n in made]])
    chosen = ", ".join(f'{e} AS "{n}"' for n, e in made.items())
    arrow = {n: pa.binary() if isinstance(types[n], T.BinaryType) else pa.string() for n in made}

    def run(batches):
        import duckdb

        db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "256MB"})
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                db.register("batch", pa.table({text: batch.column(batch.schema.get_field_index(text)).cast(pa.string())}))
                told = db.sql(f"SELECT {chosen} FROM batch").to_arrow_table().combine_chunks()
                db.unregister("batch")
                columns = [told.column(n).chunk(0).cast(arrow[n]) for n in made]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *columns], names=[*kept, *made])
        finally:
            db.close()

    return df.mapInArrow(run, schema)


def with_form(df: DataFrame, text: str = "raw", form: str = "form") -> DataFrame:
    """df and the visible form of a text column (null for null), computed by DuckDB on each Arrow batch of a partition."""
    return _mapped(df, text, {form: form_sql(f'"{text}"')}, {form: T.StringType()}, df.columns)


def lookalike_pairs(rows: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """record_kind, id_a, id_b (the smaller first) of rows in one scope whose texts look the same but differ in code points.

    rows: record_kind string, scope (any type; null is compared with nothing), id int64, raw string (null is ignored; blank
    texts look alike). Rows are read once: DuckDB gives each its form where it lies, and from there on only 128-bit digests of text and form
    move (made with a prefix drawn anew for each call, so that no texts can be made to collide). A class, that is a form in one scope, has two texts only
    if a text differs from its form, so the classes of those are enough. Copies of one text make no pairs: pairs
    are made between the texts of a class, and only these are expanded to their rows, with hot texts split. No step
    enumerates the pairs of equal copies, however many rows hold one text.
    """
    keys = ["record_kind", "scope"]
    rows = rows.where("raw is not null and scope is not null").select(*keys, "id", "raw")
    digest, form, prefix = T.BinaryType(), form_sql('"raw"'), secrets.token_hex(8)
    of = lambda x: f"unhex(md5('{prefix}' || {x}))"
    made = {"text": of('"raw"'), "look": f"(SELECT CASE WHEN f <> \"raw\" THEN {of('f')} END FROM (SELECT {form} AS f))"}
    looks = cut(_mapped(rows, "raw", made, {"text": digest, "look": digest}, [*keys, "id"]), "looks")
    look = F.coalesce("look", "text").alias("look")
    classes = looks.where("look is not null").select(*keys, "look").distinct()
    live = cut(guarded_join(looks.select(*keys, "id", "text", look), cut(classes, "classes"), [*keys, "look"], "left_semi", broadcast_rows), "live")
    texts = cut(live.select(*keys, "look", "text").distinct(), "texts")
    differing = F.col("text_a") < F.col("text_b")
    pairs = guarded_join(texts.withColumnRenamed("text", "text_a"), texts.withColumnRenamed("text", "text_b"), [*keys, "look"], "inner", broadcast_rows, differing)
    left = guarded_join(live.select(*keys, F.col("text").alias("text_a"), F.col("id").alias("x")), pairs.select(*keys, "text_a", "text_b"), [*keys, "text_a"], "inner", broadcast_rows)
    both = guarded_join(live.select(*keys, F.col("text").alias("text_b"), F.col("id").alias("y")), left.select(*keys, "text_b", "x"), [*keys, "text_b"], "inner", broadcast_rows)
    return both.where("x <> y").select("record_kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
