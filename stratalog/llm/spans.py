"""Long exact spans shared between records: content-defined chunking with a gear rolling hash."""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.joins import guarded_join
from stratalog.session import at_most, cut

#: Characters that the gear hash sees: two bits of its 32 leave with each character.
GEAR = 16
#: Every so many consecutive positions hold a cut: the one with the least gear hash.
WINDOW = 48
#: Code points hashed at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 20
#: Fingerprints (single longs) that are broadcast after a count; beyond that they are joined by shuffle.
BROADCAST_PRINTS = 2_000_000
_DIGEST = ["d0", "d1"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def digests(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """96-bit digests, as a long and an int, of the substrings [start, end) of one text; equal for equal strings wherever they stand."""
    text, digest = memoryview(np.ascontiguousarray(points)).cast("B"), xxhash.xxh3_128_digest
    made = b"".join([digest(text[a:b], seed) for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())])
    both = np.frombuffer(made, np.dtype([("d0", ">i8"), ("d1", ">i4"), ("rest", ">i4")]))
    return both["d0"].astype(np.int64), both["d1"].astype(np.int32)


def gear(points: np.ndarray) -> np.ndarray:
    """The gear hash of the GEAR characters from each position on (the last GEAR - 1 positions have none)."""
    x = points.astype(np.uint32) + np.uint32(1)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x9E3779B1)
    h, m = (x ^ (x >> np.uint32(13))) * np.uint32(0x85EBCA77), 1
    while m < GEAR:
        h, m = (h[:-m] << np.uint32(2 * m)) + h[m:], 2 * m
    return h


def least(h: np.ndarray, window: int) -> np.ndarray:
    """The position of the least hash among each `window` consecutive positions, the last of equal ones."""
    low = np.uint64(0xFFFFFFFF)
    keyed = (h.astype(np.uint64) << np.uint64(32)) | (low - np.arange(len(h), dtype=np.uint64))
    n = 1
    while 2 * n <= window:
        keyed, n = np.minimum(keyed[:-n], keyed[n:]), 2 * n
    if n < window:
        keyed = np.minimum(keyed[: len(keyed) - (window - n)], keyed[window - n :])
    return (low - (keyed & low)).astype(np.int64)


def chunks(points: np.ndarray, span: int, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """start, end, near and far of the chunks of a text.

    A chunk begins at a cut (the least gear hash of some `window` consecutive positions) and ends at the least gear hash
    of a later window, so both ends depend on nothing but the text between them and a few characters beyond; insertions
    elsewhere move nothing. Chunks overlap, and every stretch of `span` characters owns one whole chunk inside it, that at
    the cut of its first window: equal stretches own equal chunks at equal places. The stretches that begin near to far
    characters before a chunk's start own it (none, if near > far).
    """
    reach = span - 2 * window - GEAR
    if reach < window:
        raise ValueError(f"spans must have at least {3 * window + GEAR} characters")
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    last_stretch = len(points) - span
    for at in range(0, len(points), PIECE):
        before = min(at, window)
        piece = points[at - before : at + PIECE + span]
        if len(piece) < span:
            continue
        cut_of = least(gear(piece), window)
        first = np.flatnonzero(np.concatenate([[True], cut_of[1:] != cut_of[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(cut_of) - 1]])
        start = cut_of[first]
        kept = (start + reach < len(cut_of)) & (start >= before) & (start < before + PIECE)
        start, first, last = start[kept], first[kept], np.minimum(last[kept], last_stretch - (at - before))
        end = cut_of[start + reach]
        for part, x in zip(parts, (start + (at - before), end + (at - before), start - last, start - first)):
            part.append(x)
    return tuple(np.concatenate(part) for part in parts)


def _rows_with(texts: list[str | None], span: int) -> list[tuple[int, str]]:
    return [(i, x) for i, x in enumerate(texts) if x is not None and len(x) >= span]


_CHUNK = "d0 long, d1 int, doc long, start int, length int, near short, far short"


def chunk_table(docs: DataFrame, span: int, seed: int) -> DataFrame:
    """Digest (d0, d1), doc, start, length, near, far of all chunks; docs has doc and text. Texts shorter than span have none."""

    def run(batches):
        for batch in batches:
            made = []
            for i, text in _rows_with(batch.column(1).to_pylist(), span):
                points = code_points(text)
                start, end, near, far = chunks(points, span)
                made.append((i, start, end, near, far, *digests(points, start, end, seed)))
            if not made:
                continue
            which = np.repeat([x[0] for x in made], [len(x[1]) for x in made])
            start, end, near, far, d0, d1 = (np.concatenate([x[k] for x in made]) for k in range(1, 7))
            numbers = start.astype(np.int32), (end - start).astype(np.int32), np.minimum(near, WINDOW + 1).astype(np.int16), far.astype(np.int16)
            columns = [pa.array(d0), pa.array(d1), batch.column(0).take(pa.array(which)), *map(pa.array, numbers)]
            yield pa.RecordBatch.from_arrays(columns, names=["d0", "d1", "doc", "start", "length", "near", "far"])

    return docs.mapInArrow(run, _CHUNK)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals [start, end), as disjoint ones in order."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool)
    last = np.concatenate([first[1:], [True]]) if len(s) else first
    return s[first], e[last]


def proved_spans(start: np.ndarray, end: np.ndarray, partner: np.ndarray, shift: np.ndarray, span: int) -> list[tuple[int, int]]:
    """The spans that one document's shared chunks prove, none inside another, in order.

    Chunks that overlap and lie equally shifted in one partner prove that their union stands there in one piece.
    """
    order = np.lexsort((start, shift, partner))
    s, e, p, d = start[order].tolist(), end[order].tolist(), partner[order].tolist(), shift[order].tolist()
    proved, i = [], 0
    while i < len(s):
        j, reach = i + 1, e[i]
        while j < len(s) and p[j] == p[i] and d[j] == d[i] and s[j] <= reach:
            reach = max(reach, e[j])
            j += 1
        if reach - s[i] >= span:
            proved.append((s[i], -reach))
        i = j
    kept: list[tuple[int, int]] = []
    for a, b in sorted(proved):
        if not kept or -b > kept[-1][1]:
            kept.append((a, -b))
    return kept


def open_part(low: int, high: int, proved: list[tuple[int, int]], span: int) -> tuple[int, int] | None:
    """The stretches beginning at low to high, less those at either end that lie in a proved span; None if none is left."""
    for a, b in proved:
        if a <= low <= b - span:
            low = b - span + 1
    for a, b in reversed(proved):
        if a <= high <= b - span:
            high = a - 1
    return (low, high) if low <= high else None


_SETTLED = "doc long, sure array<struct<s:int,e:int>>, hits array<struct<d0:long,d1:int,start:int,near:short,far:short,low:short,high:short>>"


def _settled(hits: DataFrame, span: int) -> DataFrame:
    """Per document the proved spans and its hits, with the distances (low to high) at which stretches that own it are open."""
    listed = hits.groupBy("doc").agg(F.collect_list(F.struct("d0", "d1", "start", "length", "partner", "shift", "near", "far")).alias("hits"))
    spans_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            offsets, flat = lists.offsets.to_numpy(), lists.values
            d0, d1, start, length, partner, shift, near, far = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(8))
            end = start + length
            low, high, missing = np.zeros(len(start), np.int16), np.zeros(len(start), np.int16), np.ones(len(start), bool)
            sure = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                proved = proved_spans(start[a:b], end[a:b], partner[a:b], shift[a:b], span)
                sure.append([{"s": x, "e": y} for x, y in proved])
                for k in range(a, b):
                    at = int(start[k])
                    left = open_part(at - int(far[k]), at - int(near[k]), proved, span)
                    if left:
                        low[k], high[k], missing[k] = at - left[1], at - left[0], False
            fields = [pa.array(d0), pa.array(d1.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(near.astype(np.int16)), pa.array(far.astype(np.int16)), pa.array(low, mask=missing), pa.array(high, mask=missing)]
            told = pa.ListArray.from_arrays(lists.offsets, pa.StructArray.from_arrays(fields, ["d0", "d1", "start", "near", "far", "low", "high"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sure, spans_type), told], names=["doc", "sure", "hits"])

    return listed.mapInArrow(run, _SETTLED)


def _asked_ranges(settled: DataFrame, broadcast: int) -> DataFrame:
    """doc and the ranges [s, e) of beginnings whose stretches some document has open, in every document that holds their chunk."""
    hits = settled.select("doc", F.inline("hits"))
    asked = hits.where("low is not null").groupBy(*_DIGEST).agg(F.min("low").alias("from_"), F.max("high").alias("to_"))
    both = guarded_join(hits.select("doc", *_DIGEST, "start", "near", "far"), cut(asked, "asked_chunks"), _DIGEST, broadcast_rows=broadcast // 8)
    both = both.withColumn("s", F.col("start") - F.least("far", "to_")).withColumn("e", F.col("start") - F.greatest("near", "from_") + 1)
    return both.where("s < e").groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("open"))


def _open_prints(docs: DataFrame, span: int, seed: int) -> DataFrame:
    """Digest (d0, d1), doc, start of every stretch of span characters that begins in an open range; docs has doc, text, open."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            texts, ranges = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, (text, open_ranges) in enumerate(zip(texts, ranges)):
                points = code_points(text)
                s, e = np.array([(r["s"], r["e"]) for r in open_ranges]).T
                s, e = merged(s, np.minimum(np.maximum(s, e), len(points) - span + 1))
                for low, high in zip(s.tolist(), e.tolist()):
                    for at in range(low, high, PIECE):
                        starts = np.arange(at, min(at + PIECE, high))
                        d0, d1 = digests(points, starts, starts + span, seed)
                        yield pa.RecordBatch.from_arrays([pa.array(d0), pa.array(d1), ids.take(pa.array(np.full(len(starts), i))), pa.array(starts.astype(np.int32))], names=["d0", "d1", "doc", "start"])

    return docs.mapInArrow(run, "d0 long, d1 int, doc long, start int")


def _covered(spans: DataFrame) -> DataFrame:
    listed = spans.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            offsets, flat = lists.offsets.to_numpy(), lists.values
            s, e = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            sums = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                x, y = merged(s[a:b], e[a:b])
                sums.append(int((y - x).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], names=["doc", "shared_chars"])

    return listed.mapInArrow(run, "doc long, shared_chars long")


def _hits(rows: DataFrame, broadcast: int) -> DataFrame:
    """The chunks whose digest several documents hold, with its first and last document and the place in both.

    Half digests are combined map-side first, so that only few rows are compared by whole ones.
    """
    half = rows.groupBy("d0").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("d0")
    live = cut(guarded_join(rows, cut(half, "half"), ["d0"], "left_semi", broadcast), "live")
    several = live.groupBy(*_DIGEST).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min_by("start", "doc").alias("lo_start"), F.max_by("start", "doc").alias("hi_start"))
    return guarded_join(live, cut(several.where("lo < hi"), "several"), _DIGEST, broadcast_rows=broadcast // 8)


def _in_several(rows: DataFrame, broadcast: int) -> DataFrame:
    """The rows whose digest several documents hold. Rows meet by half digests; where those stand for several whole ones, by the whole."""
    half = rows.groupBy("d0").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), (F.min("d1") != F.max("d1")).alias("mixed")).where("lo < hi").select("d0", "mixed")
    half = cut(half, "half")
    sure = guarded_join(rows, half.where("not mixed").select("d0"), ["d0"], "left_semi", broadcast)
    if half.where("mixed").isEmpty():
        return sure
    unsure = cut(guarded_join(rows, half.where("mixed").select("d0"), ["d0"], "left_semi", broadcast), "unsure")
    whole = unsure.groupBy(*_DIGEST).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select(*_DIGEST)
    return sure.unionByName(guarded_join(unsure, whole, _DIGEST, "left_semi", broadcast // 8))


def shared_characters(documents: DataFrame, id_column: str, text: str, span: int = 300, broadcast: int = BROADCAST_PRINTS) -> DataFrame:
    """id and shared_chars of each record that shares a verbatim stretch of at least span characters with another one.

    A character counts if it lies in such a stretch; characters are code points, texts are compared whole and exactly.
    Null ids and null texts are ignored; texts shorter than span share nothing; rows with one id are one record, so a text
    repeated under its own id is not shared; records without shared characters are left out; no rows for an empty table.

    Chunks are deduplicated by digest: a digest that two records hold is a hit, kept with its first and last record. Runs of
    hits that lie equally shifted in one partner are shared spans at once. The stretches that they leave open, those around
    their ends, are decided by their own digests, which every record with the same chunk gives. Nothing is made per pair of
    records, so a passage that a third of all records hold costs as much as any other: digests are combined map-side, and joins back
    are broadcast up to `broadcast` longs after a count, or shuffled with the hot digests split. A record is processed by itself.

    Texts are taken for equal where their 96-bit digests are (of xxh3, under a seed drawn anew for each call, so that no text can be made
    to collide); n different stretches hold a false match with probability of about n * n / 2 ** 97, that is 6 in a million for 10 ** 12 of them.
    """
    seed = secrets.randbits(63)
    docs = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).where(f"doc is not null and length(text) >= {int(span)}")
    own = F.col("doc") == F.col("lo")
    hits = _hits(cut(chunk_table(docs, span, seed), "chunks"), broadcast).select(
        *_DIGEST, "doc", "start", "length", "near", "far", F.when(own, F.col("hi")).otherwise(F.col("lo")).alias("partner"), (F.when(own, F.col("hi_start")).otherwise(F.col("lo_start")) - F.col("start")).alias("shift")
    )
    settled = cut(_settled(hits, span), "settled")
    asked = cut(_asked_ranges(settled, broadcast), "asked")
    # One row per document on either side, so beyond the broadcast a plain join has no hot key.
    opened = docs.join(F.broadcast(asked) if at_most(asked, broadcast // 20) else asked, "doc")
    prints = cut(_open_prints(opened.select("doc", "text", "open"), span, seed), "prints")
    proved = _in_several(prints, broadcast).select("doc", F.col("start").alias("s"), (F.col("start") + span).alias("e"))
    sure = settled.select("doc", F.inline("sure"))
    return _covered(proved.unionByName(sure)).where("shared_chars > 0").select(F.col("doc").alias(id_column), "shared_chars")
