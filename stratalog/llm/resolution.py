"""Linking the spellings of one organisation by merging and rematching."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.names import BOTH_SHORT, BUSINESS, DIFFERENT, FIRST_SHORT, SAME, SECOND_SHORT, agreement, letter_forms, split_name, word_cost, word_forms, word_keys
from stratalog.operators.joins import guarded_join
from stratalog.session import cut


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component of edges (a, b). Labels double their reach each step."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        step = labels.union(near).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label", "left").select("node", F.coalesce(F.least("further", "label"), "label").alias("label"))
        step = cut(step, "labels")
        before = labels.select("node", F.col("label").alias("before"))
        if step.join(before, "node").where("label <> before").isEmpty():
            return step
        labels = step


#: Texts or pairs of spellings that one Python task takes; shuffled by number, as their bytes say little about their work.
TASK_TEXTS, TASK_PAIRS = 5_000, 50_000
#: Words whose forms, some thousands each at most, are in memory at once.
FORM_WORDS = 500
#: Spellings of one block that are compared pair by pair; in greater ones only those that are near by words or letters, which all that agree are.
BLOCK = 500
#: Different names that must end in a word for it to be learnt as a business word, as a number and as a share of all texts.
LEARNT_NAMES, LEARNT_SHARE = 6, 1e-4


def _spread(df: DataFrame, rows: int) -> DataFrame:
    return df.repartition(max(1, -(-df.count() // rows)))


def _arrow(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds.values())], names=list(kinds))


def _parsed(texts: DataFrame, learnt: frozenset[str] = frozenset()) -> DataFrame:
    kinds = {"text": pa.string(), "words": pa.list_(pa.string()), "cuts": pa.list_(pa.bool_()), "options": pa.list_(pa.string()), "series": pa.int64()}

    def run(batches):
        for batch in batches:
            rows = [(x, *split_name(x, learnt)) for x in batch.column(0).to_pylist()]
            rows = [r for r in rows if r[1]]
            if rows:
                yield _arrow(rows, kinds)

    return texts.mapInArrow(run, "text string, words array<string>, cuts array<boolean>, options array<string>, series long")


def _named(texts: DataFrame) -> DataFrame:
    """text, words, cuts, series and business: one business word ('' if none), of several possible ones the usual one in this table.

    Words that end many different names without a known business word are business words of this table, so the fixed list is only
    where the search begins. Both the counts of that list and the words learnt (at most 1 / LEARNT_SHARE) are small.
    """
    parsed = cut(_parsed(_spread(texts, TASK_TEXTS)), "parsed")
    counts = parsed.where("size(options) = 1").groupBy(F.col("options")[0].alias("word")).agg(F.count(F.lit(1)).alias("n"))
    usual = {r["word"]: r["n"] for r in counts.where(F.col("word").isin(*BUSINESS)).collect()}
    least = max(LEARNT_NAMES, int(parsed.count() * LEARNT_SHARE))
    plain = parsed.where("size(options) = 0 and size(words) > 1 and not element_at(cuts, -1)").select(F.element_at("words", -1).alias("word"), F.array_sort(F.slice("words", 1, F.size("words") - 1)).alias("rest"))
    ends = plain.groupBy("word").agg(F.count_distinct("rest").alias("n")).where((F.col("n") >= least) & (F.length("word") >= 3))
    learnt = frozenset(r["word"] for r in ends.collect())
    if learnt:
        again = F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted(learnt)])) & (F.size("options") == 0)
        parsed = parsed.where(~again).unionByName(_parsed(parsed.where(again).select("text"), learnt))
    n = lambda w: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in usual.items() for x in kv]), w), F.lit(0)) if usual else F.lit(0)
    best = F.array_max(F.transform("options", lambda w: F.struct(n(w).alias("n"), (-F.length(w)).alias("l"), w.alias("w"))))
    return parsed.select("text", "words", "cuts", "series", F.coalesce(best["w"], F.lit("")).alias("business"))


# Blocks: rows (sid, key, role). Role 0 meets every other row of its key; 1 asks (a short form) and meets every row; 2 is met by askers only.
_BLOCKS = "sid long, key string, role int"


def _first_blocks(spellings: DataFrame) -> DataFrame:
    kinds = {"sid": pa.int64(), "key": pa.string(), "role": pa.int32()}

    def run(batches):
        for batch in batches:
            rows = []
            for sid, words, cuts, business, series in zip(*(c.to_pylist() for c in batch.columns)):
                for key, _ in word_keys(words, cuts):
                    role = 0 if key[0] != "i" else 1 if all(cuts) else 2
                    rows.append((sid, f"{key}|{business}|{series}", role))
            if rows:
                yield _arrow(rows, kinds)

    return spellings.select("sid", "words", "cuts", "business", "series").mapInArrow(run, _BLOCKS)


def blocks_of(spellings: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """The blocks (sid, key, role) of at most `block` spellings, in which all pairs may be compared; and those of more, None if there are none."""
    rows = cut(_first_blocks(spellings), "blocks")
    sizes = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key"), "sizes")
    if sizes.isEmpty():
        return rows, None
    return cut(guarded_join(rows, sizes, ["key"], "left_anti"), "small"), cut(guarded_join(rows, sizes, ["key"], "left_semi"), "great")


def _forms_of(words: DataFrame, asking: bool) -> DataFrame:
    """wid, form (hashed) of words (wid, word, short), those that ask and those that are asked each under texts of their own."""
    # Roles 0, 1, 2 of the one side under the marks of those that they meet on the other.
    marks = {0: [""], 1: ["?"], 2: ["!"]} if asking else {0: [""], 1: ["?", "!"], 2: ["?"]}
    kinds = {"wid": pa.int64(), "forms": pa.list_(pa.string())}

    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for at in range(0, batch.num_rows, FORM_WORDS):
                rows = [(wid, [m + form for form, role in word_forms(word, short) for m in marks[role]]) for wid, word, short in zip(*(c[at : at + FORM_WORDS] for c in columns))]
                yield _arrow(rows, kinds)

    made = _spread(words, TASK_TEXTS).mapInArrow(run, "wid long, forms array<string>")
    return made.select("wid", F.explode("forms").alias("form")).select("wid", F.xxhash64("form").alias("form"))


def _near_words(asking: DataFrame, offered: DataFrame) -> DataFrame:
    """x, y: each word of asking with the words of offered (both wid, word, short) that can stand for it in spellings that agree."""

    def run(batches):
        for batch in batches:
            near = [word_cost(a, ca, b, cb)[0] < 9 or word_cost(b, cb, a, ca)[0] < 9 for a, ca, b, cb in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            chosen = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(near, pa.bool_()))
            if chosen.num_rows:
                yield chosen

    x, y = _forms_of(asking, True).withColumnRenamed("wid", "x"), _forms_of(offered, False).withColumnRenamed("wid", "y")
    met = x.join(y, "form").select("x", "y").distinct()
    texts = met.join(asking.toDF("x", "a", "ca"), "x").join(offered.toDF("y", "b", "cb"), "y")
    full = cut(texts.select("x", "y", "a", "ca", "b", "cb"), "words")
    return cut(_spread(full, TASK_PAIRS).mapInArrow(run, "x long, y long"), "near")


def _letters(sids: DataFrame, spellings: DataFrame) -> DataFrame:
    """sid, business, series, n (of words) and form of each of the spellings sids."""

    def run(batches):
        for batch in batches:
            rows = [(sid, business, series, len(words), list(letter_forms(words))) for sid, business, series, words in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield _arrow(rows, kinds)

    kinds = {"sid": pa.int64(), "business": pa.string(), "series": pa.int64(), "n": pa.int32(), "forms": pa.list_(pa.int64())}
    made = _spread(cut(sids.join(spellings, "sid").select("sid", "business", "series", "words"), "lettered"), TASK_TEXTS)
    made = made.mapInArrow(run, "sid long, business string, series long, n int, forms array<long>")
    return made.select("sid", "business", "series", "n", F.explode("forms").alias("form"))


def _pairs_of_great(asks: DataFrame, offers: DataFrame, spellings: DataFrame) -> DataFrame:
    """a < b of rows of asks with rows of offers (both sid, key) of the same key: all that agree, and few that do not.

    If spellings of as many words agree, each word of the one has a near one in the other. So each asking spelling looks in its block only for
    those with a word near to one of its own, the one to which the fewest are. Spellings with more or fewer words agree only
    if their letters do, but for two edits. Nothing is left out, however great the block: what grows is the number of pairs that are near.
    """
    asks = cut(asks.select("sid", "key").distinct(), "asks")
    offers = cut(offers.select("sid", "key").distinct().join(asks.select("key").distinct(), "key", "left_semi"), "offers")
    sids = asks.select("sid").union(offers.select("sid")).distinct()
    words = sids.join(spellings, "sid").select("sid", F.size("words").alias("n"), F.explode(F.arrays_zip("words", "cuts")).alias("w"))
    words = cut(words.select("sid", "n", F.col("w.words").alias("word"), F.col("w.cuts").alias("short")).distinct(), "spoken")
    known = cut(words.select("word", "short").distinct().withColumn("wid", F.monotonically_increasing_id()).select("wid", "word", "short"), "known")
    words = words.join(known, ["word", "short"]).select("sid", "n", "wid")
    asking, offered = cut(asks.join(words, "sid"), "asking"), cut(offers.join(words, "sid"), "offered")
    of = lambda rows: cut(known.join(rows.select("wid").distinct(), "wid", "left_semi"), "of")
    near = _near_words(of(asking), of(offered))

    sizes = offered.groupBy("key", "n", F.col("wid").alias("y")).agg(F.count(F.lit(1)).alias("size"))
    ways = asking.select("key", "n", F.col("wid").alias("x")).distinct().join(near, "x").join(sizes, ["key", "n", "y"])
    ways = cut(ways.select("key", "n", "x", "y", "size"), "ways")
    weights = ways.groupBy("key", "n", "x").agg(F.sum("size").alias("weight"))
    weighed = asking.withColumnRenamed("wid", "x").join(weights, ["key", "n", "x"], "left")
    # A word that no offered spelling has anything near to is the best: nothing agrees then.
    rarest = weighed.groupBy("key", "n", "sid").agg(F.min(F.struct(F.coalesce("weight", F.lit(0)), "x"))["x"].alias("x"))
    mine, theirs = rarest.withColumnRenamed("sid", "s"), offered.select("key", "n", F.col("wid").alias("y"), F.col("sid").alias("t"))
    met = mine.join(ways.drop("size"), ["key", "n", "x"]).join(theirs, ["key", "n", "y"]).select("s", "t")

    l, r = _letters(asks.select("sid").distinct(), spellings), _letters(offers.select("sid").distinct(), spellings)  # noqa: E741
    l, r = l.withColumnRenamed("sid", "s"), r.select("business", "series", "form", F.col("sid").alias("t"), F.col("n").alias("m"))  # noqa: E741
    alike = l.join(r, ["business", "series", "form"]).where("n <> m").select("s", "t").distinct()
    alike = alike.join(asks.withColumnRenamed("sid", "s"), "s").join(offers.withColumnRenamed("sid", "t"), ["t", "key"]).select("s", "t")
    return met.union(alike).where("s <> t").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """a < b of the rows (sid, key, role) of left and right that meet in a block."""
    l = left.select(F.col("sid").alias("x"), "key", F.col("role").alias("r"))  # noqa: E741
    r = right.select(F.col("sid").alias("y"), "key", F.col("role").alias("s"))
    met = l.join(r, "key").where("x <> y and (r = 1 or s = 1 or r = 0 and s = 0)")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _agreeing(pairs: DataFrame) -> DataFrame:
    """a, b, how of the pairs of spellings that agree; pairs has a, b, wa, ca, wb, cb."""

    def run(batches):
        for batch in batches:
            how = [agreement(*x) for x in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            chosen = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(how, pa.int32())], names=["a", "b", "how"]).filter(pa.array([x != DIFFERENT for x in how], pa.bool_()))
            if chosen.num_rows:
                yield chosen

    return pairs.mapInArrow(run, "a long, b long, how int")


def _moved(entity_of: DataFrame, labels: DataFrame) -> DataFrame:
    """entity_of with its entities renamed by labels (node, label)."""
    moved = entity_of.join(labels.withColumnRenamed("node", "entity"), "entity", "left")
    return cut(moved.select("sid", F.coalesce("label", "entity").alias("entity")), "entities")


def _united(entity_of: DataFrame, edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """entity_of after the merges that the edges (a, b, how between spellings) allow; cuts has the sid of spellings with a word cut by a point.

    Agreement by letters merges. Short forms never merge two profiles that hold whole spellings: a profile of nothing but short forms
    joins the one profile with whole spellings that it fits; if it fits several, which then differ, it stays by itself. Where
    none is, it joins the one profile of short forms that it fits. A spelling is short if a word of it is cut or is the short
    form in some agreement.
    """
    mine, theirs = entity_of.select(F.col("sid").alias("a"), F.col("entity").alias("ea")), entity_of.select(F.col("sid").alias("b"), F.col("entity").alias("eb"))
    met = edges.join(mine, "a").join(theirs, "b").where("ea <> eb")
    same = cut(met.where(F.col("how") == SAME).select(F.col("ea").alias("a"), F.col("eb").alias("b")).distinct(), "same")
    if not same.isEmpty():
        return _united(_moved(entity_of, components(same)), edges, cuts)
    first, second = F.col("how").isin(FIRST_SHORT, BOTH_SHORT), F.col("how").isin(SECOND_SHORT, BOTH_SHORT)
    short = cuts.union(edges.where(first).select("a")).union(edges.where(second).select("b")).distinct()
    full = cut(entity_of.join(short, "sid", "left_anti").select(F.col("entity").alias("fits")).distinct().withColumn("full", F.lit(True)), "full")
    both = met.where(first).select(F.col("ea").alias("entity"), F.col("eb").alias("fits")).union(met.where(second).select("eb", "ea")).distinct()
    asking = both.join(full.select(F.col("fits").alias("entity")), "entity", "left_anti").join(full, "fits", "left")
    one = asking.groupBy("entity").agg(F.count("full").alias("n"), F.min(F.when(F.col("full"), F.col("fits"))).alias("goal"), F.count(F.lit(1)).alias("m"), F.min("fits").alias("other"))
    kinds = (F.col("n") == 0).alias("among_short")
    joins = cut(one.where("n = 1 or n = 0 and m = 1").select(F.col("entity").alias("a"), F.coalesce("goal", "other").alias("b"), kinds), "joins")
    if joins.isEmpty():
        return entity_of
    # Profiles with whole spellings join nothing here, so what joins them needs one step; short forms among themselves may form chains.
    if joins.where("among_short").isEmpty():
        return _moved(entity_of, joins.select(F.col("a").alias("node"), F.col("b").alias("label")))
    return _moved(entity_of, components(joins.select("a", "b")))


def resolve_names(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, entity of each row that names an organisation; rows of one entity name the same one, in whatever spelling.

    rows: id int64, text string. Null, blank and wordless texts name nothing and are left out. Repeated rows and equal
    spellings are one profile from the start. entity is stable for one table, but means nothing beyond it.

    Merge and rematch: every distinct spelling is a profile and meets those with which it shares a block (a word, a word's beginning or end
    with the initials of all words, or all words written together, always with business word and series number; in great ones see _pairs_of_great). Agreeing
    profiles merge and unite their spellings, initials and block keys. Each part of a merged profile then enters the blocks that the other parts
    brought and that it has not been in, with all its spellings against all of the others there, until nothing merges. No
    pair of spellings is compared twice. See _united for what may merge: a short form that fits two different names joins neither.
    """
    rows = cut(rows.where("text is not null").select("id", "text"), "rows")
    texts = cut(rows.select("text").distinct(), "texts")
    names = cut(_named(texts), "names")
    spelled = ["words", "cuts", "business", "series"]
    spellings = cut(names.select(*spelled).distinct().withColumn("sid", F.monotonically_increasing_id()), "spellings")
    forms = spellings.select("sid", "words", "cuts")
    cuts = spellings.where(F.exists("cuts", lambda x: x)).select("sid")
    small, great = blocks_of(spellings, block)
    blocks = small if great is None else small.unionByName(great)

    def compared(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of spellings the agreeing ones, and how they agree."""
        a = forms.select(F.col("sid").alias("a"), F.col("words").alias("wa"), F.col("cuts").alias("ca"))
        b = forms.select(F.col("sid").alias("b"), F.col("words").alias("wb"), F.col("cuts").alias("cb"))
        full = cut(pairs.join(a, "a").join(b, "b").select("a", "b", "wa", "ca", "wb", "cb"), "pairs")
        return cut(_agreeing(_spread(full, TASK_PAIRS)), "agreeing")

    entity_of = spellings.select("sid", F.col("sid").alias("entity"))
    met = _pairs(small, small)
    if great is not None:
        asks = cut(great.where("role < 2"), "askers")
        if not asks.isEmpty():
            met = met.union(_pairs_of_great(asks, great, spellings)).distinct()
    decided = cut(met, "decided")
    edges = compared(decided)
    while True:
        now = _united(entity_of, edges, cuts)
        if now is entity_of:
            break
        # The parts that merged, and the blocks that are new to each.
        parts = entity_of.withColumnRenamed("entity", "part").join(now, "sid")
        held = blocks.join(parts, "sid").select("entity", "part", "key").distinct()
        several = held.groupBy("entity").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("entity")
        held = cut(held.join(several, "entity", "left_semi"), "held")
        new = held.select("entity", "key").distinct().join(held.select("entity", "part").distinct(), "entity").join(held, ["entity", "part", "key"], "left_anti")
        new = new if great is None else cut(new, "new")
        others = small.join(parts, "sid").select("key", F.col("part").alias("other"), F.col("entity").alias("other_entity")).distinct()
        meeting = new.join(others, "key").where("entity <> other_entity").select("part", "other").distinct()
        spoken = parts.select("part", "sid")
        fresh = meeting.join(spoken.withColumnRenamed("sid", "s"), "part").join(spoken.select(F.col("part").alias("other"), F.col("sid").alias("t")), "other")
        fresh = fresh.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
        entered = None if great is None else cut(new.join(great.select("key").distinct(), "key", "left_semi"), "entered")
        if entered is not None and not entered.isEmpty():
            there = great.join(entered.select("key").distinct(), "key", "left_semi").join(parts, "sid").select("key", "part").distinct()
            found = _pairs_of_great(entered.join(spoken, "part"), there.join(spoken, "part"), spellings)
            within = now.select(F.col("sid").alias("a"), F.col("entity").alias("ea")), now.select(F.col("sid").alias("b"), F.col("entity").alias("eb"))
            fresh = fresh.union(found.join(within[0], "a").join(within[1], "b").where("ea <> eb").select("a", "b"))
        fresh = cut(fresh.distinct().join(decided, ["a", "b"], "left_anti"), "fresh")
        entity_of = now
        if not fresh.isEmpty():
            decided = cut(decided.unionByName(fresh), "decided")
            edges = cut(edges.unionByName(compared(fresh)), "agreeing")
    by_text = names.join(spellings, spelled).join(entity_of, "sid").select("text", "entity")
    return rows.join(by_text, "text").select("id", "entity")


def same_entity_pairs(resolved: DataFrame, id_a: str, id_b: str) -> DataFrame:
    """Every pair of rows of one entity, the smaller id first."""
    a = resolved.select("entity", F.col("id").alias(id_a))
    b = resolved.select("entity", F.col("id").alias(id_b))
    return a.join(b, "entity").where(F.col(id_a) < F.col(id_b)).select(id_a, id_b)
