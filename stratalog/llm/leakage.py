"""Evaluation texts leaking into training text: a positional inverted index, searched from the rarest terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.operators.joins import guarded_join
from stratalog.session import BROADCAST_ROWS, at_most, cut

#: What stands between words: anything but Unicode letters and decimal digits.
NO_WORD = r"[^\p{L}\p{Nd}]+"
#: Positions that share a bucket when words are looked for near a place.
BUCKET = 64


def words(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, term, following: the words of each text in lower case and the word after each (null after the last). Positions count on without gaps."""
    split = F.split(F.col(text), NO_WORD)
    told = df.where(F.col(text).isNotNull()).select(key, split.alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    told = told.select(key, F.posexplode(pairs).alias("pos", "p")).where("p.a <> ''")
    return told.select(key, F.col("pos").cast("int").alias("pos"), F.lower("p.a").alias("term"), F.nullif(F.lower("p.b"), F.lit("")).alias("following"))


class PositionalIndex:
    """Postings (doc, pos, term, following) of all words of a corpus, stored as a table that any number of test sets can be searched in.

    Each posting names the word after it, so that the rarest terms a search begins with may be two words long. The
    postings of a document lie together, as it is indexed where it lies: building shuffles nothing.
    """

    def __init__(self, postings: DataFrame):
        self.postings = postings

    @classmethod
    def build(cls, documents: DataFrame, doc: str, text: str, path: str | None = None) -> PositionalIndex:
        """The index of documents, kept at path, or else in the shared folder for this application."""
        corpus = documents.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
        postings = words(corpus, "doc", "text").select("doc", "pos", "term", "following")
        if path is None:
            return cls(cut(postings, "postings"))
        postings.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return cls.read(documents.sparkSession, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> PositionalIndex:
        return cls(spark.read.parquet(path))


def _near(many: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on keys that place a word in a document: no such key is hot, so beyond the broadcast a plain shuffle does."""
    return many.join(F.broadcast(few) if at_most(few, BROADCAST_ROWS) else few, on)


class Search:
    """The words of test items looked up in an index: `pairs` of adjacent words and where the rarest of them put an item."""

    def __init__(self, index: PositionalIndex, items: DataFrame, item: str, item_text: str, length: int):
        if length < 2:
            raise ValueError("a passage has at least two words")
        self.index, self.run = index, length - 1
        # Two texts under one item id are two texts (k) here and meet again in the result.
        self.texts = cut(items.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).alias("text")).distinct().withColumn("k", F.monotonically_increasing_id()), "texts")
        self.words = cut(words(self.texts, "k", "text").withColumnRenamed("pos", "i"), "words")
        adjacent = self.words.where("following is not null")
        numbers = cut(adjacent.select("term", "following").distinct().withColumn("p", F.monotonically_increasing_id()), "pairs")
        self.asked = cut(adjacent.join(numbers, ["term", "following"]).select("k", "i", "p"), "asked")
        self.pairs = cut(guarded_join(index.postings, numbers, ["term", "following"]).select("p", "doc", "pos"), "found")

    def anchors(self) -> DataFrame:
        """k, i, p: of each run of an item's words the rarest two adjacent ones. Runs with two adjacent words that the corpus lacks have none."""
        n = self.pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        counted = self.asked.join(n, "p", "left").select("k", "i", "p", F.coalesce("n", F.lit(0)).alias("n"))
        run = Window.partitionBy("k").orderBy("i").rowsBetween(0, self.run - 1)
        best = counted.select("k", F.min(F.struct("n", "i", "p")).over(run).alias("best"), F.count(F.lit(1)).over(run).alias("size"))
        return best.where((F.col("size") == self.run) & (F.col("best.n") > 0)).select("k", "best.i", "best.p").distinct()

    def alignments(self) -> DataFrame:
        """doc, k, shift: where a rarest pair puts an item into a document (word i of the item at position i + shift)."""
        hits = guarded_join(self.pairs, cut(self.anchors(), "anchors"), ["p"])
        return cut(hits.select("doc", "k", (F.col("pos") - F.col("i")).alias("shift")).distinct(), "alignments")

    def phrases(self, at: DataFrame) -> DataFrame:
        """doc, item, longest: the longest run of words that stand in the document as in the item, if it has the wanted length.

        Each alignment says where every pair of the item would stand; these places are met with the postings by document, place and pair.
        """
        places = cut(at.join(self.asked, "k").select("doc", (F.col("i") + F.col("shift")).alias("pos"), "p", "k", "shift", "i"), "places")
        exact = _near(self.pairs, places, ["doc", "pos", "p"]).select("doc", "k", "shift", "i").distinct()
        w = Window.partitionBy("doc", "k", "shift").orderBy("i")
        islands = exact.select("doc", "k", "shift", (F.col("i") - F.row_number().over(w)).alias("island"))
        sizes = islands.groupBy("doc", "k", "shift", "island").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.run)
        return sizes.join(self.texts.select("k", "item"), "k").groupBy("doc", "item").agg((F.max("n") + 1).alias("longest"))

    def close(self, slack: int) -> DataFrame:
        """doc, item, n: the most words of the item that stand at most `slack` places off one loose alignment.

        The rarest word of a run proposes it; it counts if the run's second rarest word stands near its place too. Only then
        are all words of the item looked for, each near its place by document, word and bucket of positions.
        """
        postings, run = self.index.postings, Window.partitionBy("k").orderBy("i").rowsBetween(0, self.run)
        asked = cut(self.words.select("term").distinct(), "terms")
        n = guarded_join(postings, asked, ["term"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        counted = self.words.join(n, "term", "left").select("k", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "i", "term").alias("w"), "i")
        two = counted.select("k", F.slice(F.array_sort(F.collect_list("w").over(run)), 1, 2).alias("two"), F.count(F.lit(1)).over(run).alias("size"))
        two = two.where((F.col("size") == self.run + 1) & (F.col("two")[0]["n"] > 0)).select("k", "two").distinct()
        anchors = cut(two.select("k", F.col("two")[0]["i"].alias("first"), F.col("two")[0]["term"].alias("term"), F.col("two")[1]["i"].alias("i"), F.col("two")[1]["term"].alias("second")), "anchors")
        proposed = guarded_join(postings.select("doc", "pos", "term"), anchors, ["term"]).select("doc", "k", (F.col("pos") - F.col("first")).alias("shift"), "i", F.col("second").alias("term")).distinct()
        at = cut(self._met(proposed, slack).select("doc", "k", "shift").distinct(), "loose")
        counted = self._met(at.join(self.words.select("k", "i", "term"), "k"), slack).groupBy("doc", "k", "shift").agg(F.count_distinct("i").alias("n"))
        return counted.join(self.texts.select("k", "item"), "k").groupBy("doc", "item").agg(F.max("n").alias("n"))

    def _met(self, wanted: DataFrame, slack: int) -> DataFrame:
        """The rows (doc, k, shift, i, term) of wanted whose word stands at most `slack` places off i + shift."""
        place = F.col("i") + F.col("shift")
        near = wanted.select("doc", "term", "k", "shift", "i", place.alias("place"), F.explode(F.sequence(F.floor((place - slack) / BUCKET), F.floor((place + slack) / BUCKET))).alias("bucket"))
        here = self.index.postings.select("doc", "term", "pos", F.floor(F.col("pos") / BUCKET).alias("bucket"))
        return _near(here, cut(near, "near"), ["doc", "term", "bucket"]).where(F.abs(F.col("pos") - F.col("place")) <= slack)


def leaked_items(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, length: int = 12) -> DataFrame:
    """doc, item of every document that holds at least `length` (2 or more) consecutive words of an item's text, in order.

    Words are the maximal runs of letters and digits in lower case, so case, punctuation and spacing do not count. One row
    per pair. Items with fewer words match nothing; null texts and null ids are ignored; rows that repeat a
    document or an item change nothing; empty tables give no rows. Document ids must be unique among different texts.

    Offset-adjusted posting lists are intersected from the rarest term of each run of `length` words on, a term being two
    adjacent words: its postings give the alignments, few besides the true ones, and the other terms of the item are looked up
    at the places where the alignments put them. Small sides are broadcast after a count, else hot terms are split, so neither a
    frequent term nor a passage that a third of all documents hold gathers in one task.
    """
    search = Search(PositionalIndex.build(documents, doc, text), items, item, item_text, length)
    return search.phrases(search.alignments()).select(F.col("doc").alias(doc), F.col("item").alias(item))


def item_matches(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, length: int = 12, slack: int = 3) -> DataFrame:
    """doc, item, kind, n_words: exact phrases (n_words: the longest run) and, where there is none, proximity matches.

    A proximity match has at least `length` words of the item, each at most `slack` places off one alignment that the two rarest
    words of some run of `length` words give; that is, with insertions, deletions or swaps between them. Edge cases as for leaked_items.
    """
    search = Search(PositionalIndex.build(documents, doc, text), items, item, item_text, length)
    exact = cut(search.phrases(search.alignments()).select("doc", "item", F.lit("phrase").alias("kind"), F.col("longest").alias("n_words")), "phrases")
    loose = search.close(slack).where(F.col("n") >= length).join(exact, ["doc", "item"], "left_anti").select("doc", "item", F.lit("proximity").alias("kind"), F.col("n").alias("n_words"))
    return exact.unionByName(loose).select(F.col("doc").alias(doc), F.col("item").alias(item), "kind", "n_words")
