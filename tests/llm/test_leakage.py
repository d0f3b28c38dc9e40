import random

import regex

from stratalog.llm import leakage
from stratalog.llm.leakage import item_matches, leaked_items


def tokens(text):
    return [w.lower() for w in regex.findall(r"[\p{L}\p{Nd}]+", text or "")]


def brute(docs, items, n=12):
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return sorted({(d, i) for d, x in docs for i, y in items if d is not None and i is not None and grams(tokens(x)) & grams(tokens(y))})


def data():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)] + ["the", "of", "é", "漢字", "12"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(8, 40)))) for i in range(25)]
    docs = []
    for d in range(60):
        w = text(rng.randint(0, 60))
        if rng.random() < 0.6:
            source = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(source) - 11))
            part = source[a : a + rng.randint(10, 20)]
            w += [x.upper() if rng.random() < 0.3 else x for x in part]
        w += text(rng.randint(0, 20))
        docs.append((d, "".join(x + rng.choice([" ", ", ", "\n", " - "]) for x in w)))
    docs += [(100, None), (101, ""), (102, " . "), (None, items[3][1]), (103, items[4][1] + "."), (103, items[4][1] + "."), (104, "a " * 30_000)]
    items += [(50, None), (51, ""), (52, "a a a a a a a a a a a a a"), (None, items[4][1]), items[4], (53, items[4][1].upper())]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id long, text string, t int, item string"),
        spark.createDataFrame([(*i, 2) for i in items], "item_id long, item_text string, doc int"),
    )


def test_against_brute_force(spark):
    docs, items = data()
    d, i = frames(spark, docs, items)
    got = leaked_items(d, "doc_id", "text", i, "item_id", "item_text")
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items)
    assert leaked_items(d.limit(0), "doc_id", "text", i, "item_id", "item_text").collect() == []
    assert leaked_items(d, "doc_id", "text", i.limit(0), "item_id", "item_text").collect() == []


def test_without_broadcast(spark, monkeypatch):
    docs, items = data()
    d, i = frames(spark, docs, items)
    plain = leakage.guarded_join
    monkeypatch.setattr(leakage, "guarded_join", lambda *a, **k: plain(*a, **k, broadcast_rows=0))
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in leaked_items(d, "doc_id", "text", i, "item_id", "item_text").collect()) == brute(docs, items)


def test_proximity(spark):
    words = [f"n{i}" for i in range(20)]
    swapped = words[:6] + ["oh", "no"] + words[6:]
    d, i = frames(spark, [(1, " ".join(words)), (2, " ".join(swapped[2:16])), (3, " ".join(words[:9]))], [(7, " ".join(words))])
    got = {tuple(r) for r in item_matches(d, "doc_id", "text", i, "item_id", "item_text").collect()}
    assert got == {(1, 7, "phrase", 20), (2, 7, "proximity", 12)}


def test_one_index_serves_several_test_sets(spark, tmp_path):
    docs, items = data()
    d, i = frames(spark, docs, items)
    index = leakage.PositionalIndex.build(d, "doc_id", "text", str(tmp_path / "index"))
    assert index.postings.count() == sum(len(tokens(x)) for d, x in docs if d is not None)
    for part in (i, i.where("item_id < 9")):
        search = leakage.Search(leakage.PositionalIndex.read(spark, str(tmp_path / "index")), part, "item_id", "item_text", 12)
        got = {(r.doc, r.item) for r in search.phrases(search.alignments()).collect()}
        assert got == set(brute(docs, [tuple(r)[:2] for r in part.collect()]))
