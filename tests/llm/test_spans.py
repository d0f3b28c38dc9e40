import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import spans
from stratalog.llm.spans import shared_characters


def brute(rows, span):
    owners = defaultdict(set)
    for doc, text in rows:
        for i in range(len(text or "") - span + 1):
            owners[text[i : i + span]].add(doc)
    out = {}
    for doc, text in rows:
        if doc is None:
            continue
        covered = set()
        for i in range(len(text or "") - span + 1):
            if len(owners[text[i : i + span]] - {None}) > 1:
                covered.update(range(i, i + span))
        out[doc] = max(out.get(doc, 0), len(covered))
    return {d: n for d, n in out.items() if n}


def words(rng, n, letters="abcdefgh é漢😀"):
    return "".join(rng.choice(letters) for _ in range(n))


def found(spark, rows, span, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int, start string, sure int")
    return {r.doc_id: r.shared_chars for r in shared_characters(df, "doc_id", "text", span, **options).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (159, 160, 161, 170, 199, 240, 320, 600)]
    rows = []
    for doc in range(60):
        text = words(rng, rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            a = rng.randint(0, 40)
            text += rng.choice([passage, passage[a:], passage[: len(passage) - a]]) + words(rng, rng.randint(0, 90))
        rows.append((doc, text))
    rows += [(100, "a" * 900), (101, "a" * 400 + "b"), (102, "ab" * 300), (103, "ab" * 200), (104, ""), (105, None), (106, " "), (107, rows[3][1]), (108, rows[3][1]), (None, rows[3][1])]
    rows += [rows[5], rows[5]]
    assert found(spark, [(*r, 1, "x", 2) for r in rows], 160) == brute(list(dict.fromkeys(rows)), 160)


def test_repeats_of_one_record_are_not_shared(spark):
    text = words(random.Random(3), 700)
    assert found(spark, [(1, text, 0, "", 0)] * 3, 300) == {}
    assert found(spark, [], 300) == {}


def test_joins_without_broadcast_give_the_same(spark):
    rng = random.Random(4)
    common = words(rng, 400)
    rows = [(i, words(rng, 50) + common[rng.randint(0, 60) :] + words(rng, 50), 0, "", 0) for i in range(40)]
    usual = found(spark, rows, 300)
    assert found(spark, rows, 300, broadcast=0) == usual == brute([r[:2] for r in rows], 300)


def test_long_texts_are_cut_into_pieces_without_loss(monkeypatch):
    points = spans.code_points(words(random.Random(5), 5000))
    whole = spans.chunks(points, 300)
    monkeypatch.setattr(spans, "PIECE", 700)
    pieces = spans.chunks(points, 300)
    assert [x.tolist() for x in whole] == [x.tolist() for x in pieces]


def test_every_stretch_holds_a_chunk():
    rng = random.Random(6)
    for letters in ("ab", "abcdefghij ", "a"):
        points = spans.code_points(words(rng, 3000, letters))
        start, end, near, far = spans.chunks(points, 300)
        for i in range(len(points) - 300 + 1):
            owned = (start - far <= i) & (i <= start - near)
            assert owned.sum() == 1 and start[owned][0] >= i and end[owned][0] <= i + 300


def test_whole_table(spark, sf):
    from stratalog.llm.queries import p9_found
    from stratalog.session import table

    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert {r.doc_id: r.shared_chars for r in p9_found(spark, sf).collect()} == brute(rows, 300)


def test_digests_tell_texts_apart_that_collide_in_polynomials_modulo_powers_of_two():
    text = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    points = spans.code_points(text + text.translate(str.maketrans("ab", "ba")) + text)
    for n in (1024, 2048, 4096):
        d0, d1 = spans.digests(points, np.array([0, 4096, 8192]), np.array([n, 4096 + n, 8192 + n]), 7)
        assert (d0[0], d1[0]) == (d0[2], d1[2]) and d0[0] != d0[1] and d1[0] != d1[1]
    assert spans.digests(points, np.array([0]), np.array([9]), 8)[0][0] != spans.digests(points, np.array([0]), np.array([9]), 7)[0][0]


def test_half_digests_that_stand_for_several_whole_ones(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0), (1, 1, 2, 0), (1, 2, 3, 0), (2, 1, 1, 0), (2, 2, 2, 0), (3, 1, 1, 0), (3, 1, 2, 5)], "d0 long, d1 int, doc long, start int")
    for broadcast in (0, 1000):
        assert sorted(tuple(r) for r in spans._in_several(rows, broadcast).select("d0", "d1", "doc").collect()) == [(1, 1, 1), (1, 1, 2), (3, 1, 1), (3, 1, 2)]
        hits = spans._hits(rows.withColumn("length", F.lit(1)), broadcast)
        assert sorted(tuple(r) for r in hits.select("d0", "d1", "doc", "lo", "hi", "hi_start").collect()) == [(1, 1, 1, 1, 2, 0), (1, 1, 2, 1, 2, 0), (3, 1, 1, 1, 2, 5), (3, 1, 2, 1, 2, 5)]
