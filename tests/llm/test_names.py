import itertools
import random

import pytest

from stratalog.llm.names import BUSINESS, DIFFERENT, FIRST_SHORT, SAME, agreement, distance, letter_forms, name_of_line, parse_name, word_cost, word_forms, word_keys
from stratalog.llm.resolution import components, resolve_names, same_entity_pairs

ONE = [
    "Marbeck Tolvane Holdings, LLC", "MARBECK TOLVANE HOLDINGS LLC", "Holdings Marbeck Tolvane, L.L.C.", "Marbeck/Tolvane Hldgs", "Tolvane Holdings, Limited Liability Company, Marbeck",
    "The Marbeck Tolvane Holdings (f/k/a Quen Group)", "Marbeck Tolv. Holdings, LLC", "Marbek Tolvane Holdings", "MarbeckTolvane Holdings, LLC", "Marbeсk​ Tolváne Holding, Llc", "Mrabeck Tolvane Holdings",
]
OTHERS = ["Marbeck Tolvane Logistics, LLC", "Marbeck Tolvane Holdings II, LLC", "Marbeck Tolvane Fund III, L.P.", "Marbeck Tolvane Fund IV, L.P.", "Sorveck Tolvane Holdings, LLC", "Marbeck Quinnor Holdings, LLC"]


def agree(a, b):
    a, b = parse_name(a), parse_name(b)
    return a[2:] == b[2:] and agreement(a[0], a[1], b[0], b[1]) != DIFFERENT


def test_spellings():
    for x in ONE:
        assert agree(x, ONE[0]), (x, parse_name(x))
        for y in OTHERS:
            assert not agree(x, y), (x, y)
    for x, y in itertools.combinations(OTHERS, 2):
        assert not agree(x, y), (x, y)
    assert parse_name("Nimvor Tool & Die, S.à r.l.")[2] == parse_name("Nimvor Tool + Die Sarl")[2] == "tooldie"
    assert parse_name("")[0] == parse_name("LLC")[0] == []


@pytest.mark.parametrize("line", ["Nim Vor Foods, Inc. - Second Lien Term Loan, S + 5%", "Nim Vor Foods, Inc. | Warrants", "Nim Vor Foods, Inc., Class A Common Units", "Nim Vor Foods, Inc."])
def test_name_of_line(line):
    assert name_of_line(line) == "Nim Vor Foods, Inc."


def test_distance():
    assert [distance("abcd", x, 2) for x in ("abcd", "abdc", "abc", "xbcx", "zzzz", "abcdefg")] == [0, 1, 1, 2, 3, 3]


def resolved(spark, rows):
    return {(r.a, r.b) for r in same_entity_pairs(resolve_names(spark.createDataFrame(rows, "id long, text string")), "a", "b").collect()}


def test_edge_rows(spark):
    rows = [(i, x) for i, x in enumerate(ONE)] + [(100 + i, x) for i, x in enumerate(OTHERS)] + [(200, None), (201, ""), (202, "LLC"), (203, "LLC"), (204, ONE[0]), (205, "x" * 50_000)]
    ours = [*range(len(ONE)), 204]
    assert resolved(spark, rows) == set(itertools.combinations(ours, 2))
    assert resolved(spark, []) == set()


def test_merging_reaches_what_no_pair_shows(spark):
    first, middle, last = "Arvonetck Belumar Systems", "Arvonteck Bellumar Systems", "Arovtneck Belulmar Systems"
    keys = lambda x: dict(word_keys(*parse_name(x)[:2]))
    in_block = lambda x, y: bool({k for k in keys(x).keys() & keys(y).keys() if k[0] != "i"})
    assert agree(first, middle) and in_block(first, middle)
    assert agree(middle, last) and not in_block(middle, last)
    assert not agree(first, last) and in_block(first, last)
    assert resolved(spark, list(enumerate([first, middle, last]))) == set(itertools.combinations(range(3), 2))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (60, 60), (51, 40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40, 51: 40}


def made_up(rng, n_entities, n_words, business):
    """Rows (id, text) of made-up organisations in made-up spellings, and the organisation of each."""
    parts = ["bar", "cel", "dun", "fim", "gor", "hax", "jul", "kem", "lov", "mir", "nop", "quas", "rel", "sut", "tev", "wim"]
    word = lambda: "".join(rng.choice(parts) for _ in range(3)).title()

    def typo(w):
        i = rng.randrange(1, len(w) - 1)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeioutnr") + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])

    rows, owner = [], {}
    for entity in range(n_entities):
        name, kind, number = [word() for _ in range(n_words)], rng.choice(business).title(), rng.choice(["", "", " II", " IV"])
        for _ in range(rng.randint(1, 6)):
            words, at = list(name), rng.randrange(n_words)
            if rng.random() < 0.3:
                words[at] = typo(words[at])
            elif rng.random() < 0.2 and n_words > 1:
                words[at] = words[at][: rng.randint(4, 6)] + "."
            elif rng.random() < 0.15 and n_words > 1:
                words[at : at + 2] = ["".join(words[at : at + 2])]
            legal = rng.choice([", LLC", " Inc.", ", L.P.", "", " S.à r.l."])
            text = " ".join(words)
            text = rng.choice([f"{text} {kind}{number}{legal}", f"{text} {kind}{number}{legal}".upper(), f"{kind} {text}{number}{legal}", f"{' '.join(words[1:])} {kind}{number}{legal}, {words[0]}"])
            owner[len(rows)] = entity
            rows.append((len(rows), text))
    return rows, {(i, j) for i, j in itertools.combinations(owner, 2) if owner[i] == owner[j]}


OWN_BUSINESS = ["airlines", "gaming", "biotech", "dairies"]


@pytest.mark.parametrize("n_words, business", [(1, BUSINESS[:40]), (2, OWN_BUSINESS), (3, BUSINESS[:40]), (6, BUSINESS[:40])])
def test_held_out_variants(spark, n_words, business):
    """Pairs found against pairs meant, for names of any number of words and for business words that no list holds."""
    rows, meant = made_up(random.Random(11 + n_words), 80, n_words, business)
    found = resolved(spark, rows)
    assert len(found & meant) / len(meant) > (0.9 if n_words == 1 else 0.95)
    assert len(found & meant) / len(found) > (0.97 if n_words == 1 else 0.99)


def test_order_does_not_count_for_any_number_of_words():
    words = [f"{x}lorvane" for x in "abcdefgh"]
    for n in range(2, 9):
        for k in range(n):
            assert agree(" ".join(words[:n]) + " LLC", " ".join(words[k:n] + words[:k]))


def test_short_forms_join_no_two_names(spark):
    rows = [(1, "North Shore Capital"), (2, "N. Shore Capital"), (3, "New Shore Capital"), (4, "Velmor Quist Capital"), (5, "V. Quist Capital"), (6, "Velmor Q. Capital LLC"), (7, "A. Tam Capital"), (8, "Arno Tam Foods"), (9, "Glimm Aster Capital"), (10, "Glimmoge Aster Capital")]
    assert resolved(spark, rows) == {(4, 5), (4, 6), (5, 6), (9, 10)}
    a, b = parse_name("N. Shore Capital"), parse_name("North Shore Capital")
    assert agreement(*a[:2], *b[:2]) == FIRST_SHORT and agreement(*b[:2], *b[:2]) == SAME


def test_great_blocks_are_split_without_loss(spark):
    rng = random.Random(5)
    rows, _ = made_up(rng, 10, 2, ["capital"])
    rows = [(i, f"{x} American") for i, x in rows] + [(1000 + i, f"American {x}") for i, x in rows[:10]]
    df = spark.createDataFrame(rows, "id long, text string")
    pairs = lambda n: {(r.a, r.b) for r in same_entity_pairs(resolve_names(df, n), "a", "b").collect()}
    assert pairs(4) == pairs(10_000)


def test_great_blocks_keep_what_only_they_show(spark):
    """Pairs of which every key is that of a great block: short forms only, words together and apart, cut without a point, cut and misspelled."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n))
    others = [f"{x} {y} Capital" for x, y in ((f"Med{word(2)}", f"Qui{word(2)}") for _ in range(30))] + [f"American {word(3)} Tolvane Capital" for _ in range(30)] + [f"American Interm{word(5)} Capital" for _ in range(30)]
    alike = ["Marbeck Quinnor Capital", "Mar. Qui. Capital", "American Gremlok Tolvane Capital", "Americangremlok Tolvane Capital", "American Intermovexiladu Capital", "American Intermov Capital", "American Intermazovupeki Capital", "American Intremazo. Capital"]
    rows = [(i, x) for i, x in enumerate(alike)] + [(100 + i, x) for i, x in enumerate(others)]
    df = spark.createDataFrame(rows, "id long, text string")
    pairs = lambda n: {(r.a, r.b) for r in same_entity_pairs(resolve_names(df, n), "a", "b").collect()}
    found = pairs(5)
    assert {(a, b) for a, b in found if b < 100} == {(0, 1), (2, 3), (4, 5), (6, 7)}
    assert found == pairs(10_000)


def test_letters_that_agreeing_spellings_share():
    for a, b in ((["marbeck", "tolvane"], ["marbecktolvane"]), (["tolvane", "marbeck", "quin"], ["marbektolvqane", "quin"]), (["ab", "c"], ["cab"]), (["a", "bb"], ["bba"])):
        assert agreement(a, [False] * len(a), b, [False] * len(b)) == SAME
        assert letter_forms(a) & letter_forms(b), (a, b)
    assert not letter_forms(["ab", "c"]) & letter_forms(["abd"])


def test_near_words_meet_by_their_forms():
    """Any two words that can stand for each other share a form, with roles that let them meet: also swaps in long words, and cut words."""
    rng = random.Random(4)
    meets = lambda a, b: any(f in b and (1 in (r, b[f]) or r == b[f] == 0) for f, r in a.items())
    near = 0
    for _ in range(6000):
        n = rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 21, 22, 23, 25, 27, 28, 30, 45])
        a = "".join(rng.choice("abcde") for _ in range(n))
        b = a
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(b) + 1)
            b = rng.choice([b[:i] + b[i + 1 :], b[:i] + "z" + b[i:], b[:i] + "z" + b[i + 1 :], b[:i] + b[i : i + 2][::-1] + b[i + 2 :], b[:i] + b[i : i + 2][::-1] + b[i + 2 :], b[:i]]) or "z"
        ca, cb = rng.random() < 0.3, rng.random() < 0.3
        if word_cost(a, ca, b, cb)[0] < 9 or word_cost(b, cb, a, ca)[0] < 9:
            near += 1
            assert meets(dict(word_forms(a, ca)), dict(word_forms(b, cb))), (a, ca, b, cb)
    assert near > 3000
    a = "abcdefghijklmnopqrstuvwxyzab"
    b = "abcdegfhijklmnopqsrtuvwxyzab"  # swaps where the pieces of old met
    assert word_cost(a, False, b, False)[0] == 2 and meets(dict(word_forms(a, False)), dict(word_forms(b, False)))


def test_forms_that_agreeing_words_share():
    rng = random.Random(9)
    for n in (3, 5, 8, 12, 20, 23, 24, 25, 26, 27, 28, 40):
        for _ in range(20):
            a = "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
            b = a
            for _ in range(0 if n < 4 else 1 if n < 7 else 2 if n < 9 else 3):
                i = rng.randrange(len(b))
                b = rng.choice([b[:i] + b[i + 1 :], b[:i] + "z" + b[i:], b[:i] + "z" + b[i + 1 :]])
            if agreement(["x", a], [False] * 2, ["x", b], [False] * 2) == SAME:
                assert {f for f in word_forms(a, False) if f[0][:2] != "c:"} & {f for f in word_forms(b, False) if f[0][:2] != "c:"}, (a, b)
    assert {f for f, _ in word_forms("marbeck", False)} & {f for f, _ in word_forms("mar", True)}


def test_equal_keys_for_any_order():
    a, b = parse_name("Marbeck Tolvane Holdings"), parse_name("Tolvane Marbeck Holdings")
    assert {k for k, _ in word_keys(*a[:2])} == {k for k, _ in word_keys(*b[:2])}
