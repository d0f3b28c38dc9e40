from collections import defaultdict

from stratalog.llm.lookalike import lookalike_pairs, visible_form, with_form

SAME = [
    ["Acme Inc.", " Acme Inc.", "Ａcme Inc.", "Асme Inc.", "Ac​me Inc.", "Acme　Inc．", "Acme\tInc."],
    ["Société", "Société", "Socié‍té", "Sосiété"],
    ["fine-flow", "ﬁne‐ﬂow", "fine‑flow", "fi­ne－flow"],
    ["", " ", " "],
]
OTHER = ["ACME INC.", "Acme Inc", "Societe", "fine_flow", "fine—flow", "Acme  Inc.", "Bcme Inc."]


def test_invisible_in_any_writing(spark):
    # Fillers whose other writing is an invisible one, format controls, a blank symbol, and letters of further alphabets.
    pairs = [("a\u3164b", "ab"), ("a\uffa0b", "ab"), ("a\u1160b", "ab"), ("a\u2062b", "ab"), ("a\U000e0041b", "ab"), ("a\u2800b", "a b"), ("\u13a0\u13a1 \ua4d0", "DR B"), ("\u0585\u057d", "ou"), ("\u2c9e\u2ca3", "Op")]
    forms = {r.raw: r.form for r in with_form(spark.createDataFrame([(x,) for x, _ in pairs], "raw string")).collect()}
    for raw, want in pairs:
        assert forms[raw] == visible_form(raw) == want, ascii(raw)
    assert visible_form("a\u0600b") == "a\u0600b"  # a sign that shows


def test_pairs_when_nothing_is_broadcast(spark):
    rows = [("soi", 1, i, x) for i, x in enumerate([*SAME[0], "Acme Inc.", "Acme Inc.", *OTHER])]
    df = spark.createDataFrame(rows, "record_kind string, scope long, id long, raw string")
    assert sorted(tuple(r) for r in lookalike_pairs(df, 0).collect()) == brute(rows)


def test_forms(spark):
    texts = [x for group in SAME for x in group] + OTHER + [None, "x" * 100_000 + "а"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, raw string")
    forms = {r.id: r.form for r in with_form(df).collect()}
    assert [forms[i] for i in range(len(texts))] == [None if x is None else visible_form(x) for x in texts]
    for group in SAME:
        assert len({visible_form(x) for x in group}) == 1
    assert len({visible_form(x) for x in OTHER + [g[0] for g in SAME]}) == len(OTHER) + len(SAME)


def brute(rows):
    classes = defaultdict(list)
    for kind, scope, i, raw in rows:
        if raw is not None and scope is not None:
            classes[kind, scope, visible_form(raw)].append((i, raw))
    return sorted({(k[0], min(a, b), max(a, b)) for k, xs in classes.items() for a, x in xs for b, y in xs if a < b and x != y})


def test_pairs(spark):
    rows, i = [], 0
    for scope in (1, 2, None):
        for group in [*SAME, OTHER]:
            for x in group:
                rows.append(("soi", scope, i, x))
                i += 1
    rows += [("soi", 1, 900, "Acme Inc."), ("soi", 1, 901, "Acme Inc."), ("name", 0, 1, "Аcme Inc."), ("name", 0, 2, "Acme Inc."), ("soi", 1, 902, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "record_kind string, scope long, id long, raw string, x int, form string")
    assert sorted(tuple(r) for r in lookalike_pairs(df).collect()) == brute(rows)
    assert lookalike_pairs(df.limit(0)).collect() == []


def test_whole_table(spark, sf):
    from stratalog.llm.queries import _visible_rows, p5_found

    rows = [tuple(r) for r in _visible_rows(spark, sf).collect()]
    assert sorted(tuple(r) for r in p5_found(spark, sf).collect()) == brute(rows)
