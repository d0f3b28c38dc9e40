import base64
import random

import pytest

from stratalog.llm import encoding
from stratalog.llm.encoding import PATTERN, TOKENIZER_DIR, decode_corpus, encode_corpus, encoder

PATH = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_another_implementation(reference):
    rng = random.Random(1)
    letters = "aAbé漢字😀 \n\t'sd<|endoftext|>ﬁ́\x00١.,-12"
    coder = encoder(PATH)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["<|endoftext|>", " ", "▁ ▁a", "a" * 50_000, "word " * 20_000, "<unk>", "<s>"]
    for text in texts:
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert coder.decode(ids) == text


def test_full_table_is_emptied(monkeypatch, reference):
    monkeypatch.setattr(encoding, "KEPT", 5)
    coder = encoding.ByteEncoder(PATH)
    for text in ("one two three four five six seven", "eight nine", "ten " + "x" * 300, "one two"):
        assert coder.encode(text) == reference.encode_ordinary(text)


def test_edge_rows(spark, reference):
    rows = [(1, "", 5), (2, None, 5), (3, " ", 5), (None, "a b", 5), (3, " ", 5), (4, "é" * 3000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df, "doc_id", "text").collect()), key=str)
    assert got == sorted(((d, reference.encode_ordinary(t or "")) for d, t, _ in rows), key=str)
    assert encode_corpus(df.limit(0), "doc_id", "text").collect() == []
    back = decode_corpus(encode_corpus(df, "doc_id", "text"), "doc_id").collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t, _ in rows)
