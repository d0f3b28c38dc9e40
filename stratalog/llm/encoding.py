"""Encoding a corpus with a public byte-level BPE vocabulary, through a sentencepiece model serialised from it."""

from __future__ import annotations

import base64
from array import array
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabulary files lie, unless the caller says otherwise.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: how the vocabulary cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept with their ids by one Python worker; the table is emptied when it is full.
KEPT = 300_000
_LONG = 200


@cache
def byte_letters() -> str:
    """One printable letter per byte: printable Latin-1 stands for itself, the others get the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(spare)) for b in range(256))


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of a byte vocabulary: the piece of rank r has id r and score -r, nothing is normalised.

    Ranks must run from 0 without gaps and hold every single byte; the unknown piece that the format requires comes last.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_letters()
    model = pb.ModelProto()
    for number, (piece, rank) in enumerate(sorted(ranks.items(), key=lambda x: x[1])):
        if number != rank:
            raise ValueError(f"rank {number} is missing")
        model.pieces.add(piece="".join(letters[b] for b in piece), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size = pb.TrainerSpec.BPE, len(model.pieces)
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(model.pieces) - 1, -1, -1, -1
    spec.byte_fallback = False
    plain = model.normalizer_spec
    plain.name, plain.precompiled_charsmap = "identity", b""
    plain.add_dummy_prefix = plain.remove_extra_whitespaces = plain.escape_whitespaces = False
    return model.SerializeToString()


class ByteEncoder:
    """Encodes and decodes with the vocabulary of one .tiktoken file."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        with open(path, "rb") as file:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self._find = regex.compile(PATTERN).findall
        self._letters = {i: letter for i, letter in enumerate(byte_letters())}
        self._piece = [piece for piece, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self._kept: dict[str, list[int]] = {}

    def pretokens(self, text: str) -> list[str]:
        return self._find(text)

    def encode(self, text: str) -> list[int]:
        return list(self.encode_all([text])[0])

    def encode_all(self, texts: list[str | None]) -> list[chain]:
        """The ids of each text, as iterables; nothing for null and for empty texts."""
        if len(self._kept) > KEPT:
            self._kept = {}
        kept = self._kept
        cut = [self._find(x) if x else [] for x in texts]
        new = list(set(chain.from_iterable(cut)) - kept.keys())
        if new:
            mapped = [x.encode("utf-8").decode("latin-1").translate(self._letters) for x in new]
            made = dict(zip(new, self._model.encode(mapped, out_type=int, num_threads=1)))
            if any(len(x) > _LONG for x in new):  # long ones serve this call only
                kept.update((k, v) for k, v in made.items() if len(k) <= _LONG)
                kept = {**kept, **{k: v for k, v in made.items() if len(k) > _LONG}}
            else:
                kept.update(made)
        return [chain.from_iterable(map(kept.__getitem__, x)) for x in cut]

    def decode(self, ids) -> str:
        return b"".join(map(self._piece.__getitem__, ids)).decode("utf-8")


@cache
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def _id_arrays(batch_texts: list[str | None], coder: ByteEncoder, rows: int = 500) -> pa.ListArray:
    flat, offsets = array("i"), [0]
    for start in range(0, len(batch_texts), rows):
        for ids in coder.encode_all(batch_texts[start : start + rows]):
            flat.extend(ids)
            offsets.append(len(flat))
    values = np.frombuffer(flat, dtype=np.int32) if flat else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def encode_corpus(df: DataFrame, id_column: str, text: str, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """id and ids (array<int>) of each row's whole text, without special tokens; null and empty texts have an empty list.

    Strings that look like special tokens are ordinary text. Rows stay where they are (no shuffle), repeated rows stay
    repeated, null ids stay null, other columns are ignored. Each distinct pre-token is encoded once per Python worker.
    """
    path = f"{tokenizer_dir}/{vocabulary}.tiktoken"
    schema = T.StructType([df.schema[id_column], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _id_arrays(batch.column(1).to_pylist(), coder)], names=[id_column, "ids"])

    return df.select(id_column, text).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, id_column: str, ids: str = "ids", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """id and text of each list of ids, by inverse mapping; an empty list is the empty text, null stays null."""
    path = f"{tokenizer_dir}/{vocabulary}.tiktoken"
    schema = T.StructType([df.schema[id_column], T.StructField("text", T.StringType())])

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return df.select(id_column, ids).mapInArrow(run, schema)
