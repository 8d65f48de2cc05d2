"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Every token of the vocabulary becomes a piece: its bytes mapped to printable characters, one each, scored by the
negative rank, so that sentencepiece's BPE merges the pair of the lowest rank first, as the rank file means it.
Normalisation is the identity and no space is added or escaped. Texts are cut into pre-tokens by the tokenizer's
pattern, each pre-token is encoded on its own, and ids are turned back into bytes by the inverse mapping.

The model's bytes are made on the driver from the vocabulary file (its size is fixed by the file), and broadcast.
Documents are encoded where they lie: no shuffle. A task remembers the ids of pre-tokens it has met,
up to a number and a size.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows are encoded alike; extra
columns are ignored; an empty table gives an empty table; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import bounded_batches, read

#: Pre-tokens whose ids a task keeps, and their characters.
REMEMBERED = 200_000
REMEMBERED_SIZE = 8_000_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it is one, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64, rank) in the order of their ranks."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    """A protocol-buffer field: a varint, or bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece k + 1 is token k; piece 0 is the unknown piece that the format asks for."""
    import struct

    symbol = byte_characters()
    pieces = [_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))]
    for rank, token in enumerate(tokens):
        name = "".join(symbol[b] for b in token).encode()
        pieces.append(_field(1, _field(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, 0)
    off = (1 << 64) - 1
    trainer += b"".join(_field(n, off) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class PieceCodec:
    """Encodes and decodes with a serialised model; pattern cuts a text into pre-tokens."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.encode_piece = sentencepiece.SentencePieceProcessor(model_proto=model).encode
        self.split = regex.compile(pattern).findall
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.symbols = dict(enumerate(byte_characters()))
        inverse = {c: b for b, c in self.symbols.items()}
        self.bytes_of = [bytes(inverse[c] for c in "".join(self.symbols[b] for b in t)) for t in tokens]
        self.known: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def _ids(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        one = self.whole.get(raw)
        if one is not None:
            return (one,)
        return tuple(i - 1 for i in self.encode_piece(raw.decode("latin-1").translate(self.symbols)))

    def encode(self, text: str) -> list[int]:
        pieces, known = self.split(text), self.known
        for p in set(pieces).difference(known):
            known[p] = self._ids(p)
            self.size += len(p)
        ids = list(chain.from_iterable(map(known.__getitem__, pieces)))
        if len(known) > REMEMBERED or self.size > REMEMBERED_SIZE:
            known.clear()
            self.size = 0
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs (doc_id, text); with_ids adds ids and decoded."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tokens = read_ranks(vocabulary)
    shared = spark.sparkContext.broadcast((serialise_model(tokens), tokens))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(*shared.value, pattern)
        decimal = [str(i) for i in range(len(codec.bytes_of))]
        for batch in batches:
            counts, names, sums, every, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "")
                back = codec.decode(ids)
                counts.append(len(ids))
                names.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                sums.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    every.append(ids)
                    texts.append(back.decode(errors="replace"))
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(sums, pa.string())]
            if with_ids:
                out += [pa.array(every, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
