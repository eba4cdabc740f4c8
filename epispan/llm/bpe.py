"""Byte-level BPE by a sentencepiece model that is serialised directly from a vocabulary of ranks.

Every byte becomes one letter of a private alphabet, every rank a piece whose score is the negative rank, normalisation is
the identity. Sentencepiece then merges the neighbours with the best score, leftmost first: the merges of the rank file. A
pre-token that is a vocabulary entry is taken whole, as the public library does. Decoding maps letters back to bytes.

Defined results: null text encodes like an empty one, to no ids; rows are never joined, so ids may repeat or be null.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispan.llm.common import emptied
from epispan.llm.pretokens import PieceEncoder, simple_tokens

#: The private alphabet: byte b is the letter U+0100 + b. None of them is white space to sentencepiece.
ALPHABET = "".join(chr(0x100 + b) for b in range(256))

#: Field numbers and codes of a serialised sentencepiece model.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TYPE_NORMAL, TYPE_UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 4, 40, 41, 42, 43
MODEL_BPE = 2
NORMALIZER_NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def varint(value: int) -> bytes:
    value &= 2**64 - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def number(field: int, value: int) -> bytes:
    return varint(field << 3) + varint(value)


def message(field: int, body: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(body)) + body


def piece(text: str, score: float, kind: int) -> bytes:
    body = message(PIECE_TEXT, text.encode()) + varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", score)
    return message(PIECES, body + number(PIECE_TYPE, kind))


def letters(data: bytes) -> str:
    return codecs.charmap_decode(data, "strict", ALPHABET)[0]


def serialized_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece ids are the places of the ranks in order, then one unknown piece."""
    ordered = sorted(ranks.items(), key=lambda item: item[1])
    out = [piece(letters(token), -float(rank), TYPE_NORMAL) for token, rank in ordered]
    out.append(piece("<unk>", 0.0, TYPE_UNKNOWN))
    trainer = number(MODEL_TYPE, MODEL_BPE) + number(VOCAB_SIZE, len(out)) + number(UNK_ID, len(out) - 1)
    trainer += number(BOS_ID, -1) + number(EOS_ID, -1) + number(PAD_ID, -1)
    identity = message(NORMALIZER_NAME, b"identity")
    identity += number(ADD_DUMMY_PREFIX, 0) + number(REMOVE_EXTRA_SPACES, 0) + number(ESCAPE_SPACES, 0)
    return b"".join(out) + message(TRAINER, trainer) + message(NORMALIZER, identity)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialized_model(ranks))
        ordered = sorted(ranks.values())
        self.tokens = {rank: self.back(self.model.id_to_piece(k)) for k, rank in enumerate(ordered)}
        self.id_bytes = [struct.pack("<I", rank) for rank in ordered]
        self.pieces = PieceEncoder(self.split, self.encode_tokens)

    @staticmethod
    def back(text: str) -> bytes:
        return bytes(ord(c) - 0x100 for c in text)

    def split(self, piece: str) -> list[str]:
        return simple_tokens(piece) or self.pattern.findall(piece)

    def encode_tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens, little-endian 32-bit: those outside the vocabulary go to the model together."""
        whole = [self.ranks.get(token.encode()) for token in tokens]
        parts = iter(self.model.encode([letters(t.encode()) for t, rank in zip(tokens, whole, strict=True) if rank is None], num_threads=1))
        own = self.id_bytes
        return [b"".join([own[k] for k in next(parts)]) if rank is None else struct.pack("<I", rank) for rank in whole]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.pieces.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


CODECS: dict[str, Codec] = {}


def codec(shared: Broadcast) -> Codec:
    """The codec of a worker process, built once per vocabulary."""
    key, ranks, pattern = shared.value
    if key not in CODECS:
        CODECS.clear()
        CODECS[key] = Codec(ranks, pattern)
    return CODECS[key]


def shipped(frame: DataFrame, ranks: dict[bytes, int], pattern: str) -> Broadcast:
    """The vocabulary for all workers, with a digest to know it by."""
    digest = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return frame.sparkSession.sparkContext.broadcast((digest, ranks, pattern))


def default_vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def encode(docs: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str | None = None) -> DataFrame:
    """Per row of ``docs``: ``source_row`` (all its columns) and ``ids``, little-endian 32-bit, of the whole text."""
    if ranks is None:
        ranks, pattern = default_vocabulary()
    shared = shipped(docs, ranks, pattern)

    @F.pandas_udf("binary")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(shared)
        found = (pd.Series(own.encode([t or "" for t in text]), dtype=object) for text in batches)
        yield from emptied(found, own.pieces.known)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("source_row"))
    return rows.withColumn("ids", ids_of("source_row.text"))


def decode(encoded: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for."""
    if ranks is None:
        ranks, pattern = default_vocabulary()
    shared = shipped(encoded, ranks, pattern)

    @F.pandas_udf("binary")
    def bytes_of(ids: pd.Series) -> pd.Series:
        own = codec(shared)
        return pd.Series([own.decode(bytes(i)) for i in ids], dtype=object)

    return encoded.withColumn("decoded", bytes_of("ids"))


def digest(encoded: DataFrame, *more: str) -> DataFrame:
    """Counts and hashes of ids and of the decoded bytes; ``more`` names further columns of the source row, or ``ids``."""
    extra = [F.col(c) if c == "ids" else F.col(f"source_row.`{c}`").alias(c) for c in more]
    return decode(encoded).select(
        F.col("source_row.doc_id").alias("doc_id"),
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *extra,
    )
