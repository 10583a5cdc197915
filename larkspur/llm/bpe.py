"""Byte-level BPE: a sentencepiece model serialised straight from a rank vocabulary; encoding of pre-tokens, decoding.

The model's pieces are the vocabulary's byte strings, each byte mapped to a printable character, scored by negative
rank, so that sentencepiece's highest-scored merge is the lowest rank. Normalisation is the identity.

Defined cases: a null text is the empty text; an empty text has no ids, and both digests are those of no bytes; a
pre-token of any length is encoded whole; repeated rows give repeated results; other columns of the input are kept
out of the result, so their names don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import fold, remembers

#: Distinct pre-tokens whose ids a worker remembers; a full memory is emptied and filled anew.
MEMORY = 500_000
#: Characters of the pre-tokens that a worker remembers.
MEMORY_CHARS = 10_000_000

#: A pattern whose commonest alternative comes late, and one that matches alike but tries that one first.
FASTER = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": r""" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
}
UNKNOWN = ""


def byte_characters() -> list[str]:
    """The printable character of each byte: Latin-1's where printable and not a space, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank; ranks must be 0, 1, 2 and so on."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be consecutive from 0")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto of type BPE; piece i is token i, and the unknown piece comes last."""
    chars = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, UNKNOWN.encode()) + b"\x15" + struct.pack("<f", -float(len(tokens))) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43)) + _field(45, UNKNOWN.encode())
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Coder:
    """Encodes and decodes with one model."""

    def __init__(self, model: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(FASTER.get(pattern, pattern)).findall
        self.known: dict[str, bytes] = {}
        self.held = 0  # characters of known
        self.table = dict(enumerate(byte_characters()))
        inverse = {c: b for b, c in enumerate(byte_characters())}
        n = self.model.get_piece_size() - 1
        self.bytes_of = [bytes(inverse[c] for c in self.model.id_to_piece(i)) for i in range(n)]
        self.digits_of = [str(i) for i in range(n)]

    def learn(self, tokens: set[str]) -> None:
        """Encodes pre-tokens that the worker hasn't met."""
        fresh = list(tokens.difference(self.known))
        size = sum(map(len, fresh))
        if len(self.known) + len(fresh) > MEMORY or self.held + size > MEMORY_CHARS:
            self.known.clear()
            fresh = list(tokens)
            self.held, size = 0, sum(map(len, fresh))
        self.held += size
        for i in range(0, len(fresh), 20_000):
            some = fresh[i : i + 20_000]
            found = self.model.encode([p.encode().decode("latin-1").translate(self.table) for p in some], num_threads=1)
            self.known.update(zip(some, [struct.pack(f"<{len(x)}I", *x) for x in found]))

    def encode(self, texts: list[str]) -> list[list[int]]:
        words = list(map(self.split, texts))
        self.learn(set().union(*words))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, x)), "<u4").tolist() for x in words]

    def digits(self, ids: list[int]) -> str:
        """The ids in decimal, joined by one space."""
        return " ".join(map(self.digits_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODERS: dict[tuple[bytes, str], Coder] = {}


def coder(model: bytes, pattern: str) -> Coder:
    """One coder a worker process and model."""
    key = (hashlib.sha256(model).digest(), pattern)
    if key not in _CODERS:
        _CODERS[key] = Coder(model, pattern)
    return _CODERS[key]


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Rows (key, n_tokens, ids array<int>, decoded binary), or with digests (key, n_tokens, ids_sha256, decoded_sha256).

    The vocabulary is read on the driver, where path is; the model of some MB goes to the workers by broadcast, a size
    that the vocabulary file fixes. No shuffle. decoded is what decoding the ids gives, not the text itself.
    """
    model = df.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(path)))
    kind = df.schema[key].dataType.simpleString()
    last = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("bpe", _CODERS.clear)
        c = coder(model.value, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in fold(texts, len, 500_000):
                ids = c.encode(texts[i:j])
                whole = map(c.decode, ids)
                counts = pa.array(list(map(len, ids)), pa.int64())
                if digests:
                    rest = [pa.array([hashlib.sha256(x).hexdigest() for x in part], pa.string()) for part in ((c.digits(x).encode() for x in ids), whole)]
                else:
                    rest = [pa.array(ids, pa.list_(pa.int32())), pa.array(list(whole), pa.binary())]
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), counts, *rest], names=["k", "n", "a", "b"])

    out = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return out.mapInArrow(run, f"`{key}` {kind}, n_tokens long, {last}")
