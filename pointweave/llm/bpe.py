"""Byte-level BPE encoding and decoding through a serialised sentencepiece model.

The model is written straight from a vocabulary of ranks: every piece is its
token's bytes, each byte mapped to one printable character, and its score is
the negative rank, so that sentencepiece merges in rank order.  Normalisation
is the identity.  Text is cut into pre-tokens by the vocabulary's pattern and
each is encoded by itself; decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame

from pointweave.llm import common
from pointweave.llm.pretokens import PretokenEncoder

VOCABULARY = "byte_bpe_50k.tiktoken"


def byte_characters() -> list[str]:
    """A printable character for each byte, none of them white space."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field in the protocol-buffer wire format."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


#: Fixed values of sentencepiece's model format.
NORMAL, UNKNOWN, MODEL_BPE = 1, 2, 2


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of ``tokens``, whose ids are their ranks.

    The id after the last rank is the unknown piece, which byte-mapped text
    never needs.
    """
    chars = byte_characters()
    out = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(rank)) + _field(3, NORMAL)) for rank, t in enumerate(tokens)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN)))
    trainer = _field(3, MODEL_BPE) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*out, _field(2, trainer), _field(3, normaliser)])


class ByteBPE:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, path: str, pattern: str, most: int = 250_000):
        import sentencepiece

        self.tokens = read_ranks(path)
        if len(self.tokens) > 1 << 16:
            raise ValueError(f"{len(self.tokens)} tokens do not fit 16-bit ids")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.table = {b: c for b, c in enumerate(byte_characters())}
        # A pre-token that is itself a token has that id, even where merging by rank would not reach it.
        mapped = [t.decode("latin-1").translate(self.table) for t in self.tokens]
        self.whole = {m: struct.pack("<H", i) for i, (m, ids) in enumerate(zip(mapped, self.model.encode(mapped), strict=True)) if ids != [i]}
        self.texts = PretokenEncoder(pattern, self._pretoken, most)

    def _pretoken(self, s: str) -> bytes:
        m = s.encode().decode("latin-1").translate(self.table)
        if m in self.whole:
            return self.whole[m]
        ids = self.model.EncodeAsIds(m)
        return struct.pack(f"<{len(ids)}H", *ids)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.texts.encode(text), "<u2").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.cache
def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder for each Python worker, with its caches, for all tasks."""
    return ByteBPE(path, pattern)


common.keeps("bpe", encoder.cache_clear)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode(df: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode ``doc_id, text``; a map without any shuffle.

    Returns ``doc_id, ids array<int>, decoded binary, n_tokens, ids_sha256,
    decoded_sha256``, without the first two payloads if not ``with_ids``, and
    the input's columns ``keep``.  Null and empty texts have no ids and decode
    to nothing; repeated rows and ids, null ids included, stay as they are,
    row by row; other columns of the input are ignored; an empty table gives
    an empty table.
    """
    default = default_vocabulary()
    path, pattern = path or default[0], pattern or default[1]

    def digest(batch) -> dict[str, list]:
        common.turn("bpe")
        bpe, strings = encoder(path, pattern), id_strings()
        out: dict[str, list] = {k: [] for k in ("doc_id", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")}
        out["doc_id"] = batch.column("doc_id")
        out |= {k: batch.column(k) for k in keep}
        for text in batch.column("text").to_pylist():
            ids = bpe.encode(text or "")
            decoded = bpe.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join(map(strings.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            if with_ids:
                out["ids"].append(ids)
                out["decoded"].append(decoded)
        return out

    payload = "ids array<int>, decoded binary, " if with_ids else ""
    kinds = {k: df.schema[k].dataType.simpleString() for k in ("doc_id", *keep)}
    kept = "".join(f", {k} {kinds[k]}" for k in keep)
    return common.map_batches(common.narrow(df, doc_id="doc_id", text="text", **{k: k for k in keep}), digest, f"doc_id {kinds['doc_id']}, {payload}n_tokens bigint, ids_sha256 string, decoded_sha256 string{kept}")


@functools.cache
def id_strings() -> list[str]:
    return [str(i) for i in range(1 << 16)]
