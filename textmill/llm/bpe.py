"""Operator 6: byte-level BPE by a sentencepiece model that is serialised from a rank vocabulary.

Each token of the vocabulary becomes a piece, its bytes mapped one to one to printable characters
and its score the negative rank, so that sentencepiece merges in the order of the ranks.
Normalisation is the identity. Text is cut into pre-tokens by the vocabulary's pattern; each is
encoded by itself, and decoding maps ids to bytes by the inverse table.

Defined cases: a null text counts as empty and has no ids; rows with a null or repeated doc_id are
encoded like any others, one row out for each row in; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textmill.llm import common
from textmill.llm.secrets import default_vocabulary

#: Distinct chunks that a worker remembers, and their characters; beyond that it starts anew. Longer chunks are not kept.
CACHE, CACHE_CHARS, LONG_CHUNK = 150_000, 8_000_000, 1000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number: int, value: bytes | int) -> bytes:
    """A protobuf field, length-delimited or varint."""
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: a piece for each rank in order, then the unknown piece that the format demands."""
    chars = byte_characters()
    pieces = [b""] * len(ranks)
    for token, rank in ranks.items():
        text = "".join(chars[b] for b in token).encode()
        pieces[rank] = field(1, text) + varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
    unknown = field(1, b"<unk>") + field(3, 2)
    trainer = field(3, 2) + field(4, len(ranks) + 1) + field(40, len(ranks)) + field(41, (1 << 64) - 1) + field(42, (1 << 64) - 1) + field(43, (1 << 64) - 1)
    identity = field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(field(1, p) for p in [*pieces, unknown]) + field(2, trainer) + field(3, identity)


#: What white space means in the rank libraries' patterns: Unicode White_Space. Fixed values.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of other characters with the space before it, or white space. No pre-token of the patterns that
#: cuttable() accepts crosses the ends of such a chunk, so a chunk's pre-tokens do not depend on the rest.
CHUNK = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def cuttable(pattern: str) -> bool:
    """Whether pattern is the common one: alternatives without white space but a leading optional space, then white space."""
    return pattern.endswith(r"|\s+(?!\S)|\s+") and not re.search(r"\\[sSbB]|[(.^$*]", pattern.removesuffix(r"|\s+(?!\S)|\s+").replace(r"[^\s", ""))


def laid(parts: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """parts end to end, and where each begins (one more entry at the end)."""
    return np.frombuffer(b"".join(parts), kind), np.cumsum([0, *map(len, parts)]) // np.dtype(kind).itemsize


def gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen parts end to end, and the end of each."""
    size = at[which + 1] - at[which]
    ends = np.cumsum(size)
    return flat[np.repeat(at[which] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


class Codec:
    """Encodes and decodes with one vocabulary; kept for the life of a Python worker."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError(f"the ranks in {path} are not 0 to {len(ranks) - 1}")
        self.ranks, self.known, self.chars = ranks, {}, 0
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.bytes = laid(self.tokens, np.uint8)
        self.names = laid([b"%d " % k for k in range(len(ranks))], np.uint8)
        exact = regex.compile(re.sub(r"\\s(?![^\[]*\])|\\S", lambda m: f"[{'^' * (m[0] == chr(92) + 'S')}{SPACES}]", pattern).replace(r"\s", SPACES))
        self.pre_tokens = exact.findall
        self.split = CHUNK.findall if cuttable(pattern) else self.pre_tokens
        self.table = dict(enumerate(byte_characters()))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))

    def pieces(self, parts: list[str]) -> list[list[int]]:
        """The ids of each chunk: of its pre-tokens, encoded one by one."""
        cut = [self.pre_tokens(x) for x in parts]
        new = list(set().union(*cut))
        ids = dict(zip(new, self.encoded(new), strict=True))
        return [[k for x in pre for k in ids[x]] for pre in cut]

    def encoded(self, parts: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        raw = [x.encode("utf-8", "surrogatepass") for x in parts]
        found = self.model.encode([x.decode("latin-1").translate(self.table) for x in raw], num_threads=1)
        return [[whole] if (whole := self.ranks.get(x)) is not None else ids for x, ids in zip(raw, found, strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has."""
        parts = [self.split(x) for x in texts]
        if len(self.known) > CACHE or self.chars > CACHE_CHARS:
            self.known.clear()
            self.chars = 0
        if new := [x for x in set().union(*parts) if x not in self.known]:
            self.known |= zip(new, (np.array(x, np.int32).tobytes() for x in self.pieces(new)), strict=True)
        known = self.known.__getitem__
        ids = [b"".join(map(known, x)) for x in parts]
        for x in new:
            if len(x) > LONG_CHUNK:
                del self.known[x]
            else:
                self.chars += len(x)
        return np.frombuffer(b"".join(ids), np.int32), np.array([len(x) // 4 for x in ids], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(*self.bytes, ids)[0].tobytes()

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        return gather(*self.names, ids)[0].tobytes()[:-1]


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), n_tokens, and ids_sha256 and decoded_sha256, digests of the ids and of the decoded bytes."""
    own = default_vocabulary() if vocabulary is None else (vocabulary, pattern)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(*own)
        ids, n = c.encode([x or "" for x in batch.column("text").to_pylist()])
        at = np.concatenate([[0], np.cumsum(n)])
        each = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        sha, back = ([hashlib.sha256(f(x)).hexdigest() for x in each] for f in (c.listed, c.decode))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
        cols = [batch.column("doc_id"), lists, pa.array(n), pa.array(sha, pa.string()), pa.array(back, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    doc_id = dict(docs.dtypes)["doc_id"]
    return common.by_batch(docs.select("doc_id", "text"), encode, f"doc_id {doc_id}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(common.read(spark, sf_dir, "documents")).drop("ids")
