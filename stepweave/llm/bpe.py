"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Each token's bytes become characters, one a byte (printable ones stand for themselves, the others for code points from 256 on), and are
a piece scored by its negative rank; normalisation is identity, so sentencepiece's merges of the best score are BPE's merges
of the least rank. A text is split by the pattern first, and each match is encoded separately; ids come back through a table
from piece to rank. Tokens that merges alone do not reach are found by encoding the vocabulary once, and a match that is
such a token is taken whole, as rank-file encoders do. Decoding joins the bytes of the ids.

Null texts count as empty: no ids. Matches met before are looked up in a store of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from stepweave.llm.shared import clear_names, text_batches

#: Matches that a worker remembers.
REMEMBERED = 300_000
#: Longer matches are not remembered.
LONGEST = 64


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol-buffer message: bytes, a whole number or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value)


def byte_characters() -> list[str]:
    """A visible character for each byte, none of them white space."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    table = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model of type BPE: piece 0 is unknown, piece i + 1 the token of rank i."""
    characters = byte_characters()
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    pieces = _field(1, unknown) + b"".join(
        _field(1, _field(1, "".join(characters[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, token in enumerate(tokens) if token
    )
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes matches of the pattern and decodes ids."""

    def __init__(self, path: str, pattern: str) -> None:
        self.tokens = read_ranks(path)
        self.ranks = np.array([(1 << 32) - 1, *[r for r, t in enumerate(self.tokens) if t]], dtype=np.uint32)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.pattern = regex.compile(pattern)
        self.characters = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}
        own = [t for t in self.tokens if t]
        spelt = self.processor.encode([self._spell(t) for t in own], num_threads=1)
        #: Tokens that their own merges don't reach.
        self.whole = {t: self.ranks[i + 1 : i + 2].tobytes() for i, (t, ids) in enumerate(zip(own, spelt, strict=True)) if ids != [i + 1]}

    def _spell(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self.characters)

    def _encode_matches(self, matches: list[str]) -> None:
        raw = [m.encode() for m in matches]
        for match, r, ids in zip(matches, raw, self.processor.encode([self._spell(r) for r in raw], num_threads=1), strict=True):
            self.known[match] = self.whole.get(r) or self.ranks[ids].tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        matches = self.pattern.findall(text)
        known = self.known
        new = [m for m in set(matches) if m not in known]
        if new:
            self._encode_matches(new)
        out = b"".join([known[m] for m in matches])
        for m in new:
            if len(m) > LONGEST:
                del known[m]
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> its other columns, n_tokens, ids_sha256, decoded_sha256; ids as array<int> and the
    decoded bytes as `decoded` if asked for. A column of docs with one of these names is renamed by trailing `_`.

    Null texts count as empty: no ids. Repeated rows each give a row. An empty table gives an empty one."""
    text_batches(docs.sparkSession)
    added = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    added += [StructField("ids", ArrayType(IntegerType()))] * with_ids + [StructField("decoded", BinaryType())] * with_text
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.col("text").cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)])
    schema = StructType([*packed.schema.fields[1:], *added])
    arrow = to_arrow_schema(schema)

    def rows(batches):
        own = codec(path, pattern)
        for batch in batches:
            found = [own.encode(t or "") for t in batch.column(0).to_pylist()]
            back = [own.decode(x) for x in found]
            columns = [batch.column(i) for i in range(1, batch.num_columns)]
            columns += [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in found], pa.list_(pa.int32())))
            if with_text:
                columns.append(pa.array(back, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    out = packed.mapInArrow(rows, schema)
    names = [f.name for f in added]
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(clear_names(others, names))], *names)
