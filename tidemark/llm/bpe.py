"""Operator 10, byte-level BPE encoding and decoding by monoid tree reduction.

A text's encoding is a monoid element (bytes, token ids). Texts are halved until a leaf of 256 characters, leaves
are encoded by the rank table, and neighbours are joined: a window around the seam grows, in doubling
steps on both sides, until it starts and ends at a place that parts the text whatever stands around it. Such
places are those where a non-space character meets a plain space (no match of the split pattern holds
these two), and those between a letter, a number and any other visible character, apostrophes apart (a
match holds one of these classes, behind an optional space; only contractions mix them). The pattern never looks behind,
so the tokens outside the window are those of the joined text, and only the window is encoded again. Inside
one long run of letters, of numbers or of other characters there is no such place: it is one match of the pattern, whose tokens
depend on all of it, and the window becomes that run.

Decoding looks ids up in leaves of fixed length and concatenates up the same kind of tree.

Each row is encoded on its own: no shuffle, no state beyond the rank table (a fixed file, loaded once
a worker), and batches leave in bounded pieces.

Defined results: a null text encodes as the empty text, to no ids; null ids decode to no bytes;
repeated rows give repeated results; other columns ride along, an older column of the output's name
is replaced.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, ship

RANKS = "byte_bpe_50k.tiktoken"
LEAF_CHARS = 1 << 8
LEAF_IDS = 1 << 14
OUT_BYTES = 8 << 20
_SPACES = " \n\t\r"


class Codec:
    """Encoder and decoder for one rank table; all bytes of a text come back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_CHARS):
        import tiktoken

        self.table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        self._leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.leaf = leaf

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self._leaf(text)
        mid = len(text) // 2
        left, right = text[:mid], text[mid:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """The ids of left + right from those of each."""
        i, j = _last_seam(left), _first_seam(right)
        keep = self._tokens(reversed(a), len(left[i:].encode()))
        skip = self._tokens(b, len(right[:j].encode()))
        return a[: len(a) - keep] + self._leaf(left[i:] + right[:j]) + b[skip:]

    def _tokens(self, ids, n_bytes: int) -> int:
        """How many of ids make up n_bytes."""
        n, table = 0, self.table
        for t in ids:
            if n_bytes <= 0:
                break
            n_bytes -= len(table[t])
            n += 1
        if n_bytes:
            raise ValueError("a seam fell inside a token: the rank table doesn't fit the pattern")
        return n

    def decode(self, ids: list[int], leaf: int = LEAF_IDS) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.table.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


@lru_cache(maxsize=1 << 16)
def _class(c: str) -> str:
    """L, N or O (other visible characters); none for spaces, controls, apostrophes, and characters whose category has changed
    or come since Unicode 3.2, for libraries differ in them."""
    now = unicodedata.category(c)
    if c == "'" or now != unicodedata.ucd_3_2_0.category(c) or now[0] in "ZC":
        return ""
    return now[0] if now[0] in "LN" else "O"


def _is_seam(before: str, at: str) -> bool:
    if at in _SPACES:
        return before.isprintable() and not before.isspace()
    a, b = _class(before), _class(at)
    return a != b and a != "" and b != ""


def _last_seam(s: str) -> int:
    """Start of the shortest tail, grown by doubling, that begins at a seam; 0 without one."""
    grown, done = 32, len(s)
    while done > 0:
        low = max(0, len(s) - grown)
        for i in range(done - 1, max(low, 1) - 1, -1):
            if _is_seam(s[i - 1], s[i]):
                return i
        done, grown = low, grown * 2
    return 0


def _first_seam(s: str) -> int:
    """End of the shortest head, grown by doubling, that ends at a seam; the whole without one."""
    grown, done = 32, 1
    while done < len(s):
        high = min(len(s), grown)
        for i in range(done, high):
            if _is_seam(s[i - 1], s[i]):
                return i
        done, grown = max(high, done + 1), grown * 2
    return len(s)


@lru_cache(maxsize=4)
def codec(ranks_file: str = RANKS, leaf: int = LEAF_CHARS) -> Codec:
    """The codec of a public rank file by name, or of any rank file by path."""
    import public_tokenizers

    path = ranks_file if "/" in ranks_file else public_tokenizers.path(ranks_file)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(i) for token, i in (line.split() for line in f if line.strip())}
    return Codec(ranks, public_tokenizers.PATTERN, leaf)


def _map(df: DataFrame, column: str, to: str, fn) -> DataFrame:
    """df with the binary column `to`, fn of each value of `column`, in pieces of bounded size."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c != to]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = fn()
        for batch in batches:
            start, size, out = 0, 0, []
            for k, value in enumerate(batch.column(batch.schema.get_field_index(column))):
                out.append(one(value.as_py()))
                size += len(out[-1]) + len(value.as_py() or "")
                if size >= OUT_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(start, len(out)).select(kept)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*kept, to])
                    start, size, out = k + 1, 0, []

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks_file: str = RANKS, leaf: int = LEAF_CHARS) -> DataFrame:
    """df plus the ids of its texts, packed as little-endian unsigned 32-bit integers."""

    def fn():
        import numpy as np

        c = codec(ranks_file, leaf)
        return lambda t: np.asarray(c.encode(t or ""), dtype="<u4").tobytes()

    return _map(df, text, ids, fn)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", ranks_file: str = RANKS) -> DataFrame:
    """df plus the bytes that its packed ids stand for."""

    def fn():
        import numpy as np

        c = codec(ranks_file)
        return lambda b: c.decode(np.frombuffer(b or b"", dtype="<u4").tolist())

    return _map(df, ids, decoded, fn)


def digests(df: DataFrame) -> DataFrame:
    """doc_id and the digests of ids and of what they decode to; the text goes no further than the encoder."""
    ids = encode(df.select("doc_id", "text")).select("doc_id", "ids")
    both = decode(ids)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
