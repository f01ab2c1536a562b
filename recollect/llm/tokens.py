"""Exact token counts of a public byte-level BPE vocabulary.

The vocabulary's path is a parameter; its ranks (under 1 MB) travel with the
task. A BPE merge never crosses a pre-token, and a blank that precedes a
non-blank always opens one, so a text's count is the sum over the pieces
between such blanks. Pieces repeat, so each worker keeps a bounded table of
their counts; the sum is exact and several times faster than encoding.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.memory import tidy

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_PIECES = 1 << 19


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter(dict):
    """piece -> tokens, in two generations of at most ``MOST_PIECES`` pieces each."""

    def __init__(self, vocabulary: bytes):
        super().__init__()
        self.encode = _encoding(vocabulary).encode_ordinary
        self.older: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        if len(self) >= MOST_PIECES:
            self.older = dict(self)
            self.clear()
        n = self.older.get(piece)
        if n is None:
            if piece[-1] in ",." and len(piece) > 1 and piece[-2].isalpha():
                n = self[piece[:-1]] + 1  # a mark after a letter is a pre-token and a token of its own
            else:
                n = len(self.encode(" " + piece))
        if len(piece) < 64:
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        first, *rest = text.split(" ")
        if "  " in text or text[-1] == " " or any(x[0].isspace() for x in rest):
            # a piece that is empty or opens with white space belongs to the one before it
            held = [first]
            for x in rest:
                if not x or x[0].isspace():
                    held[-1] += " " + x
                else:
                    held.append(x)
            first, *rest = held
        return (len(self.encode(first)) if first else 0) + sum(map(self.__getitem__, rest))


@lru_cache(maxsize=2)
def _counter(vocabulary: bytes) -> Counter:
    return Counter(vocabulary)


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def with_counts(df: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``df`` without ``text`` and with its token count; a null or empty text counts 0."""
    raw = read_vocabulary(vocabulary)
    kept = [c for c in df.columns if c not in (text, name)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(raw)
        for b in batches:
            n = [counter.count(x) for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(n, pa.int64())], names=[*kept, name])

    return df.select(*(F.col(f"`{c}`") for c in (*kept, text))).mapInArrow(tidy(run), schema)


def seeded(seed: int, *columns: str | Column) -> Column:
    """A 64-bit hash that orders rows in a way the seed alone decides."""
    return F.xxhash64(F.lit(seed).cast("bigint"), *columns)
