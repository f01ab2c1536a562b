"""Embedders. The built-in one hashes content tokens; models plug in behind the same two calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import content_tokens
from recollect.operators.lexical import counts, slices

DIM = 384


class Embedder(Protocol):
    """(id, text) -> (id, vec), for documents and for queries apart, because models treat them apart."""

    def documents(self, texts: DataFrame) -> DataFrame: ...

    def queries(self, texts: DataFrame) -> DataFrame: ...


def _sums(row: np.ndarray, bucket: np.ndarray, n: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, sum of n) by (row, bucket)."""
    key, at = np.unique(row * dim + bucket, return_inverse=True)
    return key // dim, key % dim, np.bincount(at, n, len(key))


def hashed_terms(texts: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, bucket, weight): signed feature hashes of content tokens, normalised; the sparse form of the embedding.

    A row's tokens are summed where it is; only its sums, one row, move to those of the same id.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in slices(batches, 1):
            row, code, n, words, _ = counts(p)
            h = np.array([int(md5(w.encode()).hexdigest()[:15], 16) for w in words.to_pylist()], np.int64)  # portable_hash
            row, bucket, w = _sums(row, (h % dim)[code], np.where(h // dim % 2 == 0, 1, -1)[code] * n, dim)
            ends = pa.array(np.searchsorted(row, np.arange(p.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (bucket.astype(small), w.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([p.column(0), *lists], names=["id", "bs", "ws"])

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in slices(batches, 1):
            sizes = pc.list_value_length(p.column(1)).to_numpy()
            bs, ws = (p.column(i).flatten().to_numpy().astype(np.int64) for i in (1, 2))
            row, bucket, w = _sums(np.repeat(np.arange(p.num_rows), sizes), bs, ws, dim)
            norm = np.sqrt(np.bincount(row, w * w, p.num_rows))[row]
            weight = np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0)
            yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(row)), pa.array(bucket), pa.array(weight)], names=["id", "bucket", "weight"])

    kind, small = texts.schema["id"].dataType.simpleString(), "int16" if dim <= 1 << 15 else "int32"
    tokens = texts.where("id is not null").select("id", content_tokens(F.coalesce("text", F.lit(""))).alias("ts"))
    each = tokens.mapInArrow(sums, f"id {kind}, bs array<{'smallint' if small == 'int16' else 'int'}>, ws array<int>").where(F.size("bs") > 0)
    whole = each.groupBy("id").agg(F.flatten(F.collect_list("bs")).alias("bs"), F.flatten(F.collect_list("ws")).alias("ws"))
    return whole.mapInArrow(norms, f"id {kind}, bucket bigint, weight double")


class HashEmbedder:
    def __init__(self, dim: int = DIM):
        self.dim = dim

    def documents(self, texts: DataFrame) -> DataFrame:
        terms = hashed_terms(texts, self.dim).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
        all_ = texts.select("id").distinct().join(terms, "id", "left")
        at = F.sequence(F.lit(0).cast("bigint"), F.lit(self.dim - 1).cast("bigint"))
        return all_.select("id", F.transform(at, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")).alias("vec"))

    queries = documents


class ModelEmbedder:
    """Any function from texts to vectors, run on Arrow batches; ``instruction`` goes before queries only."""

    def __init__(self, encode: Callable[[list[str]], list[list[float]]], instruction: str = ""):
        self.encode, self.instruction = encode, instruction

    def _run(self, texts: DataFrame, before: str) -> DataFrame:
        encode, kind = self.encode, texts.schema["id"].dataType.simpleString()

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield pd.DataFrame({"id": p["id"], "vec": list(encode([before + (t or "") for t in p["text"]]))})

        return texts.select("id", "text").mapInPandas(run, f"id {kind}, vec array<float>")

    def documents(self, texts: DataFrame) -> DataFrame:
        return self._run(texts, "")

    def queries(self, texts: DataFrame) -> DataFrame:
        return self._run(texts, self.instruction)
