"""Rows of a document table by their identity: an id and the hash of a text.

A row without an id gets one from its text that comes after all real ones, so
operators that choose rows can also choose those. Rows that repeat an id and a
text are the same row; where one of them is to stay, they are folded before
they move, so that a row repeated a million times costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_ID = 1 << 62


def identity(text: str = "text") -> tuple[Column, Column]:
    """(id, hash of the text)."""
    h = F.xxhash64(text)
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID) + h.bitwiseAND(NULL_ID - 1)), h


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs``, with all its columns, for each distinct (id, h) of ``kept``."""
    one, two = identity()
    a, b, row = (free(docs, x) for x in ("row_id", "row_hash", "row"))
    everything = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    folded = docs.withColumns({a: one, b: two}).groupBy(a, b).agg(F.first(everything).alias(row))
    names = kept.select(F.col("id").alias(a), F.col("h").alias(b)).distinct()
    return folded.join(names, [a, b], "left_semi").select(f"{row}.*")
