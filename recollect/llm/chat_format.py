"""Chat formatting as one relational plan: group, sort, merge, concatenate.

Turns of a conversation are collected as structs and sorted by
(turn, role, text); repeated ones are dropped and neighbours of one role merged
by array expressions that read every turn once; the result is joined into a
single training string. Spark expressions only, one shuffle on ``conv_id`` of
the turns themselves.

Defined results: rows with a null ``conv_id`` belong to no conversation and
are left out. Rows repeated exactly count once. Ties in ``turn`` order by role, then text. A null
turn sorts first, a null role reads as ``unknown`` and a null text as the empty string. Markers
inside a text or role are broken up (``<|`` becomes ``< |``, in roles also ``|>``) so that no
turn can open another. A conversation without turns cannot occur; an empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, JOIN = "<|{}|>\n", "<|end|>\n", "\n"


def _distinct(turns: Column) -> Column:
    """Sorted turns without repeated ones, which stand beside each other."""
    return F.filter(turns, lambda t, i: (i == 0) | ~t.eqNullSafe(F.get(turns, i - 1)))


def _starts(turns: Column) -> Column:
    """Where the role changes, and the end."""
    at = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return F.concat(at, F.array(F.size(turns)))


def _merge(turns: Column, starts: Column) -> Column:
    """One (role, text) for each run of a role: every turn is read once, whatever the length of the conversation."""

    def message(i: Column) -> Column:
        at, end = F.get(starts, i), F.get(starts, i + 1)
        texts = F.transform(F.slice(turns, at + 1, end - at), lambda t: t["text"])
        return F.struct(F.get(turns, at)["role"].alias("role"), F.array_join(texts, JOIN).alias("text"))

    return F.transform(F.sequence(F.lit(0), F.size(starts) - 2), message)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_messages, n_assistant, text), one row per conversation."""
    clean = F.struct(
        F.col("turn").alias("turn"),
        F.replace(F.replace(F.coalesce("role", F.lit("unknown")), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    grouped = (
        turns.where(F.col("conv_id").isNotNull())
        .select("conv_id", clean.alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("sorted"))
    )
    turns = grouped.select("conv_id", _distinct(F.col("sorted")).alias("turns"))
    runs = turns.select("conv_id", "turns", _starts(F.col("turns")).alias("starts"))
    merged = runs.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), _merge(F.col("turns"), F.col("starts")).alias("m"))
    piece = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n" + CLOSE))
    return merged.select(
        "conv_id",
        "n_turns",
        F.size("m").cast("bigint").alias("n_messages"),
        F.size(F.filter("m", lambda t: t["role"] == "assistant")).cast("bigint").alias("n_assistant"),
        F.array_join(F.transform("m", piece), "").alias("text"),
    )


SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER w AS pos, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS fresh
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), g AS (
  SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS msg FROM o
), m AS (
  SELECT conv_id, msg, first(role) AS role, count(*) AS n,
    '<|' || first(role) || '|>' || chr(10) || string_agg(text, chr(10) ORDER BY pos) || chr(10) || '<|end|>' || chr(10) AS piece
  FROM g GROUP BY conv_id, msg
)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_turns, count(*) AS n_messages,
  count(*) FILTER (role = 'assistant') AS n_assistant, string_agg(piece, '' ORDER BY msg) AS text
FROM m GROUP BY conv_id
"""
