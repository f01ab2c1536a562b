"""Edges (src, verb, dst) and breadth-first traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.runtime import cut

DEPTH, LIMIT = 2, 10_000


def edges_out(edges: DataFrame, anchor: str, verb: str | None = None) -> DataFrame:
    found = edges.where(F.col("src") == anchor)
    return (found if verb is None else found.where(F.col("verb") == verb)).orderBy("verb", "dst")


def edges_in(edges: DataFrame, anchor: str, verb: str | None = None) -> DataFrame:
    found = edges.where(F.col("dst") == anchor)
    return (found if verb is None else found.where(F.col("verb") == verb)).orderBy("verb", "src")


def traverse(edges: DataFrame, start: DataFrame, verbs: tuple[str, ...] = (), direction: str = "out", depth: int = DEPTH, limit: int | None = LIMIT) -> DataFrame:
    """(id, hop, pos): nodes in the order a breadth-first walk visits them, at most ``limit`` of them.

    ``start`` (id, pos). Within a hop: by the parent's position, out edges before
    in edges, then verb, then neighbour. Without a limit (None) nothing needs a
    global order, ``pos`` is null and every hop stays distributed. One join a hop, cut by a checkpoint;
    only a count comes back to the driver.
    """
    use = edges.where(F.col("verb").isin(*verbs)) if verbs else edges
    steps = []
    if direction in ("out", "both"):
        steps.append(use.select(F.col("src").alias("at"), F.lit(0).alias("way"), "verb", F.col("dst").alias("next")))
    if direction in ("in", "both"):
        steps.append(use.select(F.col("dst").alias("at"), F.lit(1).alias("way"), "verb", F.col("src").alias("next")))
    step = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    first = start.groupBy("id").agg(F.min("pos").alias("pos"))
    if limit is None:
        return _reach(step, first, depth)
    seen = cut(first.select("id", F.lit(0).alias("hop"), F.row_number().over(Window.orderBy("pos")).cast("bigint").alias("pos")).where(F.col("pos") <= limit))
    frontier, total = seen, seen.count()
    for hop in range(1, depth + 1):
        if total >= limit:
            break
        key = F.struct(F.col("pos"), "way", "verb", "next")
        met = frontier.join(step, frontier["id"] == step["at"]).select(F.col("next").alias("id"), key.alias("key")).groupBy("id").agg(F.min("key").alias("key"))
        fresh = met.join(seen.select("id"), "id", "left_anti")
        # only a walk's limit needs the order, and it never lets more than limit rows through
        ranked = fresh.orderBy("key").limit(limit - total)
        frontier = cut(ranked.select("id", F.lit(hop).alias("hop"), (F.row_number().over(Window.orderBy("key")) + total).cast("bigint").alias("pos")))
        got = frontier.count()
        if not got:
            break
        total += got
        seen = seen.unionByName(frontier)
    return seen


def _reach(step: DataFrame, first: DataFrame, depth: int) -> DataFrame:
    none = F.lit(None).cast("bigint").alias("pos")
    seen = cut(first.select("id", F.lit(0).alias("hop"), none))
    frontier = seen
    for hop in range(1, depth + 1):
        met = frontier.join(step, frontier["id"] == step["at"]).select(F.col("next").alias("id")).distinct()
        frontier = cut(met.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), none))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def to_dot(nodes: list[tuple[str, str]], links: list[tuple[str, str, str]], name: str = "map") -> str:
    """Graphviz text of a small graph: nodes (id, kind), links (src, label, dst)."""
    colour = {"query": "gold", "stage": "lightblue", "candidate": "palegreen", "verdict": "salmon", "store": "gray80", "tag": "plum", "shape": "khaki", "trend": "lightcyan"}
    q = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"  {q(i)} [style=filled, fillcolor={q(colour.get(k, 'white'))}];" for i, k in nodes]
    lines += [f"  {q(a)} -> {q(b)} [label={q(v)}];" for a, v, b in links]
    return f"digraph {q(name)} {{\n" + "\n".join(lines) + "\n}\n"
