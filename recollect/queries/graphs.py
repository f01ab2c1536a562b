"""Edges, traversal, routed retrieval and store maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators import graph, lexical
from recollect.queries import query
from recollect.queries.aggregates import _TAGS, tags
from recollect.queries.lexicon import TEXT, TOPICS_SQL, bm25_sql, index_of, top_sql
from recollect.runtime import table


def edges(spark, sf):
    """customer -in-> nation -part_of-> region, supplier -in-> nation."""
    name = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    e = lambda d, a, v, b: d.select(a.alias("src"), F.lit(v).alias("verb"), b.alias("dst"))
    parts = [
        e(table(spark, sf, "customer"), name("c", "c_custkey"), "in", name("n", "c_nationkey")),
        e(table(spark, sf, "supplier"), name("s", "s_suppkey"), "in", name("n", "s_nationkey")),
        e(table(spark, sf, "nation"), name("n", "n_nationkey"), "part_of", name("r", "n_regionkey")),
    ]
    return reduce(DataFrame.unionByName, parts)


EDGES = """(SELECT 'c:' || c_custkey AS src, 'in' AS verb, 'n:' || c_nationkey AS dst FROM customer UNION ALL SELECT 's:' || s_suppkey, 'in', 'n:' || s_nationkey FROM supplier
UNION ALL SELECT 'n:' || n_nationkey, 'part_of', 'r:' || n_regionkey FROM nation)"""


@query("edges_out_in", f"SELECT src, verb, dst FROM {EDGES} WHERE src = 'n:3' UNION ALL SELECT src, verb, dst FROM {EDGES} WHERE dst = 'n:3' AND verb = 'in'")
def edges_out_in(spark, sf):
    e = edges(spark, sf)
    return graph.edges_out(e, "n:3").unionByName(graph.edges_in(e, "n:3", "in"))


def _start(spark, *ids):
    return spark.createDataFrame([(i, p) for p, i in enumerate(ids)], "id string, pos bigint")


def walk_sql(step: str, start: tuple[str, ...], depth: int) -> str:
    """A breadth-first walk hop by hop, with the place of every node in the order of visits; ``step`` (a, way, verb, b)."""
    first = ", ".join(f"('{x}', {i})" for i, x in enumerate(start, 1))
    parts = [f"e AS (SELECT * FROM {EDGES}), st AS ({step}), h0 AS (SELECT id, 0 AS hop, CAST(pos AS BIGINT) AS pos FROM (VALUES {first}) t(id, pos)), s0 AS (SELECT * FROM h0)"]
    for k in range(1, depth + 1):
        met = f"SELECT b, min(struct_pack(p := h.pos, w := way, v := verb, n := b)) AS k FROM h{k - 1} h JOIN st ON st.a = h.id WHERE b NOT IN (SELECT id FROM s{k - 1}) GROUP BY b"
        parts.append(f"h{k} AS (SELECT b AS id, {k} AS hop, row_number() OVER (ORDER BY k) + (SELECT count(*) FROM s{k - 1}) AS pos FROM ({met})), s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM h{k})")
    return f"WITH {', '.join(parts)} SELECT id, hop, pos FROM s{depth}"


@query("traverse_depth2", walk_sql("SELECT src AS a, 0 AS way, verb, dst AS b FROM e", ("c:1", "c:2", "s:5"), 2))
def traverse_depth2(spark, sf):
    return graph.traverse(edges(spark, sf), _start(spark, "c:1", "c:2", "s:5"))


@query("traverse_both", walk_sql("SELECT src AS a, 0 AS way, verb, dst AS b FROM e WHERE verb = 'part_of' UNION ALL SELECT dst, 1, verb, src FROM e WHERE verb = 'part_of'", ("n:3",), 3))
def traverse_both(spark, sf):
    return graph.traverse(edges(spark, sf), _start(spark, "n:3"), ("part_of",), "both", 3)


@query("traverse_in", walk_sql("SELECT dst AS a, 1 AS way, verb, src AS b FROM e", ("r:2",), 2))
def traverse_in(spark, sf):
    """Everything that leads to a region, in the order of visits."""
    return graph.traverse(edges(spark, sf), _start(spark, "r:2"), direction="in", limit=1_000_000)


@query("routed_retrieval", f"WITH {bm25_sql(TOPICS_SQL, 'WHERE post.id IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2)')} SELECT id, round(score, 6) AS score, rank FROM {top_sql('bm', 10)}")
def routed_retrieval(spark, sf):
    """Documents that a walk from a region reaches, then BM25 within them."""
    walk = graph.traverse(edges(spark, sf), _start(spark, "r:2"), direction="in", depth=2, limit=None)
    scope = walk.where(F.col("id").startswith("c:")).select(F.substring("id", 3, 20).cast("bigint").alias("id"))
    hits = lexical.best(lexical.score_text(index_of(spark, sf), TEXT, scope), 10)
    return hits.select("id", F.round("score", 6).alias("score"), "rank")


@query("store_graph_nodes", f"SELECT 'store' AS kind, 'store' AS id, CAST(count(*) AS DOUBLE) AS weight FROM documents UNION ALL SELECT 'tag', tag, CAST(count(*) AS DOUBLE) FROM ({_TAGS}) GROUP BY tag UNION ALL SELECT 'trend', event_type, arg_max(value, struct_pack(a := ts, b := event_id)) FROM events GROUP BY event_type UNION ALL SELECT 'collection', lang, CAST(count(*) AS DOUBLE) FROM documents GROUP BY lang")
def store_graph_nodes(spark, sf):
    node = lambda d, kind, i, w: d.select(F.lit(kind).alias("kind"), i.alias("id"), w.cast("double").alias("weight"))
    docs = table(spark, sf, "documents")
    n = F.col("n")
    parts = [
        node(docs.agg(F.count("*").alias("n")), "store", F.lit("store"), n),
        node(tags(spark, sf).groupBy("tag").agg(F.count("*").alias("n")), "tag", F.col("tag"), n),
        node(table(spark, sf, "events").groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("n")), "trend", F.col("event_type"), n),
        node(docs.groupBy("lang").agg(F.count("*").alias("n")), "collection", F.col("lang"), n),
    ]
    return reduce(DataFrame.unionByName, parts)
