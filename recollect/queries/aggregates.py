"""Counts, facets, tags, trends and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import values
from recollect.operators import strategies
from recollect.plans import filters as f
from recollect.queries import query
from recollect.queries.filters import DOCS, events_md
from recollect.runtime import table


@query("count_where", "SELECT count(*) AS n FROM documents WHERE lang = 'en' AND n_chars >= 1000")
def count_where(spark, sf):
    cond = f.Filter(must=(f.Eq("lang", "en"), f.Range("n_chars", gte=1000)))
    return table(spark, sf, "documents").where(f.compile_filter(cond, DOCS)).agg(F.count("*").alias("n"))


@query("facet_lang", "SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def facet_lang(spark, sf):
    return strategies.facet(table(spark, sf, "documents"), F.col("lang"))


@query("facet_source", "SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def facet_source(spark, sf):
    return strategies.facet(table(spark, sf, "documents"), F.col("source"))


@query("facet_json", "SELECT props ->> '$.k' AS value, count(*) AS n FROM events WHERE json_type(props, '$.k') IS NOT NULL GROUP BY 1")
def facet_json(spark, sf):
    return strategies.facet(events_md(spark, sf), values.facet(F.col("md"), "k"))


@query("distinct_field", "SELECT DISTINCT source AS value FROM documents WHERE source IS NOT NULL")
def distinct_field(spark, sf):
    return strategies.facet(table(spark, sf, "documents"), F.col("source")).select("value").orderBy("value")


@query("collections_counts", "SELECT lang AS collection, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def collections_counts(spark, sf):
    return table(spark, sf, "documents").where("lang is not null").groupBy(F.col("lang").alias("collection")).agg(F.count("*").alias("n"))


@query("collection_members", "SELECT doc_id FROM documents WHERE lang = 'de'")
def collection_members(spark, sf):
    return table(spark, sf, "documents").where("lang = 'de'").select("doc_id").orderBy("doc_id")


_TAGS = "SELECT DISTINCT unnest([event_type, 'user:' || CAST(user_id % 10 AS VARCHAR)]) AS tag, event_id AS id FROM events"


def tags(spark, sf):
    e = table(spark, sf, "events")
    tag = F.explode(F.array(F.col("event_type"), F.concat(F.lit("user:"), (F.col("user_id") % 10).cast("string"))))
    return e.select(tag.alias("tag"), F.col("event_id").alias("id")).distinct()


@query("tag_counts", f"SELECT tag, count(*) AS n FROM ({_TAGS}) GROUP BY tag")
def tag_counts(spark, sf):
    return tags(spark, sf).groupBy("tag").agg(F.count("*").alias("n"))


@query("docs_by_tag", f"SELECT id FROM ({_TAGS}) WHERE tag = 'user:3'")
def docs_by_tag(spark, sf):
    return tags(spark, sf).where("tag = 'user:3'").select("id").orderBy("id")


@query("trend_series", "SELECT event_type AS metric, epoch_us(ts) AS at_us, value FROM events WHERE event_type = 'click' ORDER BY at_us")
def trend_series(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'click'")
    return e.select(F.col("event_type").alias("metric"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "value").orderBy("at_us")


@query("trend_latest", "SELECT event_type AS metric, count(*) AS n, arg_max(value, struct_pack(a := ts, b := event_id)) AS last FROM events GROUP BY 1")
def trend_latest(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


@query("health", "SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM embeddings) AS vectors, (SELECT any_value(len(embedding)) FROM embeddings) AS dim, (SELECT max(event_id) + 1 FROM events) AS next_seq")
def health(spark, sf):
    d = table(spark, sf, "documents").agg(F.count("*").alias("docs"))
    v = table(spark, sf, "embeddings").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).cast("bigint").alias("dim"))
    s = table(spark, sf, "events").agg((F.max("event_id") + 1).alias("next_seq"))
    return d.crossJoin(v).crossJoin(s)


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, sf, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))
