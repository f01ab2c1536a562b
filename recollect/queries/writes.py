"""Writes as table versions, and the changefeed."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import writes
from recollect.queries import query
from recollect.runtime import table


def _old(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")


def _batch(spark, sf):
    """A later version of every document that labels name: each comes twice, the better label last."""
    l = table(spark, sf, "labels")
    return l.select(F.col("doc_id").alias("id"), F.lit("xx").alias("lang"), F.col("quality").cast("bigint").alias("n_chars"), F.struct("quality", "toxic").alias("pos"))


_LAST = "(SELECT doc_id AS id, 'xx' AS lang, CAST(quality AS BIGINT) AS n_chars FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, toxic DESC) = 1)"


@query("upsert_merge", f"SELECT doc_id AS id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT id, lang, n_chars FROM {_LAST}")
def upsert_merge(spark, sf):
    return writes.upsert(_old(spark, sf), writes.last_of_batch(_batch(spark, sf)))


@query("remove_anti", "SELECT doc_id AS id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def remove_anti(spark, sf):
    ids = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return writes.remove(_old(spark, sf), ids)


@query("transaction_fold", f"SELECT doc_id AS id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT id, lang, n_chars FROM {_LAST} WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def transaction_fold(spark, sf):
    up = _batch(spark, sf).select(F.lit("upsert").alias("op"), F.lit(0).alias("stage"), "pos", "id", "lang", "n_chars")
    down = _batch(spark, sf).where("pos.toxic = 1").select(F.lit("remove").alias("op"), F.lit(1).alias("stage"), "pos", "id", "lang", "n_chars")
    ops = up.unionByName(down).withColumn("pos", F.struct("stage", "pos")).drop("stage")
    return writes.apply_ops(_old(spark, sf), ops)


def _maps(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))


def _edit(name, change, lang, source, extra):
    sql = f"SELECT doc_id AS id, {lang} AS lang, {source} AS source, {extra} AS extra FROM (SELECT d.*, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS hit FROM documents d)"

    @query(name, sql)
    def run(spark, sf):
        ids = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
        m = writes.edit_metadata(_maps(spark, sf), ids, change())
        return m.select("id", *(F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("lang", "source", "extra")))

    return run


_edit("metadata_set", lambda: writes.set_keys({"lang": "zz", "extra": "1"}), "CASE WHEN hit THEN 'zz' ELSE lang END", "source", "CASE WHEN hit THEN '1' END")
_edit("metadata_overwrite", lambda: writes.overwrite({"extra": "2"}), "CASE WHEN NOT hit THEN lang END", "CASE WHEN NOT hit THEN source END", "CASE WHEN hit THEN '2' END")
_edit("metadata_delete", lambda: writes.delete_keys(["source"]), "lang", "CASE WHEN NOT hit THEN source END", "CAST(NULL AS VARCHAR)")
_edit("metadata_clear", lambda: writes.clear(), "CASE WHEN NOT hit THEN lang END", "CASE WHEN NOT hit THEN source END", "CAST(NULL AS VARCHAR)")


def feed(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("upsert").alias("op"), F.col("user_id").alias("doc_id"))


_FEED = "(SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'upsert' END AS op, user_id AS doc_id FROM events)"


@query("feed_page", f"SELECT seq, op, doc_id FROM {_FEED} WHERE seq >= 500 ORDER BY seq LIMIT 256")
def feed_page(spark, sf):
    return writes.feed_page(feed(spark, sf), 500, 256)


@query("feed_stats", f"SELECT min(seq) AS first_seq, max(seq) + 1 AS next_seq, count(*) AS n FROM {_FEED}")
def feed_stats(spark, sf):
    return feed(spark, sf).agg(F.min("seq").alias("first_seq"), (F.max("seq") + 1).alias("next_seq"), F.count("*").alias("n"))


@query("replication_view", f"SELECT seq, op, f.doc_id, d.lang, d.n_chars FROM {_FEED} f LEFT JOIN documents d ON d.doc_id = f.doc_id")
def replication_view(spark, sf):
    return writes.replication(feed(spark, sf), _old(spark, sf)).select("seq", "op", "doc_id", "lang", "n_chars")


@query("elect_leader", "SELECT user_id, max(event_id) AS cursor FROM events GROUP BY 1 ORDER BY cursor DESC, user_id DESC LIMIT 1")
def elect_leader(spark, sf):
    cursors = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("cursor"))
    return cursors.orderBy(F.desc("cursor"), F.desc("user_id")).limit(1)
