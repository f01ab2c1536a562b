"""Predicates: P1 to P17, the text language's SELECT, and pages of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import geo, values
from recollect.plans import filters as f
from recollect.plans import ql
from recollect.queries import query
from recollect.runtime import table

DOCS = f.Fields({"lang": "lang", "source": "source", "n_chars": "n_chars"})
ORDERS = f.Fields({"ordered": "o_orderdate", "status": "o_orderstatus", "total": "o_totalprice"})
EVENTS = f.Fields({"type": "event_type"}, "md")
PLACES = f.Fields({"loc.lat": "lat", "loc.lon": "lon"})


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


def places(spark, sf):
    """Customers at points made from their keys."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", ((k * 37) % 1200 / 10.0 - 60).alias("lat"), ((k * 91) % 3600 / 10.0 - 180).alias("lon"))


PLACES_SQL = "SELECT c_custkey, (c_custkey * 37) % 1200 / 10.0 - 60 AS lat, (c_custkey * 91) % 3600 / 10.0 - 180 AS lon FROM customer"
HAVERSINE_SQL = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians(lat)) * pow(sin(radians(lon - ({1})) / 2), 2))))"


@query("filter_eq_any", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source IN ('src1', 'src7')")
def eq_any(spark, sf):
    cond = f.Filter(must=(f.Eq("lang", "en"), f.Any("source", ("src1", "src7"))))
    return _docs(spark, sf).where(f.compile_filter(cond, DOCS))


@query("filter_range_numeric", "SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars > 500 AND n_chars <= 2500")
def range_numeric(spark, sf):
    return _docs(spark, sf).where(f.compile_filter(f.Range("n_chars", gt=500, lte=2500), DOCS))


@query("filter_date_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def date_range(spark, sf):
    cond = f.DateRange("ordered", gte="1995-01-01T00:00:00Z", lt="1996-01-01T02:00:00+02:00")
    return table(spark, sf, "orders").where(f.compile_filter(cond, ORDERS)).select("o_orderkey", "o_orderdate")


@query("filter_geo_radius", f"SELECT c_custkey, round({HAVERSINE_SQL.format('10.0', '20.0')}, 3) AS dist_m FROM ({PLACES_SQL}) WHERE {HAVERSINE_SQL.format('10.0', '20.0')} <= 1500000")
def geo_radius(spark, sf):
    hit = places(spark, sf).where(f.compile_filter(f.GeoRadius("loc", 10.0, 20.0, 1_500_000), PLACES))
    return hit.select("c_custkey", F.round(geo.haversine_m(F.lit(10.0), F.lit(20.0), F.col("lat"), F.col("lon")), 3).alias("dist_m"))


@query("filter_geo_box", f"SELECT c_custkey, lat, lon FROM ({PLACES_SQL}) WHERE lat BETWEEN -10 AND 25 AND lon BETWEEN 5 AND 60")
def geo_box(spark, sf):
    return places(spark, sf).where(f.compile_filter(f.GeoBox("loc", -10, 5, 25, 60), PLACES))


def events_md(spark, sf):
    return table(spark, sf, "events").withColumn("md", F.try_parse_json("props"))


@query("filter_exists_json", "SELECT event_id FROM events WHERE json_type(props, '$.k') IS NOT NULL")
def exists_json(spark, sf):
    return events_md(spark, sf).where(f.compile_filter(f.Exists("k"), EVENTS)).select("event_id")


@query("filter_json_number", "SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND CAST(props ->> '$.k' AS DOUBLE) >= 20 AND CAST(props ->> '$.k' AS DOUBLE) < 60")
def json_number(spark, sf):
    return events_md(spark, sf).where(f.compile_filter(f.Range("k", gte=20, lt=60), EVENTS)).select("event_id")


@query("filter_must_should_mustnot", "SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars >= 300 AND (lang = 'fr' OR source = 'src3') AND NOT coalesce(source = 'src5', false)")
def must_should_must_not(spark, sf):
    cond = f.Filter(must=(f.Range("n_chars", gte=300),), should=(f.Eq("lang", "fr"), f.Eq("source", "src3")), must_not=(f.Eq("source", "src5"),))
    return _docs(spark, sf).where(f.compile_filter(cond, DOCS))


@query("filter_not_missing", "SELECT event_id FROM events WHERE NOT coalesce(json_type(props, '$.nothing') IS NOT NULL, false)")
def not_missing(spark, sf):
    return events_md(spark, sf).where(f.compile_filter(f.Not(f.Eq("nothing", 1)), EVENTS)).select("event_id")


@query("filter_from_json", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('de', 'es') AND n_chars < 4000")
def filter_from_json(spark, sf):
    body = {"must": [{"type": "any", "key": "lang", "values": ["de", "es"]}, {"type": "range", "key": "n_chars", "lt": 4000}]}
    return _docs(spark, sf).where(f.compile_filter(f.from_json(body), DOCS))


def _select(name, text, sql):
    @query(name, sql)
    def run(spark, sf, text=text):
        return ql.select(ql.parse(text), _docs(spark, sf).withColumn("id", F.col("doc_id")).withColumn("collection", F.col("lang")), DOCS).drop("id", "collection")

    return run


_COLS = "SELECT doc_id, lang, source, n_chars FROM documents"
_select("rql_select_filter", "SELECT * FROM en WHERE n_chars >= 500 AND source IN ('src1','src7') LIMIT 10", f"{_COLS} WHERE lang = 'en' AND n_chars >= 500 AND source IN ('src1', 'src7') ORDER BY doc_id LIMIT 10")
_select("rql_select_tree", "select * where (lang = 'de' or lang = 'fr') and not (n_chars < 1000 or source = \"src2\") limit 25 -- trees nest", f"{_COLS} WHERE lang IN ('de', 'fr') AND NOT (n_chars < 1000 OR source = 'src2') ORDER BY doc_id LIMIT 25")
_select("rql_select_default_limit", "SELECT * FROM es WHERE EXISTS(source)", f"{_COLS} WHERE lang = 'es' AND source IS NOT NULL ORDER BY doc_id LIMIT 10")


@query("scroll_page", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id > 250 ORDER BY doc_id LIMIT 40")
def scroll_page(spark, sf):
    return _docs(spark, sf).where(F.col("doc_id") > 250).orderBy("doc_id").limit(40)


@query("sample_seeded", "SELECT doc_id FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def sample_seeded(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id").limit(50)


@query("point_lookup", "SELECT doc_id, text FROM documents WHERE doc_id IN (3, 5, 8)")
def point_lookup(spark, sf):
    return table(spark, sf, "documents").where(F.col("doc_id").isin(3, 5, 8)).select("doc_id", "text")


@query("collection_scope_alias", "SELECT doc_id FROM documents WHERE lang = 'fr'")
def collection_scope_alias(spark, sf):
    aliases = {"francais": "fr"}
    return table(spark, sf, "documents").where(F.col("lang") == aliases.get("francais", "francais")).select("doc_id")


@query("time_rfc3339", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def time_rfc3339(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, sf, "events").select("event_id", values.epoch_ms(text).alias("ms"))


@query("uuid_check", "SELECT event_id, event_id % 3 <> 0 AS ok FROM events")
def uuid_check(spark, sf):
    m = F.md5(F.col("event_id").cast("string"))
    u = F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return table(spark, sf, "events").select("event_id", values.is_uuid(F.when(F.col("event_id") % 3 == 0, F.concat(u, F.lit("0"))).otherwise(u)).alias("ok"))


@query("schema_violations", "SELECT event_id FROM events WHERE json_type(props, '$.k') IS NOT NULL AND NOT (json_type(props, '$.k') = 'VARCHAR')")
def schema_violations(spark, sf):
    return events_md(spark, sf).where(~values.matches_type(F.col("md"), "k", "string")).select("event_id")


MORTON_SQL = "SELECT c_custkey, (" + " + ".join(f"((x >> {i}) & 1) * {1 << (2 * i)} + ((y >> {i}) & 1) * {1 << (2 * i + 1)}" for i in range(8)) + f") AS cell FROM (SELECT c_custkey, CAST(least(floor((lat + 90) / 180 * 256), 255) AS BIGINT) AS y, CAST(least(floor((lon + 180) / 360 * 256), 255) AS BIGINT) AS x FROM ({PLACES_SQL}))"


@query("geo_morton", MORTON_SQL)
def geo_morton(spark, sf):
    return places(spark, sf).select("c_custkey", geo.morton(F.col("lat"), F.col("lon"), 8).alias("cell"))
