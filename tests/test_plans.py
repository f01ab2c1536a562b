"""What the optimised plans look like: filters at the scan, pages broadcast, groups limited before they are sorted."""

import re

import pytest
from pyspark.sql import functions as F

from recollect.operators import lexical
from recollect.plans import filters as f
from recollect.plans import planner
from recollect.queries.search import corpus, probe_vector
from recollect.runtime import shared_dir, table

SF = "/root/testdata/sf0.001"
AT = f.Fields({"lang": "lang", "source": "source", "n": "n_chars"})
ORDERS = f.Fields({"at": "o_orderdate"})
PLACES = f.Fields({"loc.lat": "lat", "loc.lon": "lon"})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "condition, pushed",
    [
        (f.Eq("lang", "en"), "EqualTo(lang,en)"),
        (f.Any("source", ("a", "b")), "In(source, [a,b])"),
        (f.Range("n", gt=5), "GreaterThan(n_chars,5)"),
        (f.Exists("lang"), "IsNotNull(lang)"),
        (f.Not(f.Eq("lang", "en")), "IsNull(lang)"),
        (f.Not(f.Range("n", gt=5)), "LessThanOrEqual(n_chars,5)"),
        (f.Filter(must=(f.Eq("lang", "en"),), should=(f.Range("n", gt=5), f.Eq("source", "a")), must_not=(f.Eq("source", "b"),)), "Or(GreaterThan(n_chars,5),"),
        (f.from_json({"must": [{"type": "range", "key": "n", "lte": 7}]}), "LessThanOrEqual(n_chars,7)"),
    ],
)
def test_conditions_reach_the_scan(spark, condition, pushed):
    scan = plan(table(spark, SF, "documents").where(f.compile_filter(condition, AT)).select("doc_id"))
    found = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: (.*)", scan)
    assert pushed.split("(")[0] in found[1] and pushed.split("(")[1].split(",")[0].rstrip(")") in found[1] and "text" not in found[2]


def test_dates_and_places_reach_the_scan(spark, tmp_path):
    scan = plan(table(spark, SF, "orders").where(f.compile_filter(f.DateRange("at", gte="1995-01-01T00:00:00Z"), ORDERS)))
    assert "GreaterThanOrEqual(o_orderdate" in scan
    spark.createDataFrame([(1.0, 2.0)], "lat double, lon double").write.parquet(str(tmp_path / "p"))
    for c in (f.GeoRadius("loc", 1.0, 2.0, 1000.0), f.GeoBox("loc", 0, 0, 5, 5)):
        df = spark.read.parquet(str(tmp_path / "p")).where(f.compile_filter(c, PLACES))
        assert "GreaterThanOrEqual(lat" in plan(df).split("PushedFilters")[1] and df.count() == 1


def test_one_text_query_reads_its_postings_only(spark, tmp_path):
    d = table(spark, SF, "documents").withColumn("id", F.col("doc_id"))
    index = lexical.Index.write(d, str(tmp_path / "index"))
    hits = lexical.best(lexical.score_text(index, "than heoron thing"), 10)
    text = plan(hits)
    assert text.count("Exchange") <= 4 and "(term" in text.split("PushedFilters")[1] and "documents.parquet" not in text
    assert index.n_docs == d.count() and index.n_tokens == index.postings.agg(F.sum("tf")).first()[0]


def test_a_page_is_broadcast(spark):
    page = planner.plan(corpus(spark, SF), planner.SearchRequest(text="the heoron of thing", with_vectors=True))
    text = plan(page)
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text and page.count() == 10


def test_deep_pages_limit_groups_first(spark):
    """Past Spark's own limit for group limits, slices of a group are ranked before the group is."""
    scored = spark.range(5000).select(F.lit(0).alias("query_id"), F.col("id"), (F.col("id") % 97).cast("double").alias("score"))
    assert plan(lexical.top(scored, 1100)).count("Window [") == 2
    deep = [r.id for r in lexical.top(scored, 1100).orderBy("rank").collect()]
    assert deep == [r.id for r in lexical.best(scored, 1100).orderBy("rank").collect()] == sorted(range(5000), key=lambda i: (-(i % 97), i))[:1100]
    r = planner.SearchRequest(text="the", vector=probe_vector(spark, SF), top_k=1024, with_payload=False)
    assert planner.plan(corpus(spark, SF), r).count() >= 500


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class N:
                            @staticmethod
                            def isDefined():
                                return False

                        return N

                return S

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_dir(Session)
