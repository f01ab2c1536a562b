import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.functions import compact, geo, text, values
from recollect.operators import ann, evaluation
from recollect.plans import filters as f
from recollect.plans import ql


def test_stems():
    pairs = "caresses caress ponies poni cats cat agreed agre hopping hop filing file happy happi relational relat electrical electr goodness good adoption adopt rate rate roll roll".split()
    for a, b in zip(pairs[::2], pairs[1::2]):
        assert text.porter(a) == b
    assert text.porter("is") == "is" and text.porter("été") == "été"


def test_stem_query_against_a_plain_loop(spark):
    """Every word of a table's texts, stemmed one by one."""
    from recollect.queries.lexicon import stem_terms

    got = {r.term: r.stem for r in stem_terms(spark, "/root/testdata/sf0.001").collect()}
    words = {w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for w in text.SPLIT.findall((r.text or "").lower())}
    assert got == {w: text.porter(w) for w in words} and len(got) > 1000


def test_shape_keys_keep_json_types(spark):
    df = spark.createDataFrame([('{"b": "5", "a": 5, "c": "true", "d": true, "e": null, "f": {}, "g": [1], "h": 1.5}',), ("{}",), ("[1]",)], "j string")
    assert [r[0] for r in df.select(values.shape_key(F.col("j"))).collect()] == ["a:number,b:string,c:string,d:bool,e:null,f:object,g:array,h:number", "", None]


def test_spans_are_linear():
    long = "é cat " * 60_000
    assert len(text.spans(long, {"cat"})) == 60_000 and text.spans(long, {"cat"})[-1] == (3 + 7 * 59_999, 6 + 7 * 59_999)


def test_spans_are_bytes():
    assert text.spans("é cat, Cats", {"cat"}, stemmed=True) == [(3, 6), (8, 12)]


def test_typed_values(spark):
    rows = [('{"k": "5"}',), ('{"k": 5}',), ('{"k": 5.0}',), ('{"k": true}',), ('{"k": null}',), ("{}",), (None,)]
    df = spark.createDataFrame(rows, "j string").withColumn("md", F.try_parse_json("j"))
    got = [tuple(r) for r in df.select(values.equals(F.col("md"), "k", 5), f.compile_filter(f.Exists("k"), f.Fields({}, "md")), values.number(F.col("md"), "k")).collect()]
    assert got == [(False, True, None), (True, True, 5.0), (True, True, 5.0), (False, True, None), (False, True, None), (False, False, None), (False, False, None)]


def test_times(spark):
    rows = [("2024-01-01T00:00:00Z", 1704067200000), ("2024-01-01 01:00:00.5+01:00", 1704067200500), ("2024-02-31T00:00:00Z", None), ("2024-01-01", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, ms bigint")
    assert df.where(~values.epoch_ms(F.col("t")).eqNullSafe(F.col("ms"))).isEmpty()


def test_not_is_two_valued(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id int, x string")
    at = f.Fields({"x": "x"})
    assert [r.id for r in df.where(f.compile_filter(f.Not(f.Eq("x", "a")), at)).collect()] == [1]
    with pytest.raises(f.InvalidRequest):
        f.DateRange("x", gt="yesterday").column(at)


def test_haversine(spark):
    d = spark.range(1).select(geo.haversine_m(F.lit(52.52), F.lit(13.405), F.lit(48.8566), F.lit(2.3522))).first()[0]
    assert abs(d - 877_464) < 500


def test_language():
    s = ql.parse("SELECT * FROM docs WHERE a = 1 OR b = 'x' AND NOT EXISTS(c) LIMIT 3")
    assert s.limit == 3 and isinstance(s.where, f.Filter) and len(s.where.should) == 2
    assert ql.parse("UPDATE x CONTENT SET a = 1").parts["replace"]
    assert ql.parse("TRAVERSE a, b <-> knows DEPTH 3 LIMIT 5").parts == {"start": ["a", "b"], "direction": "both", "verb": "knows", "depth": 3, "limit": 5}
    with pytest.raises(ql.SyntaxProblem) as e:
        ql.parse("SELECT * WHERE ?")
    assert "^" in e.value.render()
    with pytest.raises(f.InvalidRequest):
        ql.parse_query("DELETE x")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_language_never_breaks(s):
    try:
        ql.parse(s)
    except ql.SyntaxProblem:
        pass


def test_compact():
    rows = {"users": [{"id": 1, "name": "Ada"}, {"id": 2, "name": "a,b"}], "n": None, "t": "true"}
    assert compact.encode(rows) == 'n: null\nt: "true"\nusers[2]{id,name}:\n  1,Ada\n  2,"a,b"\n'
    assert compact.encode([]) == "[]\n" and compact.encode([1, "x"]) == "[2]: 1,x\n"
    page = [{"id": "a", "text": "x y", "score": 0.123456}] * 5
    assert compact.render(page, False)["saved_percent"] > 0 and json.loads(compact.render(page, False)["body"])[0]["score"] == 0.1235


def test_metrics_and_codes():
    lo, hi = evaluation.bootstrap_interval([0.1, 0.5, 0.9] * 10, 500)
    assert lo < 0.5 < hi
    assert evaluation.paired_test([1.0] * 12, [0.0] * 12, 2000)[1] < 0.01
    x = np.random.default_rng(0).normal(size=(300, 32))
    book = ann.ProductCodes.train(x, 8, 64)
    assert np.linalg.norm(book.decode(book.encode(x)) - x) < np.linalg.norm(x)


@pytest.mark.parametrize("name", ["ivf", "pq"])
def test_recall(spark, name):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = v.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    exact = {(r.query_id, r.id) for r in ann.exact_batch(v, q, 10).collect()}
    hits = ann.Ivf.build(v).search(q, 10) if name == "ivf" else ann.pq_search(v, q, 10)
    found = {(r.query_id, r.id) for r in hits.collect()}
    assert len(exact & found) / len(exact) >= 0.95


def test_pq_among_near_copies(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    x = np.vstack([rng.normal(size=(3000, 64)), base + 0.03 * rng.normal(size=(5000, 64)), np.zeros((1, 64))])
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    v = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")
    asked = [*range(10), *range(3000, 3040)]
    q = v.where(F.col("id").isin(asked)).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    found = {(r.query_id, r.id) for r in ann.pq_search(v, q, 10).collect()}
    want = {(a, int(i)) for a in asked for i in np.lexsort((np.arange(len(u)), -np.round(u @ u[a], 9)))[:10]}
    assert len(found) == len(want) and len(found & want) / len(want) >= 0.99


def test_ties_go_by_id(spark):
    rng = np.random.default_rng(6)
    ids = rng.permutation(20_000)[:8000]
    x = np.vstack([np.tile(np.eye(16)[:1], (5000, 1)), -np.eye(16)[rng.integers(0, 16, 3000)]])
    got = ann.best_of(ids, x, np.array([1, 2]), np.eye(16)[[0, 1]], 5).to_pydict()
    assert got["query_id"] == [1] * 5 + [2] * 5 and got["id"][:5] == sorted(ids[:5000])[:5]
    assert got["id"][5:] == sorted(i for i, r in zip(ids, x) if r[1] == 0)[:5]
    v = spark.createDataFrame([(int(i), [float(z) for z in r]) for i, r in zip(ids, x)], "id bigint, vec array<double>")
    q = spark.createDataFrame([(1, [1.0] + [0.0] * 15)], "query_id bigint, qvec array<double>")
    for out in (ann.exact_batch(v, q, 5), ann.pq_search(v, q, 5)):
        assert [r.id for r in out.orderBy("rank").collect()] == sorted(ids[:5000])[:5]
