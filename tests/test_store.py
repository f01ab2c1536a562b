import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect import cluster
from recollect import engine as E
from recollect.functions.text import Analyzer
from recollect.operators import baseline, gate
from recollect.plans import filters as f
from recollect.plans.filters import InvalidRequest
from recollect.plans.planner import SearchRequest
from recollect.sources import readers, sync
from recollect.store import NotFound, QuotaExceeded, Quotas, SchemaViolation, Store, StoreCatalog, StoreError
from recollect.streaming import live

DOCS = [
    {"id": "a", "text": "Spark plans queries over tables", "metadata": {"team": "x", "n": 1}, "collection": "c1"},
    {"id": "b", "text": "Queries meet indexes and tables", "metadata": {"team": "y", "n": 2}, "collection": "c1"},
    {"id": "c", "text": "Cats sleep in the sun", "metadata": {"team": "x", "n": 3}, "collection": "c2"},
]


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.upsert(s.frame(DOCS))
    return s


def ids(df):
    return [r["id"] for r in df.collect()]


def test_writes_and_reads(store, tmp_path, spark):
    assert ids(store.sql("SELECT * WHERE team = 'x' AND n >= 2")) == ["c"]
    store.upsert(store.frame([{"id": "a", "text": "old"}, {"id": "a", "text": "new cats", "collection": "c2"}]))
    assert store.docs().where("id = 'a'").first()["text"] == "new cats" and store.docs().count() == 3
    store.sql("DEFINE ALIAS k FOR c2")
    assert ids(store.sql("SELECT * FROM k")) == ["a", "c"]
    assert set(ids(store.query(SearchRequest(text="cats")))) == {"a", "c"}
    assert store.remove(["zz"]) == 0 and store.remove(["b", "zz"]) == 1
    feed = [(r.seq, r.op, r.doc_id) for r in store.changes(0).collect()]
    assert feed == [(0, "upsert", "a"), (1, "upsert", "b"), (2, "upsert", "c"), (3, "upsert", "a"), (4, "remove", "b")]
    store.snapshot(str(tmp_path / "copy"))
    copy = Store(spark, str(tmp_path / "copy"))
    other = Store(spark, str(tmp_path / "replica"))
    assert sorted(ids(copy.docs())) == ["a", "c"] and live.replicate(store, other, 0) == 5
    assert sorted(ids(other.docs())) == ["a", "c"]


def test_metadata_edits(store):
    store.sql("UPDATE a SET extra = true, n = 7")
    assert json.loads(store.docs().where("id = 'a'").first()["metadata"]) == {"team": "x", "n": 7, "extra": True}
    store.sql("DELETE PAYLOAD a (team)")
    store.define_index("n")
    assert store.table("docs").where("n_n = 7").count() == 1
    store.sql("DELETE PAYLOAD a")
    assert json.loads(store.docs().where("id = 'a'").first()["metadata"]) == {}
    with pytest.raises(NotFound):
        store.set_metadata("zz", {})


def test_transaction_schema_quota(store, spark, tmp_path):
    store.sql("DEFINE FIELD n ON c1 TYPE int")
    with pytest.raises(SchemaViolation):
        store.transaction([{"remove": "a"}, {"upsert": [{"id": "q", "metadata": {"n": "no"}, "collection": "c1"}]}])
    assert store.docs().count() == 3
    store.transaction([{"upsert": [{"id": "d", "text": "x"}]}, {"remove": "d"}, {"upsert": [{"id": "e", "text": "y"}]}, {"remove": "a"}])
    assert sorted(ids(store.docs())) == ["b", "c", "e"]
    small = Store(spark, str(tmp_path / "q"), Quotas(max_batch=1, max_top_k=2))
    with pytest.raises(QuotaExceeded):
        small.upsert(small.frame(DOCS))
    with pytest.raises(QuotaExceeded):
        small.query(SearchRequest(text="x", top_k=3))
    with pytest.raises(SchemaViolation):
        store.upsert(store.frame([{"id": "v", "vec": [1.0]}]))


def test_graph_tags_catalog(store, spark, tmp_path):
    store.sql("RELATE a -> cites -> b")
    store.sql("RELATE b -> cites -> c")
    store.relate("b", "cites", "c")
    assert [(r["id"], r["hop"]) for r in store.sql("TRAVERSE a -> cites").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    store.unrelate("b", "cites", "c")
    assert store.edges().count() == 1
    store.tag("a", ["t", "t"])
    store.compact()
    assert store.tags().count() == 1
    cat = StoreCatalog(spark, str(tmp_path / "cat"))
    cat.database("n1", "d1").define_index("x")
    assert cat.namespaces() == ["n1"] and cat.databases("n1") == ["d1"] and cat.drop_database("n1", "d1")
    with pytest.raises(ValueError):
        cat.database("..", "x")


def test_ask_and_verbs(store):
    events = []
    eng = E.Engine(store, sink=events.append)
    a = eng.ask("which queries read tables")
    assert a.candidates and a.candidates[0]["id"] in ("a", "b") and len({e["turn"] for e in events}) == 1
    assert E.Engine(store).ask("x" * (1 << 20 | 1)).label == "gated"
    assert E.dispatch(eng, "sql", {"q": "INFO"})["docs"] == 3
    assert E.dispatch(eng, "changes", {"since": 1})["next_seq"] == 3
    with pytest.raises(E.Refused):
        E.dispatch(eng, "sql", {"q": "DELETE a"}, E.READER)
    t = E.sign(b"k", E.WRITER)
    assert E.read_token(b"k", t)["role"] == E.WRITER
    with pytest.raises(E.Refused):
        E.read_token(b"other", t)


def test_more_verbs(store):
    eng = E.Engine(store)
    out = E.dispatch(eng, "graphql", {"q": 'query { collections { name } document(id: "c") { text } search(query: "cats", topK: 1, mode: lexical) { id } }'})
    assert out == {"data": {"collections": [{"name": "c1"}, {"name": "c2"}], "document": {"text": DOCS[2]["text"]}, "search": [{"id": "c"}]}}
    with pytest.raises(E.Refused):
        E.dispatch(eng, "graphql", {"q": 'mutation { delete(id: "a") }'}, E.READER)
    hits = E.dispatch(eng, "recommend", {"positive": ["a"], "top_k": 1})["hits"]
    assert [h["id"] for h in hits] == ["b"]
    vec = [float(x) for x in store.table("vecs").where("id = 'a'").first()["vec"]]
    assert E.dispatch(eng, "discover", {"vector": vec, "pairs": [["a", "c"]], "top_k": 2})["hits"][0]["id"] == "a"
    assert E.dispatch(eng, "map", {"query": "cats in the sun"})["dot"].startswith('digraph "answer"')


def test_sources(spark, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "a.txt").write_text("alpha")
    (d / "sub" / "b.txt").write_text("beta")
    (d / "bad.bin").write_bytes(b"\xff\xfe\x00")
    rows = readers.directory(spark, str(d)).collect()
    assert [r.text for r in rows] == ["alpha", "beta"]
    assert [r.text for r in readers.directory(spark, str(d), after=rows[0].cursor).collect()] == ["beta"]
    j = tmp_path / "x.jsonl"
    j.write_text('{"id": "1", "text": "t", "k": 2, "s": "2", "z": null}\n{"text": "u"}\n')
    got = readers.json_lines(spark, str(j)).orderBy("cursor").collect()
    assert [(r.id, r.text, r.cursor) for r in got] == [("jsonl:1", "t", 1), ("jsonl:line2", "u", 2)] and json.loads(got[0].metadata) == {"k": 2, "s": "2", "z": None}


def test_a_transaction_is_one_version(store):
    before = store.manifest()
    assert store.transaction([{"upsert": [{"id": "d", "text": "x"}]}, {"remove": "a"}, {"remove": "zz"}]) == 2
    after = store.manifest()
    assert after.version == before.version + 1 and after.next_seq == before.next_seq + 2
    assert sorted(ids(store.docs(before))) == ["a", "b", "c"] and sorted(ids(store.docs(after))) == ["b", "c", "d"]
    store.sql("DEFINE FIELD n ON c1 TYPE int")
    held = store.manifest()
    with pytest.raises(SchemaViolation):
        store.transaction([{"remove": "b"}, {"upsert": [{"id": "q", "metadata": {"n": "no"}, "collection": "c1"}]}])
    assert store.manifest() == held and not store.folder.exists("writer.lock")
    store.folder.create("writer.lock")
    with pytest.raises(StoreError):
        store.set_metadata("b", {"n": 1})
    store.folder.delete("writer.lock")


def test_deltas_merge_and_compact(store, spark, monkeypatch):
    monkeypatch.setattr("recollect.store.MOST_DELTAS", 2)
    store.tag("a", ["t"])
    for i in range(3):
        store.upsert(store.frame([{"id": "a", "text": f"version {i}"}, {"id": f"x{i % 3}", "text": "y"}]))
    assert len(store.manifest().tables["docs"]) == 2
    store.remove(["x1"])
    view = {r.id: r.text for r in store.docs().collect()}
    assert view == {"a": "version 2", "b": DOCS[1]["text"], "c": DOCS[2]["text"], "x0": "y", "x2": "y"}
    assert store.table("vecs").count() == 5 and store.remove(["a"]) == 1 and store.tags().count() == 1
    seqs = [r.seq for r in store.table("feed").orderBy("seq").collect()]
    assert seqs == list(range(store.manifest().next_seq))
    reader = store.docs()
    store.compact()
    assert reader.count() == 4  # a reader of the version before can end
    store.compact()
    assert len(store.manifest().tables["docs"]) == 1 and sorted(ids(store.docs())) == ["b", "c", "x0", "x2"]
    assert [r.id for r in store.scroll("b", 2).collect()] == ["c", "x0"] and store.sizes()["docs"] > 0
    assert store.drop_collection("c2") == 1 and store.count() == 3


def test_index_columns_reach_the_scan(store):
    store.upsert(store.frame([{"id": "d", "metadata": {"n": "2", "when": "2024-05-01T00:00:00Z", "loc": {"lat": 10, "lon": 20}, "flag": True, "none": None}}]))
    conditions = {
        "team": f.Eq("team", "x"), "n": f.Range("n", gte=2), "when": f.DateRange("when", gte="2024-01-01T00:00:00Z"), "loc": f.GeoBox("loc", 0, 0, 30, 30),
        "flag": f.Eq("flag", True), "none": f.Eq("none", None),
    }
    plain = {k: sorted(ids(store.query(SearchRequest(filter=c)))) for k, c in conditions.items()}
    assert plain == {"team": ["a", "c"], "n": ["b", "c"], "when": ["d"], "loc": ["d"], "flag": ["d"], "none": ["d"]}
    for k in conditions:
        store.define_index(k)
    c = store.corpus()
    for k, condition in conditions.items():
        assert sorted(ids(store.query(SearchRequest(filter=condition)))) == plain[k]
        assert sorted(ids(store.query(SearchRequest(filter=f.Not(condition))))) == sorted(set("abcd") - set(plain[k]))
        plan = c.docs.where(f.compile_filter(condition, c.fields))._jdf.queryExecution().executedPlan().toString()
        assert f"_{k}" in plan.split("PushedFilters: [")[1].split("]")[0], plan
        assert f.explain_filter(condition, c.fields) == {k: True}
    assert "n_n" not in store.query(SearchRequest(filter=conditions["n"])).columns
    with pytest.raises(NotFound):
        store.rebuild_index("zz")
    assert store.count_where(f.Range("n", gt=1)) == 2 and store.indexes() == sorted(conditions)


def test_spaces_sparse_and_tokens(store, spark):
    store.upsert(store.frame([
        {"id": "p", "text": "one", "spaces": {"title": [1.0, 0.0], "body": [0.0, 1.0]}, "sparse": [(3, 1.0), (9, 2.0)], "tokens": [[1.0, 0.0], [0.0, 1.0]]},
        {"id": "q", "text": "two", "spaces": {"title": [0.0, 1.0]}, "sparse": [(3, 5.0)], "tokens": [[0.5, 0.5]]},
    ]))
    assert ids(store.query(SearchRequest(vector=(1.0, 0.1), using="title", top_k=1))) == ["p"]
    assert ids(store.query(SearchRequest(vector=(1.0, 0.1), using="body"))) == ["p"]
    assert ids(store.query(SearchRequest(sparse=((3, 1.0), (9, 1.0))))) == ["q", "p"]
    assert ids(store.query(SearchRequest(text="one two", tokens=((1.0, 0.0),))))[0] == "p"
    with pytest.raises(InvalidRequest):
        store.query(SearchRequest(vector=(1.0,), using="none"))
    store.upsert(store.frame([{"id": "p", "text": "one again"}]))  # what an upsert doesn't bring goes
    assert ids(store.query(SearchRequest(sparse=((3, 1.0),)))) == ["q"]
    store.remove(["q"])
    assert store.table("tokens").count() == 0 and store.table("spaces").count() == 0


def test_postings_and_analyzer_of_a_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), analyzer=Analyzer(stem=True))
    s.upsert(s.frame([{"id": "a", "text": "running horses"}, {"id": "b", "text": "a horse runs"}, {"id": "c", "text": "cats"}]))
    assert sorted(ids(s.query(SearchRequest(text="horse run")))) == ["a", "b"]
    made = s.manifest().postings
    assert made["of"] == s.manifest().tables["docs"] and ids(s.query(SearchRequest(text="cat"))) == ["c"] and s.manifest().postings == made
    s.upsert(s.frame([{"id": "d", "text": "more cats"}]))
    assert sorted(ids(s.query(SearchRequest(text="cat")))) == ["c", "d"] and s.manifest().postings != made
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "s"), analyzer=Analyzer())
    assert Store(spark, str(tmp_path / "s")).analyzer.stem


def test_cells_of_a_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("recollect.store.ANN_FROM", 100)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    s = Store(spark, str(tmp_path / "s"))
    rows = [(f"{i:03d}", f"t {i}", json.dumps({"even": i % 2 == 0}), v.tolist()) for i, v in enumerate(x)]
    s.upsert(spark.createDataFrame(rows, "id string, text string, metadata string, vec array<double>"))
    assert s.corpus().ann is None
    s.build_cells(cells=12)
    index = s.corpus().ann
    assert index is not None and index.feed_seq == s.manifest().next_seq
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = total = 0
    for q in range(0, 600, 200):
        best = [f"{i:03d}" for i in np.argsort(-(u @ u[q]), kind="stable")[:10]]
        got = ids(s.query(SearchRequest(vector=tuple(x[q]))))
        found, total = found + len(set(best) & set(got)), total + 10
        even = [f"{i:03d}" for i in np.argsort(-(u @ u[q]), kind="stable") if i % 2 == 0][:10]
        assert len(set(even) & set(ids(s.query(SearchRequest(vector=tuple(x[q]), filter=f.Eq("even", True)))))) >= 8
        assert ids(s.query(SearchRequest(vector=tuple(x[q]), exact=True))) == best
    assert found / total >= 0.9
    more = index.remove(spark.createDataFrame([("000",)], "id string"), 0).insert(spark.createDataFrame([("new", x[0].tolist())], "id string, vec array<float>"), 1)
    assert [r["id"] for r in more.search_one(tuple(x[0]), 1).collect()] == ["new"]
    s.upsert(s.frame([{"id": "z", "text": "z", "vec": [0.0] * 8}]))
    assert s.corpus().ann is None  # stale
    with pytest.raises(Exception, match="dimension"):
        s.query(SearchRequest(vector=(1.0, 2.0), exact=True)).collect()


def test_sync_and_distill(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    src = tmp_path / "in.jsonl"
    lines = [{"id": f"m{i}", "text": f"body {i}", "subject": "s", "sender": f"u{i}@x.org", "created_at": "2024-01-01T00:00:00Z"} for i in range(5)]
    src.write_text("\n".join(json.dumps(x) for x in [*lines, {"id": "big", "text": "x" * (1 << 20 | 1)}]))
    driver, events = sync.JsonLines(str(src), batch=4), []
    with pytest.raises(NotFound):
        sync.sync(s, driver, "inbox")
    s.register_connector("inbox", {"provider": "jsonl"})
    report = sync.sync(s, driver, "inbox", events.append)
    assert (report.ingested, report.blocked, report.batches) == (5, 1, 2)
    assert s.edges().where("src = 'inbox' and verb = 'contains'").count() == 5 and s.tags().where("tag = 'mode:mail'").count() == 5
    assert [e["kind"] for e in events] == ["connector.batch", "connector.batch", "connector.synced"]
    assert s.connectors()["inbox"]["sync"]["status"] == "idle" and s.table("baseline").agg(F.sum("n")).first()[0] == 5
    assert sync.sync(s, driver, "inbox").ingested == 0 and s.count() == 5  # nothing new behind the cursor
    row = gate.distill(s.docs().where("id = 'jsonl:m1'")).first()
    assert row.family == "mail" and row.hints.has_identity and row.hints.has_time and row.hints.has_title and row.hints.has_content
    assert row.fields.identity == {"sender": '"u1@x.org"'} and row.hints.ambiguity_margin == 1.0 and row.context == "jsonl:m1"
    known = spark.createDataFrame([(row.shape_key,)], "shape_key string")
    shapes = spark.createDataFrame([(row.shape_key, "mail"), ("other:string", "mail")], "shape_key string, family string")
    assert {r.shape_key: r.is_new for r in gate.new_shapes(shapes, known).collect()} == {row.shape_key: False, "other:string": True}
    assert gate.siblings(shapes).first().shapes == 2


def test_baseline_snapshot_grows_as_the_whole(spark):
    obs = spark.createDataFrame([("c", "ab"[i % 3 == 0], i) for i in range(60)], "context string, shape string, seq bigint")
    empty = spark.createDataFrame([], "context string, shape string, n bigint, w double, last bigint")
    half = baseline.merge(empty, obs.where("seq < 30"))
    got = {r["shape"]: r.share for r in baseline.restored(baseline.merge(half, obs.where("seq >= 30"))).collect()}
    want = {r["shape"]: r.share for r in baseline.distribution(obs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    drifts = spark.createDataFrame([("c", 0.3, True), ("d", 0.1, False)], "context string, psi double, alert boolean")
    assert [r.context for r in baseline.drift_events(drifts).collect()] == ["c"]


def test_cluster():
    c = cluster.Cluster(quorum=cluster.majority(3))
    with pytest.raises(cluster.NoQuorum):
        c.wait(5, 0.01)
    threading.Timer(0.05, lambda: c.observe("f", 7)).start()
    c.wait(5, 5)
    c.observe("f", 3)
    assert c.cursors == {"f": 7} and c.committed(7) and not c.committed(8)
    assert cluster.elect({"a": 3, "b": 3, "c": 1}) == "b" and cluster.elect({}) is None


def test_hooks_and_tokens(store, tmp_path, spark):
    sink = E.JsonEvents(str(tmp_path / "events.jsonl"))
    eng = E.Engine(store, E.model_reranker(lambda q, t: [len(x) for x in t]), sink, judge=lambda q, c: q.select(F.lit("fine").alias("label"), F.lit(True).alias("ready"), F.lit(1.0).alias("confidence")))
    a = eng.ask("queries tables cats")
    assert a.label == "fine" and [c["id"] for c in a.candidates] == ["a", "b", "c"][: len(a.candidates)] or a.candidates[0]["rank"] == 1
    assert {json.loads(x)["stage"] for x in open(tmp_path / "events.jsonl")} == {"gate", "recall", "rerank", "judge"}
    with pytest.raises(ValueError):
        E.Engine(store, "none")
    assert E.dispatch(eng, "recall", {"query": "cats", "k": 1})["hits"][0]["id"] == "c"
    rows = E.dispatch(eng, "replicate", {"since": 1})
    assert rows["next_seq"] == 3 and rows["rows"][0]["text"] == DOCS[1]["text"] and len(rows["rows"][0]["vec"]) == 384
    assert E.dispatch(eng, "watch", {"since": 2})["changes"][0]["doc_id"] == "c" and E.dispatch(eng, "live", {}) == {"changes": [], "next_seq": 3}
    assert "recollect_documents 3" in E.dispatch(eng, "metrics", {})["text"]
    assert store.issues({"r1": 1, "r2": 3}) == ["feed_behind:r1"]
    t = E.read_token(b"k", E.sign(b"k", E.READER, "n1"))
    E.admit(t, "n1", "ping", {})
    with pytest.raises(E.Refused):
        E.admit(t, "n2", "ping", {})
    with pytest.raises(E.Refused):
        E.read_token(b"k", E.sign(b"k", E.READER, seconds=-1))
    assert E.Engine.local(spark, store.path).store.manifest().dim == 384
    with pytest.raises(LookupError):
        E.dispatch(eng, "recommend", {"positive": ["zz"]})
    store.register_node("n", {"role": "replica"})
    store.add_endpoint("n", "host:1")
    assert store.nodes()["n"]["endpoints"] == ["host:1"]


def test_streams(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"id": f"d{i}", "text": f"text {i}", "collection": "c"}) for i in range(5)))
    q = live.ingest(spark, s, str(src), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert s.docs().count() == 5
    seen = []
    q = live.subscribe(spark, str(tmp_path / "s" / "feed"), 2, lambda b, n: seen.extend(r.seq for r in b.collect()), str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen) == [2, 3, 4]
    ev = tmp_path / "ev"
    spark.createDataFrame([(1, i, "a" if i % 3 else "b") for i in range(9)], "context bigint, seq bigint, shape string").write.parquet(str(ev))
    stream = spark.readStream.schema("context bigint, seq bigint, shape string").parquet(str(ev))
    q = live.surprise(stream).writeStream.format("memory").queryName("surprise").option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("surprise").count() == 9
    e = tmp_path / "e"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(e))
    stream = live.sessions(spark.readStream.schema(spark.read.parquet(str(e)).schema).parquet(str(e)))
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "ck4")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sessions").where(F.col("n") > 0).count() > 0
