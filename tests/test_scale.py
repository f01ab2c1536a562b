"""What shows only in larger tables, in small."""

from collections import Counter
from hashlib import md5

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.catalogue import QUERIES, SQL
from recollect.functions import text as T
from recollect.operators import baseline, gate, lexical
from recollect.operators.embed import hashed_terms
from recollect.queries import search
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def faded(spark, tmp_path_factory):
    """Events of which the later half lies so far from the first that all of the first has faded to 0."""
    at = tmp_path_factory.mktemp("faded")
    e = spark.read.parquet(f"{SF}/events.parquet")
    later = e.withColumns({"event_id": F.col("event_id") + 2_000_000, "user_id": F.col("user_id") + 1_000_000})
    e.unionByName(later).coalesce(1).write.parquet(f"{at}/events.parquet")
    return str(at)


def test_a_faded_context_has_no_shares(spark, faded):
    compare(spark, QUERIES["baseline_distribution"], SQL["baseline_distribution"], faded)
    empty = spark.createDataFrame([], "context string, shape string, n bigint, w double, last bigint")
    obs = spark.createDataFrame([("old", "a", 0), ("new", "a", 2_000_000)], "context string, shape string, seq bigint")
    shares = {r.context: r.share for r in baseline.restored(baseline.merge(empty, obs)).collect()}
    assert shares["old"] != shares["old"] and shares["new"] == 1.0


def test_predictability_of_a_faded_context(spark, faded):
    compare(spark, QUERIES["predictability"], SQL["predictability"], faded)


def test_speculation_over_faded_contexts(spark, faded):
    compare(spark, QUERIES["speculation"], SQL["speculation"], faded)


def test_votes_for_a_family_are_counted_once(spark):
    compare(spark, QUERIES["family_identify"], SQL["family_identify"], SF)
    plan = QUERIES["family_identify"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mailbox") == 1 and plan.count("latitude") == 1
    keys = [["Subject", "to_all"], ["too", "title\n"], [None, "amount", "price_eur"], [], None, ["duration_ms"], ["made_at", "x"]]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k array<string>")
    got = [r.f for r in df.select("i", gate.family(F.col("k")).alias("f")).orderBy("i").collect()]
    assert got == ["mail", "unshaped", "record", "unshaped", None, "event", "event"]


def test_postings_are_stored_without_a_shuffle(spark, tmp_path):
    """The texts are read once for them, and each file has its own documents, sorted by term."""
    texts = ["b a b", None, "", "a c", "the of"] * 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string").repartition(4)
    tf = Counter((r.id, r.term, r.tf, r.doc_len) for r in lexical.postings(docs).collect())
    words = [[w for w in (t or "").split() if w not in T.STOP_WORDS] for t in texts]
    assert tf == Counter((i, w, n, len(ws)) for i, ws in enumerate(words) for w, n in Counter(ws).items())
    index = lexical.Index.write(docs, str(tmp_path / "index"))
    files = [[(r.term, r.id) for r in spark.read.parquet(p).collect()] for p in sorted(map(str, (tmp_path / "index/postings").glob("*.parquet")))]
    assert len(files) == 4 and all(f == sorted(f) for f in files) and not set.intersection(*({i for _, i in f} for f in files))
    assert index.n_docs == len(texts) and {r.term: r.df for r in index.terms.collect()} == Counter(w for ws in words for w in set(ws))


def test_pieces_hold_whole_lists(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 3)
    lists = [["a"] * n for n in (1, 2, 9, 0, 1, 1, 1, 4)] + [None]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["id", "ts"])
    parts = list(lexical.slices(iter([b, b.slice(2, 3)]), 1))
    assert [x for p in parts for x in p.column(1).to_pylist()] == lists + lists[2:5] and max(p.num_rows for p in parts) < 6
    for p in parts:
        row, code, n, words, sizes = lexical.counts(p)
        assert [(r, words[c].as_py(), k) for r, c, k in zip(row.tolist(), code.tolist(), n.tolist())] == [(i, "a", len(x)) for i, x in enumerate(p.column(1).to_pylist()) if x]
        assert sizes.tolist() == [len(x or []) for x in p.column(1).to_pylist()]


def test_a_page_without_text_builds_no_index(spark, monkeypatch):
    monkeypatch.setattr(search, "index_of", lambda *_: pytest.fail("the postings were built"))
    compare(spark, QUERIES["scope_all_ids"], SQL["scope_all_ids"], SF)
    plan = QUERIES["scope_all_ids"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_a_named_space_builds_no_index(spark, monkeypatch):
    monkeypatch.setattr(search, "index_of", lambda *_: pytest.fail("the postings were built"))
    compare(spark, QUERIES["named_space_topk"], SQL["named_space_topk"], SF)


def test_hashed_tokens_are_summed_where_they_are(spark):
    """No row a token or a bucket is shuffled, and rows of one id count together."""
    texts = [(1, "cat dog"), (1, "cat"), (2, "the"), (3, None), (None, "cat"), (4, "Ünder ünder dog")]
    docs = spark.createDataFrame(texts, "id bigint, text string")
    df = hashed_terms(docs)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and "Join" not in df._jdf.queryExecution().executedPlan().toString()
    want = Counter()
    for i, t in texts:
        for w in (t or "").lower().split():
            if i and w not in T.STOP_WORDS:
                h = int(md5(w.encode()).hexdigest()[:15], 16)
                want[i, h % 384] += 1 if h // 384 % 2 == 0 else -1
    norm = {i: sum(x * x for (j, _), x in want.items() if j == i) ** 0.5 for i, _ in want}
    assert {(r.id, r.bucket): round(r.weight, 9) for r in df.collect()} == {(i, b): round(x / norm[i], 9) for (i, b), x in want.items()}


def test_a_sparse_search_builds_no_postings(spark, monkeypatch):
    monkeypatch.setattr(search, "index_of", lambda *_: pytest.fail("the postings were built"))
    compare(spark, QUERIES["sparse_topk"], SQL["sparse_topk"], SF)


def test_a_scan_reads_the_texts_once(spark, monkeypatch):
    compare(spark, QUERIES["bm25_scan"], SQL["bm25_scan"], SF)
    assert "documents.parquet" not in QUERIES["bm25_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["cat dog", "cat", None, "", "dog dog eel", "cat"] * 9)], "id bigint, text string")
    asked = spark.createDataFrame([("a", "the cat"), ("b", "dog eel"), ("c", None), ("d", "yak")], "query_id string, text string")
    rows = lambda df: sorted((r.query_id, r.id, round(r.score, 9), r["rank"]) for r in df.collect())
    want = rows(lexical.top(lexical.bm25(docs, asked), 20))
    monkeypatch.setattr(lexical, "BLOCK", 7)
    assert want and rows(lexical.scan(docs, asked, 20)) == want and rows(lexical.scan(docs.limit(0), asked, 2)) == []
    assert rows(lexical.scan(docs, asked.limit(0), 2)) == []
    monkeypatch.setattr(lexical, "MOST_QUERIES", 1)
    assert rows(lexical.scan(docs, asked, 20)) == want


def test_a_batch_is_scored_in_blocks(spark):
    for name in ("bm25_batch", "sufficiency_coverage"):
        compare(spark, QUERIES[name], SQL[name], SF)
    plan = QUERIES["bm25_batch"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "documents.parquet" not in plan
