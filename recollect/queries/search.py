"""Vector search, fusion, the planner's options and the strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import vectors as V
from recollect.operators import ann, dense, evaluation, fusion, lexical, strategies
from recollect.plans import filters as f
from recollect.plans import planner
from recollect.queries import query
from recollect.queries.filters import DOCS
from recollect.queries.lexicon import CONTENT, TEXT, TOPICS_SQL, bm25_sql, documents, index_of, top_sql
from recollect.runtime import table

PROBE = 7  # the vector that single searches ask for


def vecs(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def probe(spark, sf):
    return vecs(spark, sf).where(F.col("id") == PROBE).select(F.lit(0).alias("query_id"), F.col("vec").alias("qvec"))


def probe_vector(spark, sf):
    """The probe as a literal, as a caller would pass it; one row by construction."""
    row = probe(spark, sf).first()
    return tuple(float(x) for x in row["qvec"])


def dense_sql(where: str = "true", part: str = "embedding", queries: str = f"SELECT 0 AS query_id, embedding AS q FROM embeddings WHERE vec_id = {PROBE}") -> str:
    q = "q" if part == "embedding" else part.replace("embedding", "q")
    return f"(SELECT query_id, vec_id AS id, coalesce(list_cosine_similarity(CAST({part} AS DOUBLE[]), CAST({q} AS DOUBLE[])), 0) AS score FROM embeddings, ({queries}) WHERE {where})"


def corpus(spark, sf):
    d = documents(spark, sf).withColumn("collection", F.col("lang"))
    v = vecs(spark, sf).select("id", "vec")
    named = {"head": v.select("id", F.slice("vec", 1, 32).alias("vec")), "tail": v.select("id", F.slice("vec", 33, 32).alias("vec"))}
    tokens = v.select("id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("vec", i * 16 + 1, 16)).alias("vecs"))
    from recollect.operators.embed import hashed_terms

    sparse = hashed_terms(d).select("id", F.col("bucket").cast("int").alias("dim"), "weight")
    return planner.Corpus(d, v, named, sparse, tokens, DOCS, lambda: index_of(spark, sf), aliases={"english": "en"})


def _arms(depth: int, where: str = "true", scope: str = "") -> str:
    return f"{bm25_sql(TOPICS_SQL, scope)}, lex AS {top_sql('bm', depth)}, den AS {top_sql(dense_sql(where), depth)}"


def _rrf(a: float = 1.0, b: float = 1.0) -> str:
    return f"fus AS (SELECT query_id, id, sum(w / (60 + rank)) AS score FROM (SELECT query_id, id, rank, {a} AS w FROM den UNION ALL SELECT query_id, id, rank, {b} AS w FROM lex) GROUP BY 1, 2)"


_OUT = "id, round(score, 6) AS score, rank"


def _out(df):
    return df.select("id", F.round("score", 6).alias("score"), "rank")


@query("dense_topk", f"SELECT {_OUT} FROM {top_sql(dense_sql(), 10)}")
def dense_topk(spark, sf):
    return _out(dense.search_one(vecs(spark, sf), probe_vector(spark, sf), 10))


_EVERY = "SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0"


def asked(v):
    """The stated query set of the batch searches: every vector whose id 20 divides, against all of them."""
    return v.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))


@query("dense_topk_batch", f"SELECT query_id, {_OUT} FROM {top_sql(dense_sql(queries=_EVERY), 5)}")
def dense_topk_batch(spark, sf):
    """Blocked products, the k best of each block merged."""
    v = vecs(spark, sf).select("id", "vec")
    return ann.exact_batch(v, asked(v), 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("dense_scoped_label", f"SELECT {_OUT} FROM {top_sql(dense_sql('label IN (1, 3)'), 10)}")
def dense_scoped_label(spark, sf):
    v = vecs(spark, sf)
    return _out(dense.search_one(v, probe_vector(spark, sf), 10, v.where(F.col("label").isin(1, 3)).select("id")))


@query(
    "metric_dot_l1_l2",
    f"""SELECT vec_id AS id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS dot, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS l2,
    round(list_sum(list_transform(list_zip(embedding, q), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS l1 FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = {PROBE})""",
)
def metrics(spark, sf):
    x = vecs(spark, sf).crossJoin(probe(spark, sf))
    v, q = F.col("vec"), F.col("qvec")
    return x.select("id", F.round(V.dot(v, q), 6).alias("dot"), F.round(V.euclidean(v, q), 6).alias("l2"), F.round(V.manhattan(v, q), 6).alias("l1"))


@query("named_space_topk", f"SELECT {_OUT} FROM {top_sql(dense_sql(part='embedding[33:64]'), 10)}")
def named_space(spark, sf):
    c = corpus(spark, sf)
    q = probe(spark, sf).select("query_id", F.slice("qvec", 33, 32).alias("qvec"))
    return _out(dense.search(c.named["tail"], q, 10))


@query("hybrid_rrf", f"WITH {_arms(40)}, {_rrf()} SELECT {_OUT} FROM {top_sql('fus', 10)}")
def hybrid_rrf(spark, sf):
    den = dense.search_one(vecs(spark, sf), probe_vector(spark, sf), 40)
    lex = lexical.best(lexical.score_text(index_of(spark, sf), TEXT), 40)
    return _out(fusion.fuse([(den, 1.0), (lex, 1.0)], 10))


@query("hybrid_rrf_weighted", f"WITH {_arms(40)}, {_rrf(4.0, 1.0)} SELECT {_OUT} FROM {top_sql('fus', 10)}")
def hybrid_weighted(spark, sf):
    r = planner.SearchRequest(text=TEXT, vector=probe_vector(spark, sf), fusion=(4.0, 1.0), with_payload=False)
    return _out(planner.plan(corpus(spark, sf), r))


_DBSF = """sc AS (SELECT 'd' AS arm, * FROM den UNION ALL SELECT 'l' AS arm, * FROM lex),
nm AS (SELECT query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM sc WINDOW w AS (PARTITION BY arm)),
fus AS (SELECT query_id, id, sum(s) AS score FROM nm GROUP BY 1, 2)"""


@query("hybrid_dbsf", f"WITH {_arms(40)}, {_DBSF} SELECT {_OUT} FROM {top_sql('fus', 10)}")
def hybrid_dbsf(spark, sf):
    r = planner.SearchRequest(text=TEXT, vector=probe_vector(spark, sf), fusion_mode="dbsf", with_payload=False)
    return _out(planner.plan(corpus(spark, sf), r))


_SCOPED = "WHERE post.id IN (SELECT doc_id FROM documents WHERE lang = $$en$$ AND n_chars >= 500)"


@query("hybrid_filtered", f"WITH {_arms(40, 'vec_id IN (SELECT doc_id FROM documents WHERE lang = $$en$$ AND n_chars >= 500)', _SCOPED)}, {_rrf()} SELECT {_OUT} FROM {top_sql('fus', 10)}")
def hybrid_filtered(spark, sf):
    r = planner.SearchRequest(text=TEXT, vector=probe_vector(spark, sf), collection="english", filter=f.Range("n_chars", gte=500), with_payload=False)
    return _out(planner.plan(corpus(spark, sf), r))


_SPARSE_Q = ((3, 1.0), (17, 0.5), (101, 2.0), (250, 1.5))
_SPW = f"""hs AS (SELECT doc_id AS id, CAST('0x' || substr(md5(term), 1, 15) AS BIGINT) AS h FROM (SELECT doc_id, unnest({CONTENT}) AS term FROM documents)),
sb AS (SELECT id, h % 384 AS dim, sum(CASE WHEN (h // 384) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS w FROM hs GROUP BY 1, 2), sn AS (SELECT id, sqrt(sum(w * w)) AS n FROM sb GROUP BY 1),
sq AS (SELECT * FROM (VALUES {", ".join(f"({d}, {w})" for d, w in _SPARSE_Q)}) t(dim, qw)),
sp AS (SELECT 0 AS query_id, id, sum(qw * CASE WHEN n > 0 THEN w / n ELSE 0 END) AS score FROM sb JOIN sn USING (id) JOIN sq USING (dim) GROUP BY id)"""


@query("sparse_topk", f"WITH {_SPW} SELECT {_OUT} FROM {top_sql('sp', 20)}")
def sparse_topk(spark, sf):
    q = spark.createDataFrame([(0, d, w) for d, w in _SPARSE_Q], "query_id int, dim int, qweight double")
    return _out(dense.sparse_search(corpus(spark, sf).sparse, q, 20))


@query("hybrid_sparse_third", f"WITH {_arms(40)}, {_rrf()}, {_SPW}, cur AS {top_sql('fus', 10)}, thi AS {top_sql('sp', 40)}, f2 AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM cur UNION ALL SELECT query_id, id, rank FROM thi) GROUP BY 1, 2) SELECT {_OUT} FROM {top_sql('f2', 10)}")
def hybrid_sparse_third(spark, sf):
    r = planner.SearchRequest(text=TEXT, vector=probe_vector(spark, sf), sparse=_SPARSE_Q, with_payload=False)
    return _out(planner.plan(corpus(spark, sf), r))


_SLICES = "[CAST({0}[1:16] AS DOUBLE[]), CAST({0}[17:32] AS DOUBLE[]), CAST({0}[33:48] AS DOUBLE[]), CAST({0}[49:64] AS DOUBLE[])]"
_MAXSIM = f"""list_sum(list_transform({_SLICES.format('q')}, lambda a: list_max(list_transform({_SLICES.format('embedding')}, lambda b: list_inner_product(a, b)))))"""


@query("maxsim_rescore", f"WITH {bm25_sql(TOPICS_SQL)}, pool AS {top_sql('bm', 80)}, m AS (SELECT id, pool.score, rank, {_MAXSIM} AS ms FROM pool LEFT JOIN embeddings ON vec_id = id CROSS JOIN (SELECT embedding AS q FROM embeddings WHERE vec_id = {PROBE})) SELECT id, round(coalesce(ms, score), 6) AS score, row_number() OVER (ORDER BY ms IS NULL, round(ms, 9) DESC, rank) AS rank FROM m QUALIFY rank <= 10".replace("QUALIFY rank", "QUALIFY row_number() OVER (ORDER BY ms IS NULL, round(ms, 9) DESC, m.rank)"))
def maxsim_rescore(spark, sf):
    q = probe_vector(spark, sf)
    r = planner.SearchRequest(text=TEXT, tokens=tuple(q[i * 16 : i * 16 + 16] for i in range(4)), with_payload=False)
    return _out(planner.plan(corpus(spark, sf), r))


@query("prefetch_union_rescore", f"WITH {bm25_sql(TOPICS_SQL)}, pool AS (SELECT id FROM {top_sql('bm', 30)} UNION SELECT id FROM {top_sql(dense_sql('label = 3'), 30)}) SELECT {_OUT} FROM {top_sql(dense_sql('vec_id IN (SELECT id FROM pool)'), 10)}".replace("label = 3", "vec_id IN (SELECT doc_id FROM documents WHERE lang = $$fr$$)"))
def prefetch(spark, sf):
    v = probe_vector(spark, sf)
    stages = (planner.SearchRequest(text=TEXT, top_k=30), planner.SearchRequest(vector=v, top_k=30, collection="fr"))
    return _out(planner.plan(corpus(spark, sf), planner.SearchRequest(vector=v, prefetch=stages, with_payload=False)))


@query("paged_offset", f"WITH {bm25_sql(TOPICS_SQL)} SELECT id, round(score, 6) AS score, rank - 10 AS rank FROM {top_sql('bm', 15)} WHERE rank > 10")
def paged_offset(spark, sf):
    return _out(planner.plan(corpus(spark, sf), planner.SearchRequest(text=TEXT, offset=10, top_k=5, with_payload=False)))


@query("score_threshold", f"SELECT {_OUT} FROM {top_sql(dense_sql(), 50)} WHERE score >= 0.2")
def score_threshold(spark, sf):
    r = planner.SearchRequest(vector=probe_vector(spark, sf), top_k=50, score_threshold=0.2, with_payload=False)
    return _out(planner.plan(corpus(spark, sf), r))


@query("with_payload", f"WITH {bm25_sql(TOPICS_SQL)} SELECT id, round(score, 6) AS score, rank, text, lang, embedding[1] AS first FROM {top_sql('bm', 10)} JOIN documents ON doc_id = id LEFT JOIN embeddings ON vec_id = id")
def with_payload(spark, sf):
    page = planner.plan(corpus(spark, sf), planner.SearchRequest(text=TEXT, with_vectors=True))
    return page.select("id", F.round("score", 6).alias("score"), "rank", "text", "lang", F.get("vector", F.lit(0)).alias("first"))


@query("scope_all_ids", "SELECT doc_id AS id, CAST(0 AS DOUBLE) AS score, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 10")
def scope_all_ids(spark, sf):
    return _out(planner.plan(corpus(spark, sf), planner.SearchRequest(collection="de", with_payload=False)))


@query("grouped_search", f"""WITH {bm25_sql(TOPICS_SQL)}, hit AS {top_sql('bm', 60)}, k AS (SELECT hit.*, source AS group_key FROM hit JOIN documents ON doc_id = id WHERE source IS NOT NULL),
o AS (SELECT group_key, row_number() OVER (ORDER BY min(rank)) AS group_rank FROM k GROUP BY 1)
SELECT group_key, group_rank, row_number() OVER (PARTITION BY group_key ORDER BY rank) AS hit_rank, id, round(score, 6) AS score FROM k JOIN o USING (group_key) WHERE group_rank <= 5 QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY rank) <= 3""")
def grouped_search(spark, sf):
    d = documents(spark, sf)
    hits = lexical.best(lexical.score_text(index_of(spark, sf), TEXT), 60)
    return strategies.grouped(hits, d, "source", 5, 3).withColumn("score", F.round("score", 6))


_UNIT = "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings"
_TARGET = f"SELECT 0 AS query_id, list(x ORDER BY i) AS q FROM (SELECT i, sum(s * u[i]) AS x FROM (SELECT u, CASE WHEN vec_id IN (1, 2, 3) THEN 1.0 ELSE -1.0 END AS s FROM ({_UNIT}) WHERE vec_id IN (1, 2, 3, 9)), range(1, 65) r(i) GROUP BY i)"


@query("recommend", f"SELECT {_OUT} FROM {top_sql(dense_sql('vec_id NOT IN (1, 2, 3, 9)', queries=_TARGET), 10)}")
def recommend(spark, sf):
    v = vecs(spark, sf)
    return _out(strategies.recommend(v, v.where(F.col("id").isin(1, 2, 3)).select("id"), v.where(F.col("id") == 9).select("id"), 10))


_PAIRS = ((1, 2), (3, 4), (5, 6), (8, 999_999_999))
_COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


@query("discover", f"""WITH pool AS (SELECT p.id, p.score, e.embedding FROM {top_sql(dense_sql(), 40)} p JOIN embeddings e ON vec_id = id),
pr AS (SELECT a.embedding AS pv, b.embedding AS nv FROM (VALUES {', '.join(map(str, _PAIRS))}) t(p, n) JOIN embeddings a ON a.vec_id = p JOIN embeddings b ON b.vec_id = n),
v AS (SELECT id, any_value(score) AS score, CAST(sum(CASE WHEN {_COS.format('embedding', 'pv')} > {_COS.format('embedding', 'nv')} THEN 1 ELSE -1 END) AS BIGINT) AS agreement FROM pool, pr GROUP BY id)
SELECT id, round(score, 6) AS score, agreement, row_number() OVER (ORDER BY agreement DESC, round(score, 9) DESC, id) AS rank FROM v ORDER BY rank LIMIT 10""")
def discover(spark, sf):
    pairs = spark.createDataFrame(list(_PAIRS), "pos bigint, neg bigint")
    return strategies.discover(vecs(spark, sf), probe(spark, sf), pairs, 10).withColumn("score", F.round("score", 6)).select("id", "score", "agreement", "rank")


@query("similarity_matrix", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.vec_id IN (2, 4, 6, 8, 10) AND b.vec_id IN (2, 4, 6, 8, 10)")
def similarity_matrix(spark, sf):
    ids = spark.createDataFrame([(i, p) for p, i in enumerate((2, 4, 6, 8, 10, 10**9))], "id bigint, pos int")
    return strategies.similarity_matrix(vecs(spark, sf), ids).withColumn("score", F.round("score", 6))


@query("eval_ndcg_recall_mrr", f"""WITH {bm25_sql(TOPICS_SQL)}, run AS {top_sql('bm', 10)}, rel AS (SELECT doc_id, max(quality) AS g FROM labels GROUP BY 1),
j AS (SELECT rank, coalesce(g, 0) AS g FROM run LEFT JOIN rel ON doc_id = id), ideal AS (SELECT sum((pow(2, g) - 1) / log2(r + 1)) AS best FROM (SELECT g, row_number() OVER (ORDER BY g DESC) AS r FROM rel) WHERE r <= 10)
SELECT 0 AS query_id, round(sum((pow(2, g) - 1) / log2(rank + 1)) / any_value(best), 6) AS ndcg, round(count(*) FILTER (g > 0) / (SELECT count(*) FROM rel WHERE g > 0), 6) AS recall, round(coalesce(1.0 / min(rank) FILTER (g > 0), 0), 6) AS mrr FROM j, ideal""")
def eval_metrics(spark, sf):
    run = lexical.best(lexical.score_text(index_of(spark, sf), TEXT), 10)
    rel = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("gain")).select(F.lit(0).alias("query_id"), F.col("doc_id").alias("id"), "gain")
    out = evaluation.metrics(run, rel, 10)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in ("ndcg", "recall", "mrr")))


@query("sq8_roundtrip", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT *, list_min(v) AS lo, (list_max(v) - list_min(v)) / 255 AS st FROM e)
SELECT vec_id AS id, round(list_max(list_transform(v, lambda x: abs(x - (lo + round((x - lo) / st) * st)))), 6) AS worst, round(st, 9) AS step FROM p""")
def sq8_roundtrip(spark, sf):
    c = vecs(spark, sf).withColumn("c", V.sq8(F.col("vec")))
    worst = F.array_max(F.zip_with(F.col("vec"), V.sq8_decode(F.col("c")), lambda x, y: F.abs(x.cast("double") - y)))
    return c.select("id", F.round(worst, 6).alias("worst"), F.round("c.step", 9).alias("step"))


@query("bq_hamming", f"SELECT vec_id AS id, len(list_filter(list_zip(embedding, q), lambda z: (z[1] >= 0) <> (z[2] >= 0))) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = {PROBE})")
def bq_hamming(spark, sf):
    x = vecs(spark, sf).crossJoin(probe(spark, sf))
    return x.select("id", V.hamming(V.bq(F.col("vec")), V.bq(F.col("qvec"))).cast("bigint").alias("distance"))


_TRUE = f"SELECT query_id, {_OUT} FROM {top_sql(dense_sql(queries=_EVERY), 10)}"


@query("ivf_recall", "SELECT CAST(count(*) AS BIGINT) AS queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def ivf_recall(spark, sf):
    """Whether the cell index finds at least 0.9 of the exact ten nearest, over all queries."""
    v = vecs(spark, sf).select("id", "vec")
    got, true = ivf_topk(spark, sf).select("query_id", "id"), ann.exact_batch(v, asked(v), 10)
    found = true.join(got.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return found.agg(F.countDistinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("reached"))


@query("ivf_topk")
def ivf_topk(spark, sf):
    """Batch search of the cell index."""
    v = vecs(spark, sf).select("id", "vec")
    return ann.Ivf.build(v).search(asked(v), 10)


@query("ivf_scoped", f"SELECT {_OUT} FROM {top_sql(dense_sql('label = 2'), 10)}")
def ivf_scoped(spark, sf):
    """A filtered search of the index with all cells probed is exact."""
    v = vecs(spark, sf)
    index = ann.Ivf.build(v.select("id", "vec"))
    return _out(index.search_one(probe_vector(spark, sf), 10, v.where("label = 2").select("id"), len(index.centroids)))


@query("pq_topk", _TRUE)
def pq_topk(spark, sf):
    """Product codes leave a shortlist open, exact cosine decides, so the result is exact."""
    v = vecs(spark, sf).select("id", "vec")
    return ann.pq_search(v, asked(v), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")
