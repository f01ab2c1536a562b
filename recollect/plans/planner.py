"""A search request as data, and its plan as one DataFrame.

Deviations from an index-driven engine are deliberate: filters are exact and
run before scoring, fusion weights and modes hold everywhere, an arm without
a query is left out, and every order ends in the id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions.text import Analyzer, highlight
from recollect.operators import ann, dense, fusion, lexical
from recollect.plans import filters as f

DEPTH_FACTOR, MAXSIM_FACTOR, MOST_PREFETCH = 4, 8, 3


@dataclass(frozen=True)
class SearchRequest:
    text: str | None = None
    vector: tuple[float, ...] | None = None
    sparse: tuple[tuple[int, float], ...] | None = None
    tokens: tuple[tuple[float, ...], ...] | None = None
    using: str | None = None
    collection: str | None = None
    top_k: int = 10
    filter: object | None = None
    scope: tuple | None = None
    score_threshold: float | None = None
    with_payload: bool = True
    with_vectors: bool = False
    highlight: bool = False
    offset: int = 0
    prefetch: tuple["SearchRequest", ...] = ()
    fusion: tuple[float, float] = (1.0, 1.0)  # dense, lexical
    fusion_mode: str = "rrf"
    exact: bool = False  # all vectors are scored even where there is an approximate index

    @staticmethod
    def from_json(body: dict) -> "SearchRequest":
        known = {k: v for k, v in body.items() if k in SearchRequest.__dataclass_fields__}
        if unknown := set(body) - set(known):
            raise f.InvalidRequest(f"unknown fields: {sorted(unknown)}")
        if "filter" in known:
            known["filter"] = f.from_json(known["filter"])
        for k in ("vector", "scope", "fusion"):
            if known.get(k) is not None:
                known[k] = tuple(known[k])
        for k in ("sparse", "tokens"):
            if known.get(k) is not None:
                known[k] = tuple(tuple(x) for x in known[k])
        known["prefetch"] = tuple(SearchRequest.from_json(p) for p in body.get("prefetch", ()))
        return SearchRequest(**known)


@dataclass
class Corpus:
    """What a plan reads: docs (id, text, collection, ...), vecs (id, vec), and the optional spaces."""

    docs: DataFrame
    vecs: DataFrame | None = None
    named: dict[str, DataFrame] = field(default_factory=dict)
    sparse: DataFrame | None = None
    tokens: DataFrame | None = None
    fields: f.Fields = field(default_factory=f.Fields)
    index: lexical.Index | Callable[[], lexical.Index] | None = None  # a function is called by requests that have a text
    analyzer: Analyzer = lexical.DEFAULT
    ann: ann.Ivf | None = None
    aliases: dict[str, str] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession


def _one(corpus: Corpus, name: str, value, kind: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("query_id", T.IntegerType()), T.StructField(name, kind)])
    return corpus.spark.createDataFrame([(0, value)], schema)


def _scope(corpus: Corpus, r: SearchRequest, extra: DataFrame | None) -> DataFrame | None:
    """The ids that may match, or None for all."""
    if r.filter is None and r.collection is None and r.scope is None and extra is None:
        return None
    docs = corpus.docs
    if r.collection is not None:
        docs = docs.where(F.col("collection") == corpus.aliases.get(r.collection, r.collection))
    if r.filter is not None:
        docs = docs.where(f.compile_filter(r.filter, corpus.fields))
    if r.scope is not None:
        docs = docs.where(F.col("id").isin(*r.scope))
    ids = docs.select("id")
    return ids if extra is None else ids.join(extra.select("id").distinct(), "id", "left_semi")


def ranked(corpus: Corpus, r: SearchRequest, level: int = 0) -> DataFrame:
    """(query_id, id, score, rank), before offset and hydration."""
    if level > MOST_PREFETCH:
        raise f.InvalidRequest(f"prefetch is nested deeper than {MOST_PREFETCH}")
    extra = None
    for p in r.prefetch:
        got = ranked(corpus, p, level + 1).where((F.col("rank") > p.offset) & (F.col("rank") <= p.offset + p.top_k)).select("id")
        extra = got if extra is None else extra.unionByName(got)
    scope = _scope(corpus, r, extra)
    need = r.top_k + r.offset
    fetch = need * (MAXSIM_FACTOR if r.tokens else 1)
    depth = fetch * (DEPTH_FACTOR if r.vector and r.text else 1)
    arms: list[tuple[DataFrame, float]] = []
    if r.vector is not None:
        if r.using and r.using not in corpus.named:
            raise f.InvalidRequest(f"no vector space {r.using!r}")
        if corpus.ann is not None and not r.using and not r.exact:
            arms.append((corpus.ann.search_one(r.vector, depth, scope), r.fusion[0]))
        else:
            vecs = corpus.named[r.using] if r.using else corpus.vecs
            arms.append((dense.search_one(vecs, r.vector, depth, scope), r.fusion[0]))
    if r.text:
        if corpus.index is not None:
            index = corpus.index if isinstance(corpus.index, lexical.Index) else corpus.index()
            scored = lexical.score_text(index, r.text, scope)
        else:
            scored = lexical.bm25(corpus.docs, _one(corpus, "text", r.text, T.StringType()), corpus.analyzer, scope)
        arms.append((lexical.best(scored, depth), r.fusion[1]))
    if len(arms) == 2:
        out = fusion.fuse([a for a in arms if a[1]], fetch, r.fusion_mode)
    elif arms:
        out = arms[0][0]
    else:
        base = corpus.docs.select("id") if scope is None else scope
        w = Window.partitionBy("query_id").orderBy("id")
        few = base.orderBy("id").limit(fetch).select(F.lit(0).alias("query_id"), "id", F.lit(0.0).alias("score"))
        out = few.withColumn("rank", F.row_number().over(w).cast("bigint"))
    if r.sparse and corpus.sparse is None or r.tokens and corpus.tokens is None:
        raise f.InvalidRequest("there are no sparse or token vectors to search")
    if r.sparse:
        q = corpus.spark.createDataFrame([(0, int(d), float(w)) for d, w in r.sparse], "query_id int, dim int, qweight double")
        source = corpus.sparse if scope is None else corpus.sparse.join(scope, "id", "left_semi")
        third = dense.sparse_search(source, q, depth)
        out = fusion.fuse([x for x in ((out, r.fusion[0]), (third, r.fusion[1])) if x[1]], fetch, r.fusion_mode) if arms else third
    if r.tokens:
        q = F.array(*(F.array(*(F.lit(float(x)) for x in t)) for t in r.tokens))
        scored = dense.maxsim(out, corpus.tokens, q)
        w = Window.partitionBy("query_id").orderBy(F.col("maxsim").isNull(), F.desc(F.round("maxsim", 9)), "rank")
        out = scored.select("query_id", "id", F.coalesce("maxsim", "score").alias("score"), F.row_number().over(w).cast("bigint").alias("rank"))
    if r.score_threshold is not None:
        w = Window.partitionBy("query_id").orderBy("rank")
        out = out.where(F.col("score") >= r.score_threshold).withColumn("rank", F.row_number().over(w).cast("bigint"))
    return out


def plan(corpus: Corpus, r: SearchRequest) -> DataFrame:
    """The result page: id, score, rank, then the document's columns, vector and highlights as asked for."""
    page = ranked(corpus, r).where((F.col("rank") > r.offset) & (F.col("rank") <= r.offset + r.top_k))
    page = page.select("id", "score", (F.col("rank") - r.offset).alias("rank"))
    # a page has at most top_k rows, so it goes to the tables and not they to it
    few = F.broadcast(page)
    if r.with_vectors:
        found = corpus.vecs.join(F.broadcast(page.select("id")), "id").select("id", F.col("vec").alias("vector"))
        page = page.join(F.broadcast(found), "id", "left")
        few = F.broadcast(page)
    if r.with_payload:
        page = corpus.docs.join(few, "id")
    if r.highlight and r.text:
        texts = page if r.with_payload else corpus.docs.select("id", "text").join(few, "id")
        page = texts.withColumn("highlights", highlight(F.col("text"), r.text))
        page = page if r.with_payload else page.drop("text")
    return page.orderBy("rank")


def asks_text(r: SearchRequest) -> bool:
    return bool(r.text) or any(map(asks_text, r.prefetch))


def nested(r: SearchRequest, **changes) -> SearchRequest:
    return replace(r, **changes)
