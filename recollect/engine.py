"""ask: gate, recall, rerank and judge, for one question; and the verbs of a request surface."""

from __future__ import annotations

import hmac
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions.text import content_tokens
from recollect.operators import gate, lexical, provenance, strategies, sufficiency
from recollect.plans import filters as f
from recollect.plans import gql, ql
from recollect.plans.planner import SearchRequest
from recollect.store import Store

RECALL_K, RERANK_K = 20, 5


@dataclass
class Answer:
    turn: str
    label: str
    ready: bool
    confidence: float
    candidates: list[dict] = field(default_factory=list)


#: reranker: (queries (query_id, text), candidates (query_id, id, text, rank, score), k) -> (id, rank, score)
Reranker = Callable[[DataFrame, DataFrame, int], DataFrame]
#: judge: (queries, candidates) -> one row (label, ready, confidence)
Judge = Callable[[DataFrame, DataFrame], DataFrame]


def lexical_reranker(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    terms = queries.select("query_id", F.explode(content_tokens(F.col("text"))).alias("term"))
    return lexical.rerank(terms, candidates, k).select("id", F.col("new_rank").alias("rank"), "score")


def identity_reranker(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    return candidates.where(F.col("rank") <= k).select("id", "rank", "score")


def model_reranker(score: Callable[[list[str], list[str]], list[float]]) -> Reranker:
    """A cross-encoder, as a function of questions and texts, over Arrow batches of candidates."""

    def rerank(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield pd.DataFrame({"query_id": p["query_id"], "id": p["id"], "rank": p["rank"], "score": list(map(float, score(list(p["question"]), list(p["text"].fillna("")))))})

        asked = candidates.join(F.broadcast(queries.select("query_id", F.col("text").alias("question"))), "query_id")
        scored = asked.select("query_id", "question", "id", "text", "rank").mapInPandas(run, "query_id int, id string, rank bigint, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
        return scored.withColumn("new", F.row_number().over(w).cast("bigint")).where(F.col("new") <= k).select("id", F.col("new").alias("rank"), "score")

    return rerank


RERANKERS: dict[str, Reranker] = {"lexical": lexical_reranker, "identity": identity_reranker}


class Engine:
    """``reranker``: a name of ``RERANKERS`` or a function; ``judge``: a function, by default the coverage of the question's words."""

    def __init__(self, store: Store, reranker: str | Reranker = "lexical", sink=None, judge: Judge = sufficiency.coverage):
        if isinstance(reranker, str) and reranker not in RERANKERS:
            raise f.InvalidRequest(f"unknown reranker {reranker!r}")
        self.rerank = RERANKERS[reranker] if isinstance(reranker, str) else reranker
        self.store, self.sink, self.judge = store, sink, judge

    @staticmethod
    def local(spark: SparkSession, path: str, **options) -> "Engine":
        """A store in a folder with the built-in embedder; refuses one whose vectors have another dimension."""
        store = Store(spark, path)
        held = store.manifest().dim
        if held is not None and held != getattr(store.embedder, "dim", held):
            raise f.InvalidRequest(f"the store holds vectors of {held} dimensions, the embedder makes {store.embedder.dim}")
        return Engine(store, **options)

    def _tell(self, turn: str, stage: str, **fields) -> None:
        if self.sink:
            self.sink({"turn": turn, "stage": stage, **fields})

    def ask(self, question: str) -> Answer:
        spark, turn = self.store.spark, uuid.uuid4().hex
        q = spark.createDataFrame([(0, question)], "query_id int, text string")
        verdict = q.select(gate.verdict(F.col("text"))).first()[0]
        self._tell(turn, "gate", verdict=verdict)
        if verdict == "block":
            return Answer(turn, "gated", False, 0.0)
        vec = self.store.embedder.queries(q.select(F.col("query_id").alias("id"), "text")).first()["vec"]
        page = self.store.query(SearchRequest(text=question, vector=tuple(vec), top_k=RECALL_K))
        found = page.select(F.lit(0).alias("query_id"), "id", "rank", "text", "score").toPandas()  # at most RECALL_K rows
        self._tell(turn, "recall", n=len(found))
        held = spark.createDataFrame(found.to_dict("records") or [], "query_id int, id string, rank bigint, text string, score double")
        if len(found):
            held = self.rerank(q, held, RERANK_K).join(held.select("query_id", "id", "text"), "id")
        self._tell(turn, "rerank", n=min(len(found), RERANK_K))
        judged = self.judge(q, held).first()
        self._tell(turn, "judge", label=judged["label"])
        rows = [r.asDict() for r in held.orderBy("rank").select("id", "text", "score", "rank").collect()]
        return Answer(turn, judged["label"], judged["ready"], judged["confidence"], rows)


READER, WRITER, ADMIN = "reader", "writer", "admin"
_LEVEL = {READER: 0, WRITER: 1, ADMIN: 2}
_NEEDS = {
    **dict.fromkeys("ping ask recall replicate watch live metrics query recommend discover map graphql changes traverse health info matrix sample collections aliases sql".split(), READER),
    **dict.fromkeys("index tx relate set_payload overwrite_payload delete_payload_keys clear_payload".split(), WRITER),
    **dict.fromkeys("flush compact drop_collection create_alias delete_alias".split(), ADMIN),
}


class Refused(PermissionError):
    pass


def sign(secret: bytes, role: str, namespace: str = "*", seconds: float | None = None) -> str:
    """A token for one namespace or, by "*", all; with ``seconds`` it expires."""
    until = None if seconds is None else time.time() + seconds
    body = json.dumps({"role": role, "ns": namespace, "until": until}, sort_keys=True).encode()
    return body.hex() + "." + hmac.new(secret, body, sha256).hexdigest()


def read_token(secret: bytes, token: str) -> dict:
    body, _, mac = token.partition(".")
    try:
        raw = bytes.fromhex(body)
    except ValueError as e:
        raise Refused("bad token") from e
    if not hmac.compare_digest(mac, hmac.new(secret, raw, sha256).hexdigest()):
        raise Refused("bad token")
    claims = json.loads(raw)
    if claims.get("until") is not None and time.time() >= claims["until"]:
        raise Refused("the token has expired")
    return claims


def admit(claims: dict, namespace: str, verb: str, body: dict) -> None:
    """Whether the bearer of a token may have a verb run in a namespace."""
    if claims["ns"] not in ("*", namespace):
        raise Refused(f"the token isn't for {namespace!r}")
    authorize(claims["role"], verb, body)


def authorize(role: str, verb: str, body: dict) -> None:
    need = _NEEDS.get(verb)
    if need is None:
        raise f.InvalidRequest(f"unknown verb {verb!r}")
    if verb == "sql" and not isinstance(s := ql.parse(body.get("q", "")), ql.Select) and s.is_write:
        need = WRITER
    if verb == "graphql" and gql.parse(body.get("q", ""))[0] == "mutation":
        need = WRITER
    if _LEVEL[role] < _LEVEL[need]:
        raise Refused(f"{verb} needs {need}")


def dispatch(engine: Engine, verb: str, body: dict, role: str = ADMIN) -> dict:
    """One request: results are pages, so what returns to the driver is bounded by limits in the request."""
    authorize(role, verb, body)
    store = engine.store
    page = lambda df, n=4096: [r.asDict(True) for r in df.limit(n).collect()]
    match verb:
        case "ping":
            return {"pong": True}
        case "ask":
            return engine.ask(body["query"]).__dict__
        case "recall":
            q = store.spark.createDataFrame([("q", body["query"])], "id string, text string")
            vec = tuple(store.embedder.queries(q).first()["vec"])
            return {"hits": page(store.query(SearchRequest(text=body["query"], vector=vec, top_k=int(body.get("k", RECALL_K)))))}
        case "replicate":
            rows = page(store.replication_page(int(body.get("since", 0)), min(4096, int(body.get("limit", 256)))))
            return {"rows": rows, "next_seq": rows[-1]["seq"] + 1 if rows else int(body.get("since", 0))}
        case "watch" | "live":
            since = body.get("since")
            since = store.manifest().next_seq if since is None else int(since)
            rows = page(store.changes(since, 256))
            return {"changes": rows, "next_seq": rows[-1]["seq"] + 1 if rows else since}
        case "metrics":
            return {"text": metrics(store)}
        case "query":
            return {"hits": page(store.query(SearchRequest.from_json(body)))}
        case "recommend":
            named = lambda ids: store.spark.createDataFrame([(i,) for i in ids], "id string") if ids else None
            hits = strategies.recommend(store.table("vecs"), named(body["positive"]), named(body.get("negative", [])), int(body.get("top_k", 10)))
            return {"hits": page(hits.drop("query_id").orderBy("rank"))}
        case "discover":
            q = store.spark.createDataFrame([(0, body["vector"])], "query_id int, qvec array<double>")
            pairs = store.spark.createDataFrame([tuple(p) for p in body["pairs"]], "pos string, neg string")
            return {"hits": page(strategies.discover(store.table("vecs"), q, pairs, int(body.get("top_k", 10))).orderBy("rank"))}
        case "map":
            return {"dot": provenance.dot(body["query"], engine.ask(body["query"]))}
        case "graphql":
            return gql.execute(store, body["q"])
        case "changes":
            rows = page(store.changes(int(body.get("since", 0)), min(4096, int(body.get("limit", 256)))))
            return {"changes": rows, "next_seq": rows[-1]["seq"] + 1 if rows else int(body.get("since", 0))}
        case "sql":
            out = store.sql(body["q"])
            return {"rows": page(out)} if isinstance(out, DataFrame) else out
        case "index":
            return {"indexed": store.upsert(store.frame(body["docs"]))}
        case "tx":
            return {"applied": store.transaction(body["ops"])}
        case "relate":
            store.relate(body["from"], body["verb"], body["to"])
        case "traverse":
            return {"ids": page(store.sql(f"TRAVERSE `{body['start']}` <-> DEPTH {int(body.get('depth', 2))}"))}
        case "set_payload":
            store.set_metadata(body["id"], body["metadata"])
        case "overwrite_payload":
            store.overwrite_metadata(body["id"], body["metadata"])
        case "delete_payload_keys":
            store.delete_metadata_keys(body["id"], body["keys"])
        case "clear_payload":
            store.clear_metadata(body["id"])
        case "collections":
            return {"collections": page(store.docs().where("collection is not null").groupBy("collection").count().orderBy("collection"))}
        case "sample":
            key = F.md5(F.concat(F.lit(f"{body.get('seed', 0)}:"), "id"))
            return {"docs": page(store.docs().orderBy(key, "id"), int(body.get("n", 10)))}
        case "matrix":
            ids = store.spark.createDataFrame([(i, p) for p, i in enumerate(body["ids"])], "id string, pos int")
            return {"pairs": page(strategies.similarity_matrix(store.table("vecs"), ids))}
        case "create_alias":
            store.create_alias(body["alias"], body["collection"])
        case "delete_alias":
            return {"removed": store.delete_alias(body["alias"])}
        case "aliases":
            return {"aliases": store.manifest().aliases}
        case "drop_collection":
            return {"removed": store.drop_collection(body["collection"])}
        case "compact":
            store.compact()
        case "flush":
            pass  # every write is published when it returns
        case "health":
            return {"issues": store.issues(), **store.info()}
        case "info":
            return store.info()
    return {"ok": True}


def metrics(store: Store) -> str:
    """The store's gauges in the text form that scrapers read."""
    info, sizes = store.info(), store.sizes()
    lines = [("recollect_documents", "", info["docs"]), ("recollect_feed_next_seq", "", info["next_seq"]), ("recollect_version", "", info["version"]), ("recollect_issues", "", len(store.issues()))]
    lines += [("recollect_table_bytes", f'{{table="{k}"}}', v) for k, v in sorted(sizes.items())]
    out, seen = [], set()
    for name, label, value in lines:
        if name not in seen:
            out.append(f"# TYPE {name} gauge")
            seen.add(name)
        out.append(f"{name}{label} {value}")
    return "\n".join(out) + "\n"


class JsonEvents:
    """An event sink: a JSON line each, in a file of the driver."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, event: dict) -> None:
        with open(self.path, "a") as fh:
            fh.write(json.dumps({"at_ms": int(time.time() * 1000), **event}) + "\n")
