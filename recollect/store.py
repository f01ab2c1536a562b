"""A store: a folder of Parquet tables and a manifest that names their current version.

Writers stage new files and then replace the manifest in one rename, so a
reader sees a version whole or not at all. One writer at a time holds the lock
file. The folder must be one that all executors reach; it is read and written
through Hadoop, so any of its file systems will do.

Tables keyed by id (docs, vecs, spaces, sparse, tokens) are a base and deltas:
a write adds a small file set in which a row replaces the id's older ones or
marks it gone, and after ``MOST_DELTAS`` of them the table is merged into a new
base. So a write costs what it brings, not what the store holds. The others
(edges, tags, trends, feed) are appended to.

``metadata`` is JSON text; indexed fields also get typed columns that scans can
prune by. Postings and the cell index are stored beside the tables, each with
the version it was made from; a stale one isn't used.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.files import Folder
from recollect.functions import values
from recollect.functions.text import Analyzer
from recollect.operators import ann, graph, lexical, writes
from recollect.operators.embed import HashEmbedder
from recollect.plans import filters as f
from recollect.plans import planner, ql
from recollect.runtime import cut

SCHEMAS = {
    "docs": "id string, text string, metadata string, collection string",
    "vecs": "id string, vec array<float>",
    "spaces": "id string, spaces map<string,array<float>>",
    "sparse": "id string, entries array<struct<dim:int,weight:double>>",
    "tokens": "id string, vecs array<array<float>>",
    "edges": "src string, verb string, dst string",
    "tags": "tag string, id string",
    "trends": "metric string, at_ns bigint, value double",
    "feed": "seq bigint, op string, doc_id string, at_ms bigint",
    "baseline": "context string, shape string, n bigint, w double, last bigint",
}
KEYED, EXTRA = ("docs", "vecs", "spaces", "sparse", "tokens"), ("spaces", "sparse", "tokens")
#: Column of a batch that each extra table is filled from.
_FROM = {"spaces": "spaces", "sparse": "sparse", "tokens": "tokens"}
_KIND = {"spaces": "map<string,array<float>>", "sparse": "array<struct<dim:int,weight:double>>", "tokens": "array<array<float>>"}
MOST_DELTAS, ANN_FROM = 8, 1024
_NAME = re.compile(r"^[A-Za-z0-9_][A-Za-z0-9_-]{0,63}$")


class StoreError(RuntimeError):
    pass


class QuotaExceeded(StoreError):
    pass


class SchemaViolation(StoreError):
    pass


class NotFound(StoreError):
    pass


@dataclass(frozen=True)
class Quotas:
    max_docs: int | None = None
    max_payload_bytes: int | None = None
    max_top_k: int | None = None
    max_batch: int | None = None

    @staticmethod
    def strict() -> "Quotas":
        return Quotas(max_payload_bytes=64 << 10, max_top_k=1024, max_batch=4096)


@dataclass
class Manifest:
    name: str = "store"
    version: int = 0
    dim: int | None = None
    next_seq: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    schema: dict[str, dict[str, str]] = field(default_factory=dict)
    indexes: list[str] = field(default_factory=list)
    nodes: dict[str, dict] = field(default_factory=dict)
    connectors: dict[str, dict] = field(default_factory=dict)
    components: dict[str, object] = field(default_factory=dict)
    analyzer: dict[str, object] = field(default_factory=dict)
    postings: dict[str, object] = field(default_factory=dict)
    cells: dict[str, object] = field(default_factory=dict)
    retired: list[str] = field(default_factory=list)


class Store:
    """``analyzer`` is fixed when the store is first written; another one is refused then."""

    def __init__(self, spark: SparkSession, path: str, quotas: Quotas = Quotas(), embedder=None, analyzer: Analyzer | None = None):
        self.spark, self.path, self.quotas, self.embedder = spark, path, quotas, embedder or HashEmbedder()
        self.folder = Folder(spark, path)
        self.folder.make()
        kept = self.manifest().analyzer
        if kept and analyzer is not None and Analyzer(**kept) != analyzer:
            raise StoreError("the store was made with another analyzer")
        self.analyzer = Analyzer(**kept) if kept else analyzer or lexical.DEFAULT

    # manifest

    def manifest(self) -> Manifest:
        if not self.folder.exists("manifest.json"):
            return Manifest(name=self.path.rstrip("/").rsplit("/", 1)[-1])
        return Manifest(**json.loads(self.folder.read("manifest.json")))

    def _publish(self, m: Manifest) -> None:
        m.version += 1
        m.analyzer = asdict(self.analyzer)
        self.folder.replace("manifest.json", json.dumps(asdict(m), indent=1, sort_keys=True))

    @contextmanager
    def _writing(self):
        """The manifest, to be changed and published under the lock; what raises inside changes nothing."""
        if not self.folder.create("writer.lock"):
            raise StoreError("another writer holds the store")
        try:
            m = self.manifest()
            yield m
            self._publish(m)
        finally:
            self.folder.delete("writer.lock")

    def _stage(self, table: str, df: DataFrame) -> str:
        name = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(self.folder.at(name))
        return name

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(self.folder.at(part))

    def table(self, name: str, m: Manifest | None = None) -> DataFrame:
        m = m or self.manifest()
        parts = m.tables.get(name, [])
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        if name not in KEYED:
            return self.spark.read.parquet(*map(self.folder.at, parts))
        base = self._read(parts[0])
        if len(parts) > 1:
            later = None
            for i, part in enumerate(parts[1:]):
                delta = self._read(part).withColumn("delta", F.lit(i))
                later = delta if later is None else later.unionByName(delta, allowMissingColumns=True)
            last = writes.last_of_batch(later, order="delta").drop("delta")
            base = base.join(last.select("id"), "id", "left_anti").unionByName(last, allowMissingColumns=True)
        return base.where("not gone").drop("gone")

    def _add(self, m: Manifest, name: str, delta: DataFrame) -> None:
        """``delta`` (columns of the table, gone) on top of a keyed table."""
        m.tables.setdefault(name, []).append(self._stage(name, delta))
        if len(m.tables[name]) > MOST_DELTAS:
            self._merge(m, name)

    def _merge(self, m: Manifest, name: str) -> None:
        merged = self.table(name, m)
        if name in KEYED:
            merged = merged.withColumn("gone", F.lit(False))
        m.tables[name] = [self._stage(name, merged)]

    # documents

    def docs(self, m: Manifest | None = None) -> DataFrame:
        return self.table("docs", m).select("id", "text", "metadata", "collection")

    def count(self) -> int:
        return self.docs().count()

    def count_where(self, condition: object) -> int:
        c = self.corpus()
        return c.docs.where(f.compile_filter(condition, c.fields)).count()

    def scroll(self, after: str | None = None, limit: int = 256) -> DataFrame:
        """A page of documents in id order, strictly after an id."""
        docs = self.docs()
        return (docs if after is None else docs.where(F.col("id") > after)).orderBy("id").limit(limit)

    def _check(self, batch: DataFrame, m: Manifest) -> None:
        q = self.quotas
        if q.max_batch is not None and batch.count() > q.max_batch:
            raise QuotaExceeded(f"a batch has at most {q.max_batch} documents")
        if q.max_payload_bytes is not None:
            size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("metadata"), F.lit(0))
            if not batch.where(size > q.max_payload_bytes).isEmpty():
                raise QuotaExceeded(f"a document has at most {q.max_payload_bytes} bytes")
        for collection, fields in m.schema.items():
            rows = batch.where(F.col("collection") == collection).withColumn("md", F.try_parse_json("metadata"))
            for name, kind in fields.items():
                if not rows.where(~values.matches_type(F.col("md"), name, kind)).isEmpty():
                    raise SchemaViolation(f"{collection}.{name} must be {kind}")

    def _append_feed(self, m: Manifest, op: str, ids: DataFrame) -> int:
        """Feed rows in id order with consecutive numbers: ranks within ranges of ids, and an offset a range."""
        placed = ids.select("id").repartitionByRange("id").sortWithinPartitions("id")
        placed = cut(placed.select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")))
        ranges = placed.groupBy("p").agg(F.count("*").alias("n"), F.min("i").alias("low"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
        numbered = placed.join(F.broadcast(ranges.select("p", "low", before.alias("before"))), "p")
        seq = F.col("before") + F.col("i") - F.col("low") + m.next_seq
        rows = numbered.select(seq.cast("bigint").alias("seq"), F.lit(op).alias("op"), F.col("id").alias("doc_id"), F.lit(int(time.time() * 1000)).cast("bigint").alias("at_ms"))
        n = placed.count()
        if n:
            m.tables.setdefault("feed", []).append(self._stage("feed", rows))
        m.next_seq += n
        return n

    def _typed(self, docs: DataFrame, m: Manifest) -> DataFrame:
        md = F.try_parse_json("metadata")
        made = {name: c for key in m.indexes for name, c in f.index_columns(md, key).items()}
        return docs.withColumns(made) if made else docs

    def _rows(self, batch: DataFrame) -> DataFrame:
        """The columns that a store keeps, one row an id: of equal ids the last by ``pos``, if given, wins."""
        string = lambda c: (F.col(c) if c in batch.columns else F.lit(None)).cast("string").alias(c)
        vec = F.col("vec").cast("array<float>") if "vec" in batch.columns else F.lit(None).cast("array<float>")
        extra = [F.col(_FROM[t]).cast(_KIND[t]).alias(_FROM[t]) for t in EXTRA if _FROM[t] in batch.columns]
        rows = batch.select(*map(string, ("id", "text", "metadata", "collection")), vec.alias("vec"), *extra, F.col("pos") if "pos" in batch.columns else F.lit(0).alias("pos"))
        return writes.last_of_batch(rows.where("id is not null")).drop("pos")

    def _apply(self, m: Manifest, rows: DataFrame | None, gone: DataFrame | None) -> int:
        """Writes and removals, disjoint in their ids, staged into the manifest; returns the number of feed rows."""
        staged = None
        if rows is not None:
            self._check(rows, m)
            missing = self.embedder.documents(rows.where("vec is null").select("id", "text")).withColumnRenamed("vec", "made")
            vecs = rows.join(missing, "id", "left").select("id", F.coalesce("vec", "made").alias("vec"))
            staged = cut(rows.drop("vec").join(vecs, "id"))
            dims = [r["d"] for r in staged.select(F.size("vec").alias("d")).distinct().limit(3).collect()]
            if m.dim is None and len(dims) == 1:
                m.dim = dims[0]
            if any(d != m.dim for d in dims):
                raise SchemaViolation(f"vectors must have {m.dim} dimensions, got {sorted(dims)}")
        if gone is not None:
            gone = cut(self.docs(m).select("id").join(gone.select("id").distinct(), "id", "left_semi"))
        n = 0
        feed = [("upsert", staged), ("remove", gone)]
        for name in KEYED:
            if name in EXTRA and not m.tables.get(name) and (staged is None or _FROM[name] not in staged.columns):
                continue
            deltas = []
            if staged is not None:
                deltas.append(self._delta(name, staged, m))
            if gone is not None:
                empty = self.spark.createDataFrame([], SCHEMAS[name])
                deltas.append(gone.join(empty, "id", "left").select(*empty.columns).withColumn("gone", F.lit(True)))
            delta = deltas[0] if len(deltas) == 1 else deltas[0].unionByName(deltas[1], allowMissingColumns=True)
            self._add(m, name, delta)
        if self.quotas.max_docs is not None and staged is not None and self.table("docs", m).count() > self.quotas.max_docs:
            raise QuotaExceeded(f"a store has at most {self.quotas.max_docs} documents")
        for op, ids in feed:
            n += self._append_feed(m, op, ids) if ids is not None else 0
        return n

    def _delta(self, name: str, staged: DataFrame, m: Manifest) -> DataFrame:
        if name == "docs":
            return self._typed(staged.select("id", "text", "metadata", "collection"), m).withColumn("gone", F.lit(False))
        if name == "vecs":
            return staged.select("id", "vec", F.lit(False).alias("gone"))
        column, own = _FROM[name], SCHEMAS[name].split(", ")[1].split()[0]
        value = F.col(column) if column in staged.columns else F.lit(None).cast(_KIND[name])
        return staged.select("id", value.alias(own)).withColumn("gone", F.col(own).isNull())  # what an upsert doesn't bring goes

    def upsert(self, batch: DataFrame) -> int:
        """``batch`` (id, text?, metadata?, collection?, vec?, spaces?, sparse?, tokens?) replaces documents by id."""
        with self._writing() as m:
            return self._apply(m, self._rows(batch), None)

    def remove(self, ids: list[str] | DataFrame) -> int:
        """Removes documents; ids that are not there are passed over. Edges and tags stay."""
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        with self._writing() as m:
            return self._apply(m, None, gone)

    def transaction(self, ops: list[dict]) -> int:
        """[{"upsert": [doc, ...]} | {"remove": id}]: the last operation on each id decides; all in one version or nothing."""
        last: dict[str, dict | None] = {}
        for op in ops:
            if "upsert" in op:
                for d in op["upsert"]:
                    last.pop(d["id"], None)
                    last[d["id"]] = d
            elif "remove" in op:
                last[op["remove"]] = None
            else:
                raise f.InvalidRequest(f"unknown operation {sorted(op)}")
        put = [{**d, "pos": i} for i, d in enumerate(last.values()) if d]
        out = [(i,) for i, d in last.items() if d is None]
        with self._writing() as m:
            return self._apply(m, self._rows(self.frame(put)) if put else None, self.spark.createDataFrame(out, "id string") if out else None)

    def frame(self, docs: list[dict]) -> DataFrame:
        rows = [(d["id"], d.get("text"), json.dumps(d["metadata"]) if d.get("metadata") is not None else None, d.get("collection"), d.get("vec"), int(d.get("pos", i))) for i, d in enumerate(docs)]
        base = self.spark.createDataFrame(rows, "id string, text string, metadata string, collection string, vec array<float>, pos int")
        some = [t for t in EXTRA if any(d.get(_FROM[t]) is not None for d in docs)]
        if not some:
            return base
        fold = lambda t, v: [tuple(x) for x in v] if t == "sparse" and v is not None else v
        more = [(int(d.get("pos", i)), *(fold(t, d.get(_FROM[t])) for t in some)) for i, d in enumerate(docs)]
        return base.join(self.spark.createDataFrame(more, "pos int, " + ", ".join(f"{_FROM[t]} {_KIND[t]}" for t in some)), "pos")

    def _edit(self, id_: str, change) -> None:
        with self._writing() as m:
            row = self.docs(m).where(F.col("id") == id_).first()
            if row is None:
                raise NotFound(id_)
            md = change(json.loads(row["metadata"]) if row["metadata"] else {})
            one = self.frame([{"id": id_, "text": row["text"], "metadata": md, "collection": row["collection"]}]).select("id", "text", "metadata", "collection")
            self._check(one, m)
            self._add(m, "docs", self._delta("docs", one, m))
            self._append_feed(m, "upsert", one)

    def set_metadata(self, id_: str, patch: dict) -> None:
        self._edit(id_, lambda md: md | patch)

    def overwrite_metadata(self, id_: str, metadata: dict) -> None:
        self._edit(id_, lambda md: dict(metadata))

    def delete_metadata_keys(self, id_: str, keys: list[str]) -> None:
        self._edit(id_, lambda md: {k: v for k, v in md.items() if k not in keys})

    def clear_metadata(self, id_: str) -> None:
        self._edit(id_, lambda md: {})

    # definitions

    def define_index(self, name: str) -> None:
        """Typed columns of a metadata field, for documents there are and to come."""
        with self._writing() as m:
            if name not in m.indexes:
                m.indexes.append(name)
                self._retype(m)

    def rebuild_index(self, name: str) -> None:
        with self._writing() as m:
            if name not in m.indexes:
                raise NotFound(f"{name} is not indexed")
            self._retype(m)

    def _retype(self, m: Manifest) -> None:
        if m.tables.get("docs"):
            m.tables["docs"] = [self._stage("docs", self._typed(self.docs(m), m).withColumn("gone", F.lit(False)))]

    def indexes(self) -> list[str]:
        return sorted(self.manifest().indexes)

    def create_alias(self, alias: str, collection: str) -> None:
        with self._writing() as m:
            m.aliases[alias] = collection

    def delete_alias(self, alias: str) -> bool:
        with self._writing() as m:
            return m.aliases.pop(alias, None) is not None

    def define_field(self, collection: str, name: str, kind: str) -> None:
        if kind not in values.FIELD_TYPES:
            raise f.InvalidRequest(f"unknown type {kind}")
        with self._writing() as m:
            m.schema.setdefault(collection, {})[name] = kind

    def remove_field(self, collection: str, name: str) -> bool:
        with self._writing() as m:
            return m.schema.get(collection, {}).pop(name, None) is not None

    def fields(self, collection: str) -> dict[str, str]:
        return dict(self.manifest().schema.get(collection, {}))

    def drop_collection(self, name: str) -> int:
        return self.remove(self.docs().where(F.col("collection") == name).select("id"))

    def put_component(self, key: str, value: object) -> None:
        with self._writing() as m:
            m.components[key] = value

    def component(self, key: str) -> object:
        return self.manifest().components.get(key)

    def register_node(self, id_: str, info: dict) -> None:
        with self._writing() as m:
            m.nodes[id_] = {"endpoints": [], **info}

    def add_endpoint(self, id_: str, endpoint: str) -> None:
        with self._writing() as m:
            if id_ not in m.nodes:
                raise NotFound(id_)
            known = m.nodes[id_].setdefault("endpoints", [])
            if endpoint not in known:
                known.append(endpoint)

    def nodes(self) -> dict[str, dict]:
        return self.manifest().nodes

    def register_connector(self, id_: str, info: dict) -> None:
        with self._writing() as m:
            m.connectors[id_] = {**m.connectors.get(id_, {}), **info}

    def update_sync(self, id_: str, **state) -> None:
        """cursor, docs_synced, last_sync, status of a connector."""
        with self._writing() as m:
            if id_ not in m.connectors:
                raise NotFound(id_)
            m.connectors[id_]["sync"] = {**m.connectors[id_].get("sync", {}), **state}

    def connectors(self) -> dict[str, dict]:
        return self.manifest().connectors

    # tags, edges, trends

    def append(self, name: str, rows: DataFrame) -> None:
        with self._writing() as m:
            m.tables.setdefault(name, []).append(self._stage(name, rows))

    def _append(self, name: str, rows: list[tuple]) -> None:
        self.append(name, self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1))

    def tag(self, id_: str, tags: list[str]) -> None:
        self._append("tags", [(t, id_) for t in tags])

    def tags(self) -> DataFrame:
        return self.table("tags").distinct()

    def relate(self, src: str, verb: str, dst: str) -> None:
        self._append("edges", [(src, verb, dst)])

    def unrelate(self, src: str, verb: str, dst: str) -> None:
        with self._writing() as m:
            left = self.table("edges", m).where(~((F.col("src") == src) & (F.col("verb") == verb) & (F.col("dst") == dst))).distinct()
            m.tables["edges"] = [self._stage("edges", left)]

    def edges(self) -> DataFrame:
        return self.table("edges").distinct()

    def record_trend(self, metric: str, value: float) -> None:
        self._append("trends", [(metric, time.time_ns(), float(value))])

    def replace(self, name: str, rows: DataFrame) -> None:
        """A new version of a table that isn't keyed."""
        with self._writing() as m:
            m.tables[name] = [self._stage(name, rows)]

    # reading

    def build_postings(self) -> None:
        """Stored postings of the documents as they are; later writes make them stale."""
        with self._writing() as m:
            if m.tables.get("docs"):
                name = f"postings/{uuid.uuid4().hex}"
                lexical.Index.write(self.docs(m), self.folder.at(name), self.analyzer)
                m.postings = {"path": name, "of": m.tables["docs"]}

    def build_cells(self, **options) -> None:
        """The cell index of the vectors as they are, valid while the feed doesn't move on."""
        with self._writing() as m:
            if m.tables.get("vecs"):
                name = f"cells/{uuid.uuid4().hex}"
                vecs = self.table("vecs", m)
                ann.Ivf.build(vecs, feed_seq=m.next_seq, **options).write(self.folder.at(name))
                m.cells = {"path": name, "docs": vecs.count()}

    def index(self, m: Manifest | None = None) -> lexical.Index | None:
        """The stored postings, made anew if they are stale; None where another writer is at work."""
        m = m or self.manifest()
        if not m.tables.get("docs"):
            return None
        if m.postings.get("of") != m.tables["docs"]:
            try:
                self.build_postings()
            except StoreError:
                return None
            now = self.manifest()
            if now.postings.get("of") != m.tables["docs"]:
                return None
            m = now
        return lexical.Index.read(self.spark, self.folder.at(m.postings["path"]))

    def cells(self, m: Manifest | None = None) -> ann.Ivf | None:
        """The cell index if it is current and the store large enough for it to pay."""
        m = m or self.manifest()
        if not m.cells or m.cells["docs"] < ANN_FROM:
            return None
        found = ann.Ivf.read(self.spark, self.folder.at(m.cells["path"]))
        return found if found.feed_seq == m.next_seq else None

    def corpus(self, text: bool = False) -> planner.Corpus:
        """What requests are planned over; ``text``: stored postings are wanted."""
        m = self.manifest()
        index = self.index(m) if text else None
        docs = self.table("docs", m).withColumn("md", F.try_parse_json("metadata"))
        spaces = self.table("spaces", m)
        names = [r["k"] for r in spaces.select(F.explode(F.map_keys("spaces")).alias("k")).distinct().collect()] if m.tables.get("spaces") else []
        named = {k: spaces.select("id", F.try_element_at("spaces", F.lit(k)).alias("vec")).where("vec is not null") for k in names}
        sparse = self.table("sparse", m).select("id", F.inline("entries")) if m.tables.get("sparse") else None
        tokens = self.table("tokens", m) if m.tables.get("tokens") else None
        fields = f.Fields({}, "md", frozenset(m.indexes))
        return planner.Corpus(docs, self.table("vecs", m), named, sparse, tokens, fields, index, self.analyzer, self.cells(m), m.aliases)

    def query(self, request: planner.SearchRequest) -> DataFrame:
        if self.quotas.max_top_k is not None and request.top_k > self.quotas.max_top_k:
            raise QuotaExceeded(f"top_k is at most {self.quotas.max_top_k}")
        page = planner.plan(self.corpus(text=planner.asks_text(request)), request)
        kept = ("id", "score", "rank", "text", "metadata", "collection", "vector", "highlights")
        return page.select(*(c for c in kept if c in page.columns))

    def query_batch(self, requests: list[planner.SearchRequest]) -> list[DataFrame]:
        """A page for each request, all over the same version."""
        return [self.query(r) for r in requests]

    def changes(self, since: int, limit: int = 256) -> DataFrame:
        return writes.feed_page(self.table("feed"), since, limit)

    def replication_page(self, since: int, limit: int = 256) -> DataFrame:
        """A feed page with each document and vector as they are now; null where the document is gone."""
        page = self.changes(since, limit)
        few = F.broadcast(page.select(F.col("doc_id").alias("id")).distinct())
        now = self.docs().join(few, "id").join(self.table("vecs").join(few, "id"), "id", "left")
        return page.join(now.withColumnRenamed("id", "doc_id"), "doc_id", "left").orderBy("seq")

    def info(self) -> dict:
        m = self.manifest()
        return {"name": m.name, "version": m.version, "dim": m.dim, "docs": self.docs(m).count(), "next_seq": m.next_seq, "aliases": m.aliases, "indexes": m.indexes}

    def issues(self, cursors: dict[str, int] | None = None) -> list[str]:
        """``dim_unset``, and ``feed_behind`` where one of the given replica cursors has rows to catch up with."""
        m = self.manifest()
        found = ["dim_unset"] if m.dim is None and m.tables.get("docs") else []
        return found + [f"feed_behind:{k}" for k, seq in sorted((cursors or {}).items()) if seq < m.next_seq]

    def sizes(self) -> dict[str, int]:
        """Bytes of each table's current files."""
        return {name: sum(map(self.folder.size, parts)) for name, parts in self.manifest().tables.items()}

    def snapshot(self, to: str) -> None:
        """A copy that opens as a store, written by the executors."""
        m = self.manifest()
        target = Store(self.spark, to, analyzer=self.analyzer)
        for name, parts in m.tables.items():
            for p in parts:
                self._read(p).write.parquet(target.folder.at(p))
        m.postings, m.cells, m.retired = {}, {}, []
        target._publish(m)

    def compact(self) -> None:
        """Merges deltas and appended tables but the feed, which subscribers follow by its files.

        Files that no version needs any more are deleted at the next call, so
        that readers of the last version can end.
        """
        with self._writing() as m:
            for name, parts in list(m.tables.items()):
                if name != "feed" and len(parts) > 1:
                    if name in KEYED:
                        self._merge(m, name)
                    else:
                        m.tables[name] = [self._stage(name, self.table(name, m).distinct())]
            used = {p for parts in m.tables.values() for p in parts} | {str(x.get("path")) for x in (m.postings, m.cells) if x}
            spare = [f"{name}/{part}" for name in (*SCHEMAS, "postings", "cells") for part in self.folder.names(name) if f"{name}/{part}" not in used]
            for part in set(spare) & set(m.retired):
                self.folder.delete(part)
            m.retired = sorted(set(spare) - set(m.retired))

    # the text language

    def sql(self, text: str) -> DataFrame | dict:
        s = ql.parse(text)
        if isinstance(s, ql.Select):
            c = self.corpus()
            return ql.select(s, c.docs, c.fields, c.aliases).select("id", "text", "metadata", "collection")
        p = s.parts
        match s.name:
            case "define index":
                self.define_index(p["field"])
            case "define alias":
                self.create_alias(p["alias"], p["collection"])
            case "define field":
                self.define_field(p["collection"], p["field"], p["type"])
            case "remove alias":
                return {"removed": self.delete_alias(p["alias"])}
            case "remove collection":
                return {"removed": self.drop_collection(p["collection"])}
            case "remove field":
                return {"removed": self.remove_field(p["collection"], p["field"])}
            case "update":
                (self.overwrite_metadata if p["replace"] else self.set_metadata)(p["id"], p["values"])
            case "delete":
                return {"removed": self.remove([p["id"]])}
            case "delete payload":
                self.clear_metadata(p["id"]) if p["keys"] is None else self.delete_metadata_keys(p["id"], p["keys"])
            case "relate":
                self.relate(p["src"], p["verb"], p["dst"])
            case "traverse":
                start = self.spark.createDataFrame([(x, i) for i, x in enumerate(p["start"])], "id string, pos bigint")
                return graph.traverse(self.edges(), start, (p["verb"],) if p["verb"] else (), p["direction"], p["depth"], p["limit"]).orderBy("pos")
            case "live":
                since = self.manifest().next_seq if p["since"] is None else p["since"]
                return {"since": since}
            case "info":
                return self.info()
        return {"ok": True}


class StoreCatalog:
    """namespace / database, each database a store of its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, *names: str) -> str:
        for n in names:
            if not _NAME.match(n):
                raise f.InvalidRequest(f"not a simple name: {n!r}")
        return "/".join((self.root.rstrip("/"), *names))

    def database(self, namespace: str, database: str, **options) -> Store:
        return Store(self.spark, self._path(namespace, database), **options)

    def namespaces(self) -> list[str]:
        return Folder(self.spark, self.root).names()

    def databases(self, namespace: str) -> list[str]:
        return Folder(self.spark, self._path(namespace)).names()

    def drop_database(self, namespace: str, database: str) -> bool:
        return Folder(self.spark, self._path(namespace, database)).delete()
