"""A sync pass: batches of a source go through the gate into a store, and the map and baseline follow.

A driver has ``provider`` and ``pull(spark, cursor)``, which returns
(documents (id, text, metadata, cursor), next cursor), or None where nothing
lies behind the cursor. The cursor moves on only after a batch is in the store, so an
interrupted pass repeats a batch (upserts are idempotent) and never skips one.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import baseline, gate
from recollect.runtime import cut
from recollect.sources import readers
from recollect.store import NotFound, Store


class Driver(Protocol):
    provider: str

    def pull(self, spark: SparkSession, cursor: str | None) -> tuple[DataFrame, str] | None: ...


@dataclass(frozen=True)
class Files:
    """The texts below a folder, ``batch`` files at a time in path order."""

    path: str
    batch: int = 256
    provider: str = "fs"

    def pull(self, spark: SparkSession, cursor: str | None) -> tuple[DataFrame, str] | None:
        return _page(readers.directory(spark, self.path, cursor), self.batch)


@dataclass(frozen=True)
class JsonLines:
    path: str
    batch: int = 10_000
    provider: str = "jsonl"

    def pull(self, spark: SparkSession, cursor: str | None) -> tuple[DataFrame, str] | None:
        return _page(readers.json_lines(spark, self.path, int(cursor or 0)), self.batch)


def _page(rows: DataFrame, most: int) -> tuple[DataFrame, str] | None:
    page = cut(rows.orderBy("cursor").limit(most))
    last = page.agg(F.max("cursor").cast("string"), F.count("*")).first()
    return (page, last[0]) if last[1] else None


@dataclass(frozen=True)
class Report:
    ingested: int
    blocked: int
    batches: int
    cursor: str | None


def sync(store: Store, driver: Driver, connector: str, tell: Callable[[dict], None] | None = None) -> Report:
    """One pass for a registered connector, from its stored cursor on."""
    spark, tell = store.spark, tell or (lambda event: None)
    if connector not in store.connectors():
        raise NotFound(f"no such connector: {connector}")
    state = store.connectors()[connector].get("sync", {})
    cursor, synced = state.get("cursor"), int(state.get("docs_synced", 0))
    ingested = blocked = batches = 0
    store.update_sync(connector, status="syncing")
    known = store.table("baseline")
    seq = known.agg(F.coalesce(F.max("last"), F.lit(-1))).first()[0] + 1
    while (pulled := driver.pull(spark, cursor)) is not None:
        rows, cursor = pulled
        batches += 1
        made = cut(gate.distill(rows, source=F.lit(connector)).select("id", "gate", "family", F.coalesce("shape_key", F.lit("")).alias("shape"), "context"))
        passed = made.where("gate <> 'block'")
        n = passed.count()
        blocked += made.count() - n
        if n:
            store.upsert(rows.join(passed.select("id"), "id", "left_semi").withColumn("pos", F.monotonically_increasing_id()))
            store.append("edges", passed.select(F.lit(connector).alias("src"), F.lit("contains").alias("verb"), F.col("id").alias("dst")).distinct())
            store.append("tags", passed.select(F.concat(F.lit("mode:"), "family").alias("tag"), "id").distinct())
            ingested, synced = ingested + n, synced + n
            seen = passed.select("context", "shape", F.lit(seq).cast("bigint").alias("seq"))
            known, seq = cut(baseline.merge(known, seen)), seq + 1
        store.update_sync(connector, cursor=cursor, docs_synced=synced, last_sync=int(time.time() * 1000))
        tell({"kind": "connector.batch", "connector": connector, "docs": n, "cursor": cursor})
    store.update_sync(connector, status="idle")
    store.record_trend(f"connector.{connector}.docs_synced", float(synced))
    own = baseline.predictability(baseline.restored(known.where(F.col("context") == connector))).first()
    if own is not None:
        store.record_trend(f"connector.{connector}.predictability", float(own["predictability"]))
    store.replace("baseline", known)
    tell({"kind": "connector.synced", "connector": connector, "ingested": ingested, "blocked": blocked, "batches": batches})
    return Report(ingested, blocked, batches, cursor)
