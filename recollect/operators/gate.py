"""First touch of a payload: gate verdicts, families, field roles, shapes and routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import values
from recollect.functions import vectors as V
from recollect.functions.text import portable_hash

MOST_BYTES, MOST_FIELDS = 1 << 20, 256
HIDDEN = "[\\u200B-\\u200F\\u202A-\\u202E\\u2066-\\u2069]"
SECRET_STARTS = ("-----BEGIN", "AKIA", "gho_", "ghp_", "sk-", "xoxb-", "xoxp-")
SECRET_RUN = "(^|\\s)(?=[A-Za-z0-9+/=]*[0-9])(?=[A-Za-z0-9+/=]*[A-Z])(?=[A-Za-z0-9+/=]*[a-z])[A-Za-z0-9+/=]{32,}(\\s|$)"
INJECTIONS = ("developer message", "disregard your instructions", "ignore all previous", "ignore previous instructions", "system prompt", "you are now")
OPERATIONS = ("delete", "drop table", "grant access", "rm -rf", "send money", "shutdown", "transfer", "wire")

#: Family by field names; earlier families win ties.
FAMILIES = {
    "mail": "bcc cc from mailbox recipient sender subject to",
    "record": "amount currency price quantity row sku status total",
    "document": "abstract author body content section text title",
    "event": "action duration ended event kind occurred severity started",
    "location": "address city country geo lat latitude lon longitude path",
    "media": "blob bytes codec duration_ms height mime url width",
}
TIME_NAMES = ("date", "time", "timestamp")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def signals(text: Column) -> dict[str, Column]:
    body, low = F.coalesce(text, F.lit("")), F.lower(F.coalesce(text, F.lit("")))
    return {
        "unicode_anomaly": body.rlike(HIDDEN),
        "secret_signal": _any([body.contains(s) for s in SECRET_STARTS]) | body.rlike(SECRET_RUN),
        "injection_signal": _any([low.contains(s) for s in INJECTIONS]),
        "operation_signal": _any([low.contains(s) for s in OPERATIONS]),
    }


def verdict(text: Column, n_fields: Column | None = None, tainted: Column | None = None) -> Column:
    """block on size, flag on taint or suspicious text, else pass; operation words alone change nothing."""
    s = signals(text)
    block = F.coalesce(F.octet_length(text) > MOST_BYTES, F.lit(False))
    if n_fields is not None:
        block = block | (n_fields > MOST_FIELDS)
    flag = s["unicode_anomaly"] | s["secret_signal"] | s["injection_signal"]
    if tainted is not None:
        flag = flag | F.coalesce(tainted, F.lit(False))
    return F.when(block, "block").when(flag, "flag").otherwise("pass")


def ambiguity(scores: Column) -> Column:
    """1 without routes, 0 with one, else how far the best lies before the second; scores come best first."""
    return F.when(F.size(scores) == 0, 1.0).when(F.size(scores) == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.get(scores, F.lit(0)) - F.get(scores, F.lit(1))))


def family(keys: Column) -> Column:
    """The family that most of an object's field names speak for."""
    low = F.transform(keys, lambda k: F.lower(k))

    def count(words: list[str]) -> Column:
        # one match a key in place of two comparisons a word: equal to a word, or a word before an underscore
        return F.size(F.filter(low, lambda k: k.rlike(f"^(?:{'|'.join(words)})(?:_|\\z)")))

    names = F.array(*(F.lit(name) for name in FAMILIES))
    timely = F.size(F.filter(low, lambda k: k.endswith("_at") | k.isin(*TIME_NAMES))) > 0

    def first(v: Column) -> Column:
        best = F.array_max(v)
        none = F.when(timely, "event").otherwise("unshaped")
        return F.when(best <= 0, none).otherwise(F.get(names, F.array_position(v, best).cast("int") - 1))

    # the votes are the one element of an array, so that they are counted once for all that asks for them
    votes = F.array(F.array(*(count(words.split()) for words in FAMILIES.values())))
    return F.when(F.size(keys) <= 0, "unshaped").otherwise(F.get(F.transform(votes, first), F.lit(0)))


def role(field: Column, kind: Column) -> Column:
    f = F.lower(field)
    return (
        F.when(f.isin("email", "from", "id", "recipient", "sender", "sku", "to", "uuid") | f.endswith("_id") | f.endswith("_key"), "identity")
        .when(f.isin("created", "date", "occurred", "time", "timestamp", "updated") | f.endswith("_at"), "time")
        .when(f.isin("heading", "name", "subject", "title"), "title")
        .when(f.isin("body", "content", "description", "message", "text"), "content")
        .when((kind == "number") & _any([f.contains(w) for w in ("amount", "price", "priority", "score", "severity", "total")]), "salience")
        .otherwise("other")
    )


def shape_id(key: Column) -> Column:
    return portable_hash(key)


def context(channel: Column, source: Column, project: Column) -> Column:
    return F.coalesce(channel, source, project, F.lit("global"))


def route(vecs: DataFrame, routes: DataFrame, threshold: float) -> DataFrame:
    """(id, tag, score): routes (tag, qvec) whose centroid is near enough, best first by ``rank``."""
    scored = vecs.crossJoin(routes).select("id", "tag", V.cosine(F.col("vec"), F.col("qvec")).alias("score"))
    return scored.where(F.col("score") >= threshold)


def registry(shapes: DataFrame) -> DataFrame:
    """(shape_key, family, n, shape_id) of (shape_key, family) rows."""
    return shapes.groupBy("shape_key", "family").agg(F.count("*").alias("n")).withColumn("shape_id", shape_id(F.col("shape_key")))


def siblings(shapes: DataFrame) -> DataFrame:
    """(family, shapes): how many different shapes a family has shown."""
    return registry(shapes).groupBy("family").agg(F.count("*").alias("shapes"))


def new_shapes(shapes: DataFrame, known: DataFrame) -> DataFrame:
    """The registry rows of ``shapes`` with ``is_new``: whether ``known`` (shape_key) lacks them."""
    seen = known.select("shape_key").distinct().withColumn("seen", F.lit(True))
    return registry(shapes).join(seen, "shape_key", "left").withColumn("is_new", F.col("seen").isNull()).drop("seen")


ROLES = ("identity", "time", "title", "content", "salience", "other")


def _empty(v: Column) -> Column:
    """Whether a variant holds nothing: null, or a blank string."""
    kind = F.schema_of_variant(v)
    return F.coalesce((kind == "VOID") | ((kind == "STRING") & (F.trim(F.try_variant_get(v, "$", "string")) == "")), F.lit(True))


def distill(docs: DataFrame, routes: DataFrame | None = None, source: Column | None = None) -> DataFrame:
    """What a reasoner may expect of each document: (id, gate, signals, family, shape_key, shape_id, context, fields, hints, tags).

    ``docs`` (id, text, metadata as JSON); ``routes`` (id, tag, score) as ``route`` gives them. ``fields``
    groups the metadata by role; a blocked document has no family, no fields and no shape. One projection,
    and a join only for the routes.
    """
    entries = F.coalesce(F.map_entries(F.from_json("metadata", "map<string,variant>")), F.expr("cast(array() as array<struct<key:string,value:variant>>)"))
    kind = lambda v: values.json_kind(F.schema_of_variant(v))
    with_entries = docs.select("id", "text", "metadata", entries.alias("entries"))
    parts = with_entries.select(
        "*",
        verdict(F.col("text"), F.size("entries")).alias("gate"),
        F.struct(*(c.alias(n) for n, c in signals(F.col("text")).items())).alias("signals"),
        F.transform("entries", lambda e: e["key"]).alias("keys"),
        F.transform("entries", lambda e: F.struct(e["key"].alias("key"), role(e["key"], kind(e["value"])).alias("role"), F.to_json(e["value"]).alias("value"), _empty(e["value"]).alias("blank"))).alias("roles"),
    )
    open_ = F.col("gate") != "block"
    held = lambda r: F.exists("roles", lambda e: (e["role"] == r) & ~e["blank"])
    of = lambda r: F.map_from_entries(F.transform(F.filter("roles", lambda e: e["role"] == r), lambda e: F.struct(e["key"], e["value"])))
    out = parts.select(
        "id",
        "gate",
        "signals",
        F.when(open_, family(F.col("keys"))).otherwise("unshaped").alias("family"),
        F.when(open_, values.shape_key(F.col("metadata"))).alias("shape_key"),
        context(source if source is not None else F.lit(None).cast("string"), F.col("id"), F.lit(None).cast("string")).alias("context"),
        F.when(open_, F.struct(*(of(r).alias(r) for r in ROLES))).alias("fields"),
        *(F.when(open_, held(r)).otherwise(False).alias(f"has_{r}") for r in ("identity", "time", "title")),
        F.when(open_, held("content") | (F.trim(F.coalesce("text", F.lit(""))) != "")).otherwise(False).alias("has_content"),
    )
    if routes is None:
        out = out.withColumn("tags", F.expr("cast(array() as array<struct<score:double,tag:string>>)"))
    else:
        best = F.sort_array(F.collect_list(F.struct("score", "tag")), False)
        tagged = routes.groupBy("id").agg(best.alias("tags"))
        out = out.join(tagged, "id", "left").withColumn("tags", F.coalesce("tags", F.expr("cast(array() as array<struct<score:double,tag:string>>)")))
    scores = F.transform("tags", lambda t: t["score"])
    hints = F.struct("has_identity", "has_time", "has_title", "has_content", F.coalesce(F.get(scores, F.lit(0)), F.lit(0.0)).alias("tag_confidence"), ambiguity(scores).alias("ambiguity_margin"))
    return out.select("id", "gate", "signals", "family", "shape_key", shape_id(F.col("shape_key")).alias("shape_id"), "context", "fields", hints.alias("hints"), F.transform("tags", lambda t: t["tag"]).alias("tags"))
