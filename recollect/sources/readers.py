"""Sources: folders of texts, JSON lines, and judged corpora. Each is resumable after a cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def directory(spark: SparkSession, path: str, after: str | None = None) -> DataFrame:
    """(id, text, metadata, cursor): UTF-8 files below ``path``, in path order, strictly after the cursor."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.try_validate_utf8("content") if hasattr(F, "try_validate_utf8") else F.decode("content", "UTF-8")
    at = F.regexp_replace("path", "^file:/*", "/")
    meta = F.to_json(F.struct(F.regexp_extract("path", "([^/]+)$", 1).alias("title"), at.alias("source_path"), F.col("modificationTime").cast("string").alias("modified_at"), F.col("length").alias("size_bytes")))
    out = files.select(F.concat(F.lit("fs:"), at).alias("id"), text.cast("string").alias("text"), meta.alias("metadata"), at.alias("cursor")).where("text is not null")
    return (out if after is None else out.where(F.col("cursor") > after)).orderBy("cursor")


def json_lines(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """(id, text, metadata, cursor): one object a line; what is neither id nor text is metadata.

    The line number is the cursor. A line that is no object raises when read.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("p"))
    counts = lines.groupBy("p").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row a file part
    line = F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("at"))
    numbered = lines.join(F.broadcast(before), "p").withColumn("cursor", line).where((F.col("cursor") > after) & (F.trim("value") != ""))
    m = F.from_json("value", "map<string,variant>")  # values keep their types
    text = lambda name: _text(F.try_element_at(m, F.lit(name)))
    bad = F.assert_true(F.json_object_keys("value").isNotNull(), F.concat(F.lit("not an object in line "), F.col("cursor").cast("string")))
    id_ = F.coalesce(text("id"), F.concat(F.lit("line"), F.col("cursor").cast("string")))
    rest = F.to_json(F.map_filter(m, lambda k, v: ~k.isin("id", "text")))
    return numbered.select(F.concat(F.lit("jsonl:"), id_).alias("id"), F.coalesce(text("text"), bad.cast("string"), F.lit("")).alias("text"), rest.alias("metadata"), "cursor")


def _text(v: Column) -> Column:
    """A string as it is, anything else as JSON, null as missing."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind != "VOID", F.to_json(v))


def judged_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, queries, judgments) of a folder with corpus.jsonl, queries.jsonl and qrels/test.tsv."""
    docs = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl")
    rels = spark.read.csv(f"{path}/qrels/test.tsv", sep="\t", header=True).toDF("query_id", "id", "gain")
    return (
        docs.select(F.col("_id").alias("id"), F.concat_ws(" ", "title", "text").alias("text")),
        queries.select(F.col("_id").alias("query_id"), "text"),
        rels.withColumn("gain", F.col("gain").cast("int")),
    )
