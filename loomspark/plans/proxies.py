"""The engine's tables over the driver's relational ones: whole tables, no samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

REPO = "r0"
KINDS = {"ECONOMY": "function", "STANDARD": "method", "MEDIUM": "class", "PROMO": "interface", "SMALL": "variable", "LARGE": "enum"}


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols: the brand is the file, the key the qualified name, the name is shared by many."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("p_type"))
    return table(spark, d, "part").select(F.lit(REPO).alias("repo_id"), F.col("p_brand").alias("path"), F.col("p_partkey").cast("string").alias("fqn"), F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_size").alias("start_line"))


def files(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).select("repo_id", "path", F.lit("python").alias("language")).distinct()


def call_refs(spark: SparkSession, d: str) -> DataFrame:
    """The part of an order's second line is called, by name, by the part of its first."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    caller = line.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("a"))
    callee = line.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("b"))
    pairs = caller.join(callee, "l_orderkey").select("a", "b").distinct()
    src = part.select(F.col("p_partkey").alias("a"), F.col("p_brand").alias("path"))
    dst = part.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("callee_name"))
    return pairs.join(src, "a").join(dst, "b").select(F.lit(REPO).alias("repo_id"), "path", F.col("a").cast("string").alias("caller_fqn"), "callee_name")


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    a = line.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("src"))
    b = line.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").where("src <> dst").select("src", "dst").distinct()


def paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"))


def inherit_refs(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as subclasses of what their first part by key is called; a name without a type stays a name."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    first = line.groupBy("l_suppkey").agg(F.min("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    kind = F.when(F.col("l_suppkey") % 2 == 0, "inherits").otherwise("implements")
    base = F.when(F.col("l_suppkey") % 5 == 0, F.concat("p_name", F.lit("<T>"))).otherwise(F.col("p_name"))
    return first.select(F.lit(REPO).alias("repo_id"), F.col("p_brand").alias("path"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("subclass_fqn"), base.alias("base_name"), kind.alias("kind"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Log events: the type is the fingerprint, the user the service; times in epoch microseconds."""
    e = table(spark, d, "events")
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("user_id").alias("service"), F.col("event_type").alias("fingerprint"), "value", "props")


def file_states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.col("text"), 256).alias("content_hash"))


def older_states(spark: SparkSession, d: str) -> DataFrame:
    """An earlier state: some texts differ, some files don't exist yet, some have gone since."""
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    gone = docs.where("doc_id % 13 = 0").select((-F.col("doc_id") - 1).alias("path"), F.sha2(F.col("text"), 256).alias("content_hash"))
    return old.unionByName(gone)
