"""The driver's tables in the roles of catalog, vectors, traces and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries of the retrieval plans.
QUERIES = (("q1", "the thing and edition"), ("q2", "tion enation there"), ("q3", "parse le que de la"), ("q4", "and and erthe onth"), ("q5", "und die erschung"), ("q6", "zzz nothing"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERIES), "query_id string, text string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as queries."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tools: the brand is the server."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("__"), F.col("p_partkey").cast("string")).alias("id"), "p_partkey", "p_name", "p_brand", "p_type", "p_size")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a trace log: users are sessions, views are searches, clicks and purchases are invocations of the tool of their value; every seventh event is of origin direct."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "invoke_start").when(F.col("event_type") == "purchase", "skill_invoke").otherwise(F.col("event_type"))
    return e.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("log_seq"), kind.alias("type"), F.when(F.col("event_id") % 7 == 0, "direct").otherwise("agent").alias("origin"),
        F.concat(F.lit("topic "), F.floor("value").cast("long").cast("string")).alias("query"), F.concat(F.lit("tool_"), (F.col("event_id") % 17).cast("string")).alias("capability_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
    )
