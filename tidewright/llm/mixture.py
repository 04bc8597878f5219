"""Mixing sources to target weights by weighted sampling without replacement.

Each document gets the key -ln(u)/w (Efraimidis and Spirakis): u is uniform and a
function of the seed and the doc_id, w is the document's quality weight. Within
its source a document is taken whole in every complete epoch of the source's
target; what the target has beyond complete epochs is filled in order of the key,
up to the prefix sum at which the budget ends. `taken` counts of the document at the
boundary the words that still fit, so a source misses its target by less than a word;
`copies` counts whole documents, and has that document if at least half of it fits.

Scale: the prefix sum never sorts a source in one task. Keys are mapped monotonically
to buckets, none of which gets more than a 1 / 4096 of a source by its keys; sums per
source and bucket are few rows; only the bucket in which a budget ends is sorted. The table of sources has one row a source and is broadcast
only up to BROADCAST_SOURCES.

Edge cases: a null text has size 0; a null source is a source, after all others;
documents of size 0 take 0; repeated rows have the same key and are taken in
turn; rows without doc_id have keys by their texts; documents without a weight weigh 1, weights
that are null, zero or negative count as the least weight, and of several the largest;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.shared import cut, sized

# Fixed values of the production mix.
WEIGHTS = (5, 2, 1)
SHARE, MOST_EPOCHS = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"

LEAST_WEIGHT, MOST_WEIGHT = 0.25, 4.0
BUCKETS = 1 << 16
BROADCAST_SOURCES = 20_000


def uniform(key: Column, seed: str = "mix-1") -> Column:
    """In (0, 1), the same for the same key and seed in any engine with md5."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def measured(docs: DataFrame, text: str = "text", seed: str = "mix-1") -> DataFrame:
    """(doc_id, source, size, u)."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(text)))
    return docs.select("doc_id", "source", size.alias("size"), uniform(named, seed).alias("u"))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) by quality labels; of several labels the best counts."""
    weight = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0.25).when(F.coalesce("quality", F.lit(0)) > 0, 2.0).otherwise(0.5)
    return labels.select("doc_id", weight.alias("weight"))


def weighed(sizes: DataFrame, quality: DataFrame | None) -> DataFrame:
    """sizes with w, 1 for documents without a quality weight. Joined after the texts are measured, so no text moves."""
    if quality is None:
        return sizes.withColumn("w", F.lit(1.0))
    one = quality.where("doc_id is not null").groupBy(F.col("doc_id").alias("__tw_id")).agg(F.max(F.col("weight").cast("double")).alias("__tw_w"))
    bounded = F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.coalesce("__tw_w", F.lit(LEAST_WEIGHT))))
    w = F.when(F.col("__tw_id").isNull(), F.lit(1.0)).otherwise(bounded)
    return sizes.join(one, F.col("doc_id") == F.col("__tw_id"), "left").withColumn("w", w).drop("__tw_id", "__tw_w")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) of (source, size) rows, by water filling; one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    shares = per.withColumn("weight", F.get(F.array(*(F.lit(float(x)) for x in weights)), place)).withColumn("cap", most * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    all_rows = Window.partitionBy(F.lit(1))
    filled = shares.select(
        "*",
        (F.col("cap") / F.col("weight")).alias("ratio"),
        F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("weight_before"),
        F.sum("weight").over(all_rows).alias("weight_all"),
        (share * F.sum("source_size").over(all_rows)).alias("budget"),
    )
    # The level at which sources before this one are full and this one and those after are not.
    level = (F.col("budget") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before"))
    fits = F.when(level <= F.col("ratio"), level)
    leveled = filled.withColumn("fits", fits).withColumn("water", F.min_by("fits", F.when(F.col("fits").isNotNull(), F.struct("ratio", F.col("weight_before")))).over(all_rows))
    return leveled.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("water"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, text: str = "text", seed: str = "mix-1") -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, taken, copies."""
    rows = cut(weighed(measured(docs, text, seed), quality).withColumn("key", -F.log("u") / F.col("w")).withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * LEAST_WEIGHT)) * BUCKETS).cast("int")), "sized")
    # The source table and the bucket sums both come from one small table.
    sums = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "buckets")
    plan = targets(sums, weights, share, most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = cut(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "plan")
    few = plan.count() <= BROADCAST_SOURCES
    look = F.broadcast(plan) if few else plan
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    filled = filled.withColumnRenamed("source", "_s").join(look, F.col("_s").eqNullSafe(F.col("source")))
    # The bucket in which the budget ends: the last that begins within it.
    ends = filled.where(F.col("before") <= F.col("rest")).groupBy("_s").agg(F.max(F.struct("bucket", "before")).alias("end"))
    ends = ends.select("_s", F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("end_before"))
    info = cut(plan.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_s"), "ends")
    joined = rows.join(F.broadcast(info) if few else info, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    edge = joined.where(F.col("bucket") == F.col("end_bucket"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # Words of the last, incomplete epoch; only the document at the boundary has some but not all.
    left = F.floor("rest") - (F.col("end_before") + F.sum("size").over(inside) - F.col("size"))
    edge = edge.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least("size", left)))
    others = joined.where(~F.col("bucket").eqNullSafe(F.col("end_bucket"))).withColumn("extra", F.when(F.col("bucket") < F.col("end_bucket"), F.col("size")).otherwise(F.lit(0).cast("long")))
    taken = F.least(F.col("epochs") * F.col("size") + F.col("extra"), F.lit(int(most)).cast("long") * F.col("size"))
    copies = F.least(F.col("epochs") + (2 * F.col("extra") >= F.greatest("size", F.lit(1))).cast("long"), F.lit(int(most)).cast("long"))
    return edge.unionByName(others).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"))


def expand(docs: DataFrame, quality: DataFrame | None = None, **how) -> DataFrame:
    """docs with each row as often as the mix takes it. Rows of one doc_id are taken as often as its most taken row."""
    taken = sized(mix(docs, quality, **how).groupBy("doc_id").agg(F.max("copies").alias("__tw_n")).withColumnRenamed("doc_id", "__tw_id"), "copies")
    times = docs.join(taken, docs["doc_id"].eqNullSafe(F.col("__tw_id")))
    return times.withColumn("__tw_i", F.explode(F.when(F.col("__tw_n") > 0, F.sequence(F.lit(1).cast("long"), F.col("__tw_n"))))).drop("__tw_n", "__tw_i", "__tw_id")
