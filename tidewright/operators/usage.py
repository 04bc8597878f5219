"""Usage graph, read side: match a query to an intent cluster and rank its edges as an arm.

members (intent_id, text), edges (intent_id, kind, capability_id, weight), intents (intent_id, support, last_ts[, centroid])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import vectors as V
from tidewright.functions.text import usage_token_set
from tidewright.operators import dense
from tidewright.operators.ranking import ranked

# Fixed values.
ARM_WEIGHT, FULL_SUPPORT = 0.5, 3
DENSE_LEAST, LEXICAL_LEAST = 0.70, 0.5
GRACE_MS = HALF_LIFE_MS = 90 * 86_400_000
EVICTION_FLOOR = 0.01


def recency(newest: Column, last: Column) -> Column:
    """1 within 90 days of the graph's newest event, then halved every 90 days."""
    idle = newest - last
    return F.when(idle <= GRACE_MS, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), -(idle - F.lit(GRACE_MS)) / F.lit(float(HALF_LIFE_MS))))


def arm_weight(support: Column, newest: Column, last: Column) -> Column:
    return F.lit(ARM_WEIGHT) * F.least(F.lit(1.0), support / F.lit(float(FULL_SUPPORT))) * recency(newest, last)


def _rarest(sets: DataFrame, key: list[str], spread: DataFrame, least: float) -> DataFrame:
    """(*key, n, term) of the rarest terms of each set: so many that two sets as alike as `least` have one of them in common."""
    terms = sets.select(*key, F.size("t").alias("n"), F.explode("t").alias("term")).join(spread, "term", "left")
    listed = terms.groupBy(*key, "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))).alias("z"))
    room = (F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1).cast("int")
    return listed.select(*key, "n", F.explode(F.slice("z", F.lit(1), room)).alias("z")).select(*key, "n", F.col("z.term").alias("term"))


def lexical_scores(queries: DataFrame, members: DataFrame, least: float = LEXICAL_LEAST) -> DataFrame:
    """(query_id, intent_id, score): the best Jaccard similarity of a query's word set with any one member, of those of at least `least`.

    Pairs come from the rarest words of both, by equality, so a word that all have pairs nobody; sizes bound the
    similarity before it is worked out."""
    sets = lambda df, name: df.select(name, usage_token_set(F.col("text")).alias("t")).where(F.size("t") > 0).distinct().withColumn("h", F.xxhash64("t"))
    q, m = sets(queries, "query_id"), sets(members, "intent_id")
    spread = m.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = _rarest(q, ["query_id", "h"], spread, least).select("query_id", F.col("h").alias("hq"), F.col("n").alias("nq"), "term")
    held = _rarest(m, ["intent_id", "h"], spread, least).select("intent_id", F.col("h").alias("hm"), F.col("n").alias("nm"), "term")
    pairs = asked.join(held, "term").where(F.least("nq", "nm") >= F.lit(least) * F.greatest("nq", "nm")).select("query_id", "hq", "intent_id", "hm").distinct()
    both = pairs.join(q.select("query_id", F.col("h").alias("hq"), F.col("t").alias("tq")), ["query_id", "hq"]).join(m.select("intent_id", F.col("h").alias("hm"), F.col("t").alias("tm")), ["intent_id", "hm"])
    common = F.size(F.array_intersect("tq", "tm"))
    score = common / (F.size("tq") + F.size("tm") - common)
    return both.select("query_id", "intent_id", score.alias("score")).where(F.col("score") >= least).groupBy("query_id", "intent_id").agg(F.max("score").alias("score"))


def best(scores: DataFrame, least: float) -> DataFrame:
    """The best cluster of each query at or above a threshold; of equals the smallest id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "intent_id")
    return scores.where(F.col("score") >= least).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def lexical_match(queries: DataFrame, members: DataFrame) -> DataFrame:
    return best(lexical_scores(queries, members), LEXICAL_LEAST)


def dense_match(queries: DataFrame, intents: DataFrame, digits: int = 9) -> DataFrame:
    """By full cosine with centroids of equal width. queries: (query_id, qvec); intents: (intent_id, centroid).

    Products of unit vectors, matrix by matrix; centroids of another width are a kind that isn't asked."""
    held = intents.where("centroid is not null").select(F.col("intent_id").alias("id"), V.scaled(F.col("centroid")).alias("vec"), F.size("centroid").cast("string").alias("kind"))
    asked = queries.where("qvec is not null").select("query_id", V.scaled(F.col("qvec")).alias("qvec"))
    found = dense.search(held, asked, 1, digits).join(asked.select("query_id", F.size("qvec").cast("string").alias("kind")), ["query_id", "kind"])
    return best(found.select("query_id", F.col("id").alias("intent_id"), "score"), DENSE_LEAST)


def edge_ranking(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """(intent_id, kind, id, weight, rank) of edges to known capabilities."""
    known = edges.join(catalog.select("kind", F.col("id").alias("capability_id")), ["kind", "capability_id"], "left_semi")
    return ranked(known.withColumnRenamed("capability_id", "id"), ["intent_id", "kind"], score="weight")


def outcomes(matches: DataFrame, edges: DataFrame, catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, intent_id, kept, dropped, outcome): no_match, all_filtered (the catalog has drifted) or armed."""
    flagged = edges.join(catalog.select("kind", F.col("id").alias("capability_id"), F.lit(1).alias("known")), ["kind", "capability_id"], "left")
    counts = flagged.groupBy("intent_id").agg(F.count("known").alias("kept"), F.sum(F.col("known").isNull().cast("long")).alias("dropped"))
    found = queries.select("query_id").join(matches.select("query_id", "intent_id"), "query_id", "left").join(counts, "intent_id", "left")
    outcome = F.when(F.col("intent_id").isNull(), "no_match").when(F.coalesce("kept", F.lit(0)) == 0, "all_filtered").otherwise("armed")
    return found.select("query_id", "intent_id", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"), outcome.alias("outcome"))


def serve_match(queries: DataFrame, intents: DataFrame, members: DataFrame, edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """The match a search is served with: dense if the query has a vector and there is a centroid; if that isn't armed, lexical over the clusters without centroid; else lexical over all.

    Of what isn't armed a report of drift comes before none."""
    has_centroid = intents.where("centroid is not null").select("intent_id")
    any_centroid = not has_centroid.isEmpty()
    seen = queries.where("qvec is not null") if any_centroid else queries.limit(0)
    lexical = queries.join(seen.select("query_id"), "query_id", "left_anti")
    first = outcomes(dense_match(seen, intents), edges, catalog, seen).withColumn("tier", F.lit("dense"))
    free = members.join(has_centroid, "intent_id", "left_anti")
    unarmed = seen.join(first.where("outcome = 'armed'").select("query_id"), "query_id", "left_anti")
    fall = outcomes(lexical_match(unarmed, free), edges, catalog, unarmed).withColumn("tier", F.lit("lexical"))
    plain = outcomes(lexical_match(lexical, members), edges, catalog, lexical).withColumn("tier", F.lit("lexical"))
    rank = F.when(F.col("outcome") == "armed", 0).when(F.col("outcome") == "all_filtered", 1).otherwise(2)
    order = Window.partitionBy("query_id").orderBy(rank, "tier")
    return first.unionByName(fall).unionByName(plain).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def arm(matches: DataFrame, intents: DataFrame, edges: DataFrame, catalog: DataFrame, kind: str = "tool") -> DataFrame:
    """(query_id, id, rank, weight) for search.with_usage()."""
    newest = intents.agg(F.max("last_ts").alias("newest"))
    weighed = intents.crossJoin(F.broadcast(newest)).select("intent_id", arm_weight(F.col("support"), F.col("newest"), F.col("last_ts")).alias("arm"))
    return matches.select("query_id", "intent_id").join(weighed, "intent_id").join(edge_ranking(edges, catalog).where(F.col("kind") == kind), "intent_id").select("query_id", "id", "rank", F.col("arm").alias("weight"))


def model_status(graph_model: str | None, graph_dim: int | None, model: str | None, dim: int | None) -> str:
    """Whether centroids can be compared with the active model's vectors; if not, the arm is paused."""
    if graph_model is None or model is None:
        return "ok"
    if graph_dim is not None and dim is not None and graph_dim != dim:
        return "dim_mismatch"
    return "ok" if graph_model == model else "model_mismatch"


def model_status_of(graph_model: Column, graph_dim: Column, model: Column, dim: Column) -> Column:
    """model_status() of columns."""
    unknown = graph_model.isNull() | model.isNull()
    return F.when(unknown, "ok").when(F.coalesce(graph_dim != dim, F.lit(False)), "dim_mismatch").when(graph_model == model, "ok").otherwise("model_mismatch")


def adaptive_status_of(attached: Column, status: Column) -> Column:
    """adaptive_status() of columns."""
    return F.when(~attached, "inactive").when(status.isNull(), "unknown").when(status == "ok", "active").otherwise("paused")


def adaptive_status(graph_attached: bool, status: str | None) -> str:
    return "inactive" if not graph_attached else "unknown" if status is None else "active" if status == "ok" else "paused"
