"""Search over catalogs: lexical, dense and hybrid, with an optional usage arm.

Tools, skills and facts are kinds of one corpus. Each kind has its own statistics, ranks and
budget: hits of two kinds are never compared, and equal ids of two kinds stay apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import bm25, dense
from tidewright.operators.ranking import FACTS_K, SKILLS_K, TOOLS_K, depth, fuse, ranked, top

METHODS = {"bm25": "bm25", "semantic": "semantic", "dense": "semantic", "hybrid": "hybrid"}
HIT = "query_id string, kind string, id string, score double, rank int, fused boolean"
BY = ["query_id", "kind"]
#: Hits of each kind, and the kinds that a usage arm boosts.
BUDGETS, BOOSTED = {"tool": TOOLS_K, "skill": SKILLS_K, "fact": FACTS_K}, ("tool", "skill", "entry")


def method_of(name: str) -> str:
    """The search method of a name; "dense" is semantic."""
    try:
        return METHODS[name.lower()]
    except (KeyError, AttributeError):
        raise ValueError(f"no search method {name!r}; there are {', '.join(sorted(METHODS))}") from None


def _kinded(hits: DataFrame) -> DataFrame:
    return hits if "kind" in hits.columns else hits.withColumn("kind", F.lit("entry"))


def with_usage(base: DataFrame, arm: DataFrame | None, k: int) -> DataFrame:
    """base hits (query_id, kind, id, score, rank), fused with the usage arm for those queries and kinds that have one.

    arm: (query_id, id, rank, weight[, kind]). A query without an arm keeps its raw scores to the bit; an arm
    admits ids that the base ranker didn't list. Facts have no arm."""
    base = _kinded(base)
    plain = top(base.select(*BY, "id", "score"), BY, k).withColumn("fused", F.lit(False))
    if arm is None:
        return plain
    arm = _kinded(arm).where(F.col("kind").isin(*BOOSTED))
    armed = arm.select(*BY).distinct()
    boosted = base.join(armed, BY, "left_semi").withColumn("weight", F.lit(1.0)).select(*BY, "id", "rank", "weight").unionByName(arm.select(*BY, "id", "rank", "weight"))
    fused = fuse([(boosted, F.col("weight"))], BY)
    fused = top(fused.withColumn("score", F.round("score", 9)), BY, k).withColumn("fused", F.lit(True))
    return plain.join(armed, BY, "left_anti").unionByName(fused.select(*plain.columns))


def arms(method: str, k: int, queries: DataFrame, index: bm25.Index | None = None, vectors: DataFrame | None = None, arm: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rankers of a search and what they list: bm25, dense, usage, each with query_id, kind, id, score, rank.

    With an arm, or for hybrid, each ranker is asked to a depth of at least 100."""
    deep = depth(k)
    found = {}
    if method != "semantic":
        found["bm25"] = bm25.search(index, queries, deep if method == "hybrid" or arm is not None else k)
    if method != "bm25":
        found["dense"] = dense.search(vectors, queries, deep if method == "hybrid" or arm is not None else k)
    if arm is not None:
        found["usage"] = _kinded(arm).where(F.col("kind").isin(*BOOSTED))
    return found


def search(method: str, k: int, queries: DataFrame, index: bm25.Index | None = None, vectors: DataFrame | None = None, arm: DataFrame | None = None, model: str | None = None, built_with: str | None = None) -> DataFrame:
    """(query_id, kind, id, score, rank, fused) for each of queries (query_id, text[, qvec]): the k best of each kind.

    No entries or k = 0 gives no hits for semantic and hybrid, without embedding anything; another model or width
    than the vectors have is refused."""
    method = method_of(method)
    spark = queries.sparkSession
    if k <= 0 or method != "bm25" and (vectors is None or vectors.isEmpty()):
        return spark.createDataFrame([], HIT)
    if method != "bm25":
        dense.guard(vectors, queries, model, built_with)
    found = arms(method, k, queries, index, vectors, arm)
    if method == "bm25":
        return with_usage(found["bm25"], arm, k)
    if method == "semantic":
        return with_usage(found["dense"], arm, k)
    weighed = [(found["bm25"], 1.0), (found["dense"], 1.0)]
    if arm is not None:
        weighed.append((found["usage"], F.col("weight")))
    return top(fuse(weighed, BY).withColumn("score", F.round("score", 9)), BY, k).withColumn("fused", F.lit(True))


def budgeted(hits: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    """Hits within the budget of their kind. Kinds that have none keep theirs."""
    k = F.lit(None).cast("int")
    for kind, most in (BUDGETS if budgets is None else budgets).items():
        k = F.when(F.col("kind") == kind, F.lit(most)).otherwise(k)
    return hits.where(k.isNull() | (F.col("rank") < k))


def stages(arms: dict[str, DataFrame]) -> DataFrame:
    """(query_id, kind, stages): for each search the stages that ran, in the order bm25, dense, usage, rrf, with their best scores and number of hits."""
    order = ("bm25", "dense", "usage", "rrf")
    score = lambda df: F.max("score") if "score" in df.columns else F.max(F.lit(None).cast("double"))
    parts = [_kinded(df).groupBy(*BY).agg(score(df).alias("top_score"), F.count("*").alias("n")).select(*BY, F.lit(i).alias("i"), F.lit(n).alias("name"), "top_score", "n") for i, n in enumerate(order) if (df := arms.get(n)) is not None]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*BY).agg(F.sort_array(F.collect_list(F.struct("i", "name", "top_score", "n"))).alias("stages"))


def usage_boost(served: DataFrame, queries: DataFrame, weights: DataFrame) -> DataFrame:
    """One usage_boost event for each query of a search with a graph, hit or miss: (query_id, type, intent_id, outcome, tier, kept, dropped, weight).

    served comes from usage.serve_match(), weights (intent_id, weight) from usage.arm_weight(); without an arm the weight is 0."""
    found = queries.select("query_id").join(served, "query_id", "left").join(weights, "intent_id", "left")
    weight = F.when(F.col("outcome") == "armed", F.coalesce("weight", F.lit(0.0))).otherwise(F.lit(0.0))
    return found.select("query_id", F.lit("usage_boost").alias("type"), "intent_id", F.coalesce("outcome", F.lit("no_match")).alias("outcome"), "tier", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), F.coalesce("dropped", F.lit(0).cast("long")).alias("dropped"), weight.alias("weight"))


__all__ = ["arms", "budgeted", "method_of", "ranked", "search", "stages", "usage_boost", "with_usage"]
