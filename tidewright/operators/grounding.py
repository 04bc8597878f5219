"""Grounding: which facts to show in a conversation, and whether they must be shown again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidates(facts: DataFrame, hits: DataFrame, k: int, queries: DataFrame) -> DataFrame:
    """(query_id, fact_id, place, pinned): all pinned facts in order of registration, then the k best retrieved that aren't pinned.

    hits must come from a search of depth k plus the number of pinned facts."""
    pins = facts.where("pin = 'always'").select(F.col("id").alias("fact_id"), (F.row_number().over(Window.orderBy("seq")) - 1).alias("place"))
    always = queries.select("query_id").crossJoin(F.broadcast(pins)).select("query_id", "fact_id", "place", F.lit(True).alias("pinned"))
    n = pins.agg(F.count("*").cast("int").alias("n"))
    free = hits.select("query_id", F.col("id").alias("fact_id"), "rank").join(pins.select("fact_id"), "fact_id", "left_anti")
    again = free.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1).where(F.col("_r") < k)
    return always.unionByName(again.crossJoin(F.broadcast(n)).select("query_id", "fact_id", (F.col("_r") + F.col("n")).alias("place"), F.lit(False).alias("pinned")))


def reason(body: Column, last: Column, body_present: Column, last_present: Column) -> Column:
    """never, evicted, mutated or fresh. A body that was changed while its old text is still in the window counts as mutated, present or not."""
    return (
        F.when(body == "", "fresh")
        .when(last.isNotNull() & (last != body) & last_present, "mutated")
        .when(body_present, "fresh")
        .when(last.isNull(), "never")
        .when(last == body, "evicted")
        .otherwise("mutated")
    )


def freshness(facts: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, fact_id, reason, inject) of facts (conv_id, fact_id, body, last_injected) against messages (conv_id, text).

    A text is present if one message holds it whole. Conversations are joined to their own facts only."""
    pairs = facts.join(messages.select("conv_id", F.col("text").alias("_m")), "conv_id", "left")
    holds = lambda c: F.coalesce(F.max(F.col("_m").contains(F.col(c))), F.lit(False))
    seen = pairs.groupBy("conv_id", "fact_id", "body", "last_injected").agg(holds("body").alias("_b"), holds("last_injected").alias("_l"))
    why = reason(F.col("body"), F.col("last_injected"), F.col("_b"), F.col("_l"))
    return seen.select("conv_id", "fact_id", why.alias("reason"), (why != "fresh").alias("inject"))


def injected(decisions: DataFrame, facts: DataFrame, before: DataFrame) -> DataFrame:
    """What each conversation was shown last, after the decisions: (conv_id, fact_id, body). Kept by conversation, so none learns from another."""
    new = decisions.where("inject").join(facts.select("conv_id", "fact_id", "body"), ["conv_id", "fact_id"]).select("conv_id", "fact_id", "body")
    return before.join(new, ["conv_id", "fact_id"], "left_anti").unionByName(new)


def events(decisions: DataFrame) -> DataFrame:
    """fact_inject and fact_inject_skip events."""
    return decisions.select("conv_id", "fact_id", F.when(F.col("inject"), "fact_inject").otherwise("fact_inject_skip").alias("type"), "reason")


def ground(candidates_: DataFrame, messages: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One turn of grounding in many conversations: events of the decisions (conv_id, fact_id, type, reason), and what each conversation was shown last, for the next turn.

    candidates_ (conv_id, fact_id, body), messages (conv_id, text), before (conv_id, fact_id, body). A conversation knows what it was shown itself."""
    known = candidates_.join(before.select("conv_id", "fact_id", F.col("body").alias("last_injected")), ["conv_id", "fact_id"], "left")
    decided = freshness(known, messages)
    return events(decided), injected(decided, candidates_, before)


def snapshot_events(found: DataFrame) -> DataFrame:
    """(query_id, fact_id, place, type, tier): one fact_snapshot event for each fact of candidates(), without state."""
    return found.select("query_id", "fact_id", "place", F.lit("fact_snapshot").alias("type"), F.when(F.col("pinned"), "always").otherwise("retrieved").alias("tier"))


def last_user_text(messages: DataFrame) -> DataFrame:
    """(conv_id, text): the last message, if a user wrote it."""
    last = messages.groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), F.col("turn")).alias("m"))
    return last.where("m.role = 'user'").select("conv_id", F.col("m.text").alias("text"))
