"""Capability search: buckets of tools by server and of skills, pull-in of the tools that skills declare, and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import server_of
from tidewright.operators.ranking import TOOLS_K, clamp_k

# What a model is given, in this order; their ids are reserved.
MODEL_TOOLS = ("search_capabilities", "invoke_tool", "get_skill_content")


def grouped_tools(hits: DataFrame) -> DataFrame:
    """(query_id, server, server_rank, id, score, rank): tools by server, servers in the order of their first hit, hits in theirs."""
    served = hits.withColumn("server", server_of(F.col("id")))
    first = served.groupBy("query_id", "server").agg(F.min("rank").alias("_first"))
    placed = first.withColumn("server_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_first")) - 1)
    return served.join(placed.drop("_first"), ["query_id", "server"]).select("query_id", "server", "server_rank", "id", "score", "rank")


def pulled_in(skill_hits: DataFrame, skills: DataFrame, tools: DataFrame, tool_hits: DataFrame) -> DataFrame:
    """(query_id, id, score, place): known tools that matched skills declare and the tools bucket lacks, at score 0, once, in the order of skill, then declaration."""
    declared = skill_hits.join(skills.select("id", F.posexplode("tools").alias("pos", "tool")), "id").select("query_id", F.struct("rank", "pos").alias("at"), F.col("tool").alias("id"))
    known = declared.join(tools.select("id"), "id", "left_semi").join(tool_hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    once = known.groupBy("query_id", "id").agg(F.min("at").alias("at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at")) - 1).select("query_id", "id", F.lit(0.0).alias("score"), "place")


def search_capabilities(tool_hits: DataFrame, skill_hits: DataFrame, skills: DataFrame, tools: DataFrame) -> DataFrame:
    """One table (query_id, bucket, place, server, id, score): both buckets, with their own budgets, and pulled-in tools after the hits."""
    hits = tool_hits.select("query_id", "id", "score", F.col("rank").alias("place"))
    size = hits.groupBy("query_id").agg(F.max("place").alias("_last"))
    more = pulled_in(skill_hits, skills, tools, tool_hits).join(size, "query_id", "left").select("query_id", "id", "score", (F.col("place") + F.coalesce(F.col("_last") + 1, F.lit(0))).alias("place"))
    both = hits.unionByName(more).select("query_id", F.lit("tools").alias("bucket"), "place", server_of(F.col("id")).alias("server"), "id", "score")
    return both.unionByName(skill_hits.select("query_id", F.lit("skills").alias("bucket"), F.col("rank").alias("place"), F.lit(None).cast("string").alias("server"), "id", "score"))


def recall(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n) with n null where both buckets are empty: such a query recalls nothing."""
    return queries.select("query_id").join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")


def skill_content(requests: DataFrame, skills: DataFrame) -> DataFrame:
    """(request_id, skill_id, body, error): a body, or an error as data."""
    found = requests.join(skills.select(F.col("id").alias("skill_id"), "body", F.lit(True).alias("known")), "skill_id", "left")
    return found.select("request_id", "skill_id", "body", F.when(F.col("known").isNull(), F.concat(F.lit("unknown skill: "), F.coalesce("skill_id", F.lit("null")))).alias("error"))


def invocations(requests: DataFrame, tools: DataFrame) -> DataFrame:
    """(request_id, tool_id, arguments, status): unknown_tool, bad_arguments (no JSON object), needs_auth or ok. Arguments given flat, beside the id, count as an object."""
    known = requests.join(tools.select(F.col("id").alias("tool_id"), F.lit(True).alias("known"), "needs_auth"), "tool_id", "left")
    given = F.coalesce("arguments", "flat", F.lit("{}"))
    is_object = F.trim(given).startswith("{") & F.from_json(given, "map<string,string>").isNotNull()
    status = F.when(F.col("known").isNull(), "unknown_tool").when(~is_object, "bad_arguments").when(F.coalesce("needs_auth", F.lit(False)), "needs_auth").otherwise("ok")
    return known.select("request_id", "tool_id", given.alias("arguments"), status.alias("status"))


def lifecycle(calls: DataFrame) -> DataFrame:
    """Events of calls (call_id, tool_id, ts, took_ms, failed, is_error): a start, and an end or an error; a result that says it is an error is one."""
    bad = F.coalesce("failed", F.lit(False)) | F.coalesce("is_error", F.lit(False))
    end = F.struct(F.when(bad, "invoke_error").otherwise("invoke_end").alias("type"), (F.col("ts") + F.coalesce("took_ms", F.lit(0))).alias("ts"), F.col("took_ms").cast("long").alias("took_ms"))
    start = F.struct(F.lit("invoke_start").alias("type"), F.col("ts").alias("ts"), F.lit(None).cast("long").alias("took_ms"))
    return calls.select("call_id", "tool_id", F.explode(F.array(start, end)).alias("e")).select("call_id", "tool_id", "e.*")


def ingest_first_wins(entries: DataFrame) -> DataFrame:
    """Of entries with one id that several adapters register, the first by seq; reserved ids are left out."""
    rest = [c for c in entries.columns if c not in ("id", "seq")]
    kept = entries.where(~F.col("id").isin(*MODEL_TOOLS)).groupBy("id").agg(F.min("seq").alias("seq"), F.min_by(F.struct(*rest), F.col("seq")).alias("_r"))
    return kept.select("id", "seq", *(F.col(f"_r.{c}").alias(c) for c in rest))


def recall_messages(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, part, role, call_id, content): the pair of messages of a recall, a call of the search tool and its result, under one id that is a function of the query. A query that found nothing has none."""
    hits = found.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("bucket", "place", "id", "score")))).alias("hits"))
    call = F.concat(F.lit("recall-"), F.substring(F.sha2(F.to_json(F.struct("query_id", "text")), 256), 1, 16))
    asked = queries.join(hits, "query_id").select("query_id", call.alias("call_id"), F.array(F.struct(F.lit("assistant").alias("role"), F.to_json(F.struct(F.lit(MODEL_TOOLS[0]).alias("tool"), F.col("text").alias("query"))).alias("content")), F.struct(F.lit("tool").alias("role"), F.col("hits").alias("content"))).alias("m"))
    return asked.select("query_id", "call_id", F.posexplode("m").alias("part", "x")).select("query_id", "part", "x.role", "call_id", "x.content")


def insert_recall(messages: DataFrame, pairs: DataFrame, at: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, call_id, content) with each conversation's recall pair (conv_id, part, role, call_id, content) at the place `at` (conv_id, turn) before which it belongs; turns are numbered anew. A conversation that holds a message of the pair's id keeps its messages, so inserting again changes nothing."""
    have = messages.where("call_id is not null").select("conv_id", "call_id").distinct()
    new = pairs.join(have, ["conv_id", "call_id"], "left_anti").join(at.select("conv_id", F.col("turn").alias("_at")), "conv_id")
    both = messages.select("conv_id", F.struct(F.col("turn").alias("t"), F.lit(1).alias("s"), F.lit(0).alias("p")).alias("_o"), "role", "call_id", "content").unionByName(new.select("conv_id", F.struct(F.col("_at").alias("t"), F.lit(0).alias("s"), F.col("part").alias("p")).alias("_o"), "role", "call_id", "content"))
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("_o")) - 1
    return both.select("conv_id", turn.alias("turn"), "role", "call_id", "content")


def search_tools(hits: DataFrame, k: int) -> DataFrame:
    """The tools bucket alone, by server, of searches that ask for any number of hits: k below 1 is the default, and there is no upper bound."""
    return grouped_tools(hits.where(F.col("rank") < clamp_k(k, TOOLS_K, None)))
