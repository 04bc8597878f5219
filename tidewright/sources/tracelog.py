"""Trace logs as JSON lines: read with line numbers, written, wrapped into envelopes."""

from __future__ import annotations

import secrets
import time
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.workers import reach

# Envelope version, the alphabet of event ids, and bounds of published events.
VERSION, ALPHABET = 2, "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
#: Fixed value: starts of one tool that wait for their ends.
MOST_PENDING = 1024
MOST_PAYLOAD, MOST_QUERY, MOST_HITS, MOST_STRING, MOST_ITEMS = 65_536, 4096, 100, 4096, 100

EVENT = (
    "v int, event_id string, ts long, session_id string, source_id string, invocation_id string, type string, query string, origin string, top_k int, "
    "hits array<struct<id:string, tool_id:string, skill_id:string, fact_id:string, score:double>>, "
    "stages array<struct<name:string, took_ms:long, top_score:double>>, tool_id string, skill_id string, fact_id string, took_ms long, args_size_bytes long, error string, reason string, kind string"
)


def parse(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Events of (value, …) lines: blank lines are skipped, a line that is no JSON fails the read (or, if not strict, is left out). Hit ids get one name."""
    full = lines.where(F.trim("value") != "")
    read = full.withColumn("e", F.from_json("value", EVENT, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))
    if not strict:
        read = read.where("e is not null and e.type is not null")
    flat = read.select(*(c for c in lines.columns if c != "value"), "e.*")
    return flat.withColumn("hits", F.transform("hits", lambda h: F.struct(F.coalesce(h["id"], h["tool_id"], h["skill_id"], h["fact_id"]).alias("id"), h["score"].alias("score"))))


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events with their file, line (from 0, in the file's order) and log_seq, which follows the files' names and the lines in them."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"))
    order = Window.partitionBy("file").orderBy("_at", "_i")
    names = lines.select("file").distinct().withColumn("_f", F.row_number().over(Window.orderBy("file")) - 1)  # a row a file
    placed = lines.withColumn("line", (F.row_number().over(order) - 1).cast("long")).join(F.broadcast(names), "file")
    return parse(placed.select("value", "file", "line", (F.shiftleft(F.col("_f").cast("long"), 40) + F.col("line")).alias("log_seq")), strict)


def write(events: DataFrame, path: str) -> None:
    events.write.mode("append").option("ignoreNullFields", "true").json(path)


def ulid(ts_ms: int | None = None) -> str:
    """Ten characters of time and sixteen of chance."""
    n = (int(time.time() * 1000) if ts_ms is None else ts_ms) << 80 | secrets.randbits(80)
    return "".join(ALPHABET[n >> 5 * i & 31] for i in range(25, -1, -1))


def event_id(ts: Column, *unique: Column) -> Column:
    """An event id of the same form that is a function of its columns, so that a stage that is run again writes the same ids."""
    alphabet = F.array(*(F.lit(c) for c in ALPHABET))
    moment = F.array_join(F.transform(F.sequence(F.lit(9), F.lit(0)), lambda i: F.get(alphabet, F.call_function("shiftright", ts, 5 * i).bitwiseAND(F.lit(31)).cast("int"))), "")
    chance = F.sha2(F.concat_ws("|", *(u.cast("string") for u in unique)), 256)
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get(alphabet, F.conv(F.substring(chance, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % 32)), "")
    return F.concat(moment, digits)


def envelope(events: DataFrame, session: Column, source: Column, ts: Column, unique: list[str]) -> DataFrame:
    return events.select(F.lit(VERSION).alias("v"), event_id(ts, *(F.col(c) for c in unique)).alias("event_id"), ts.alias("ts"), session.alias("session_id"), source.alias("source_id"), *events.columns)


def bounded(events: DataFrame) -> DataFrame:
    """Events within the bounds of what is published: whole characters of the query up to 4 KiB, 100 hits."""
    size = F.octet_length("query")
    cut = F.when(size <= MOST_QUERY, F.col("query")).otherwise(F.regexp_replace(F.decode(F.substring(F.encode("query", "UTF-8"), 1, MOST_QUERY), "UTF-8"), "�+$", ""))
    return events.withColumn("query", cut).withColumn("hits", F.slice("hits", 1, MOST_HITS))


def _queue(sorted_by: str):
    """Starts and ends, sorted by source, tool and order, each with the start's place that its invocation is named by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting = None, deque(maxlen=MOST_PENDING)
        for batch in batches:
            made = []
            for source, tool, place, starts, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (source, tool) != here:
                    here = source, tool
                    waiting.clear()
                if given is not None:
                    if not starts and given in waiting:
                        waiting.remove(given)
                    made.append(given)
                elif starts:
                    waiting.append(str(place))  # the oldest goes if there are too many
                    made.append(str(place))
                else:
                    made.append(waiting.popleft() if waiting else str(place))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(made, pa.string())], names=[sorted_by, "invocation"])

    return run


def correlate(events: DataFrame, order: str = "log_seq") -> DataFrame:
    """events with invocation: an id that is given counts; a start without one is named by its place and waits; an end without one takes the oldest start of its source and tool that waits; if none does, it takes nothing and has an id of its own.

    events: (source_id, tool_id, type, invocation_id, log_seq). At most MOST_PENDING starts of a tool wait; the oldest
    go. An end that is given the name of a start takes it from those that wait. Rows are sorted by Spark and read as
    a stream, so a tool of any length takes the memory of its waiting starts only."""
    reach(events.sparkSession)
    some = events.where(F.col("type").isin("invoke_start", "invoke_end", "invoke_error"))
    dealt = some.select("source_id", "tool_id", F.col(order).cast("long").alias(order), (F.col("type") == "invoke_start").alias("starts"), F.col("invocation_id").cast("string").alias("given")).repartition("source_id", "tool_id").sortWithinPartitions("source_id", "tool_id", order)
    made = dealt.mapInArrow(_queue(order), f"{order} long, invocation string")
    return events.join(made, order, "left").withColumn("invocation", F.coalesce("invocation", "invocation_id"))


def loss_windows(events: DataFrame, capacity: int, drained: int, by: str = "subscriber", order: str = "log_seq") -> DataFrame:
    """(subscriber, n, first_ts, last_ts) of what a queue of `capacity` that is drained after every `drained` arrivals loses: the oldest go."""
    turn = Window.partitionBy(by).orderBy(order)
    placed = events.withColumn("_n", F.row_number().over(turn) - 1).withColumn("_batch", F.floor(F.col("_n") / drained))
    late = Window.partitionBy(by, "_batch").orderBy(F.col(order).desc())
    lost = placed.withColumn("_back", F.row_number().over(late)).where(F.col("_back") > capacity)
    return lost.groupBy(by).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def sampled(events: DataFrame, rate: float = 1.0, key: str = "event_id") -> DataFrame:
    """A share of events by the MD5 of a key, the same in every run."""
    digits = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return events if rate >= 1 else events.where(digits < int(rate * 2**32))
