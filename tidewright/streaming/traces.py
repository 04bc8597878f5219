"""Trace streams: the learner's pairing and invocation correlation as keyed state, and fan-out to several sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.sources.tracelog import MOST_PENDING

PAIRED = "session string, log_seq long, kind string, capability_id string, ts long, search_seq long, query string, first_confirmation boolean"


#: Sessions are dealt by hash to so many keys of state: a call for each session and batch would cost more than its rows.
BUCKETS = 512
_HELD = "sessions array<string>, search_seqs array<long>, queries array<string>, used array<boolean>"


def _pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The sessions of one bucket: what is held of each, its last search, comes before its rows."""
    rows = pd.concat(list(frames), ignore_index=True)
    sessions, searches, queries, used = state.get if state.exists else ([], [], [], [])
    held, n = len(sessions), len(sessions) + len(rows)
    session = np.array([*sessions, *rows["session"]], object)
    code = pd.factorize(session)[0]
    seq = np.concatenate((np.array(searches, np.int64), rows["log_seq"].to_numpy(np.int64)))
    order = np.lexsort((seq, np.arange(n) >= held, code))
    search = np.concatenate((np.ones(held, bool), (rows["role"] == "search").to_numpy(bool)))[order]
    code, at = code[order], np.arange(n)
    last = np.maximum.accumulate(np.where(search, at, -1))  # place of the search that a row belongs to
    known = (last >= 0) & (code[last] == code)
    query = np.array([*queries, *(q if isinstance(q, str) else "" for q in rows["query"])], object)
    spent = np.concatenate((np.array(used, bool), np.zeros(len(rows), bool)))[order]
    found = np.flatnonzero(known & ~search)
    of = last[found]
    first = np.diff(of, prepend=-1) != 0
    first &= ~spent[of]
    spent[of] = True
    kept = last[np.flatnonzero(known & (np.diff(code, append=-1) != 0))]
    state.update((session[order[kept]].tolist(), seq[order[kept]].tolist(), query[order[kept]].tolist(), spent[kept].tolist()))
    if len(found):
        own = rows.iloc[order[found] - held]
        yield pd.DataFrame({"session": own["session"].to_numpy(), "log_seq": own["log_seq"].to_numpy(), "kind": own["role"].to_numpy(), "capability_id": own["capability_id"].to_numpy(), "ts": own["ts"].to_numpy(), "search_seq": seq[order[of]], "query": query[order[of]], "first_confirmation": first})


def paired(events: DataFrame) -> DataFrame:
    """What learning.pair() gives, from a stream of (session, log_seq, role, query, capability_id, ts): the state of a session is its last search."""
    rows = events.where("role is not null").select(F.pmod(F.xxhash64("session"), F.lit(BUCKETS)).alias("bucket"), F.coalesce(F.col("session").cast("string"), F.lit("None")).alias("session"), "log_seq", "role", "query", "capability_id", "ts")
    return rows.groupBy("bucket").applyInPandasWithState(_pair, PAIRED, _HELD, "append", GroupStateTimeout.NoTimeout)


CORRELATED = "source_id string, tool_id string, log_seq long, type string, invocation string"


def _correlate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    waiting = list(state.get[0]) if state.exists else []
    out = []
    for r in pd.concat(list(frames)).sort_values("log_seq").itertuples():
        given = r.invocation_id if isinstance(r.invocation_id, str) else None
        if given is None:
            if r.type == "invoke_start":
                waiting = [*waiting, int(r.log_seq)][-MOST_PENDING:]
                given = str(r.log_seq)
            else:
                given = str(waiting.pop(0) if waiting else r.log_seq)
        elif r.type != "invoke_start":
            waiting = [w for w in waiting if str(w) != given]
        out.append([*map(str, key), r.log_seq, r.type, given])
    state.update((waiting,))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in CORRELATED.split(", ")])


def correlated(events: DataFrame) -> DataFrame:
    """Starts and ends of a stream with their invocation ids, first in first out per source and tool."""
    some = events.where("type in ('invoke_start', 'invoke_end', 'invoke_error')")
    return some.groupBy("source_id", "tool_id").applyInPandasWithState(_correlate, CORRELATED, "waiting array<long>", "append", GroupStateTimeout.NoTimeout)


def fan_out(events: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """One stream to several sinks, batch by batch: a slow sink holds the source back, nothing is dropped."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def learn_and_forward(events: DataFrame, learned: str, forwarded: str, checkpoint: str) -> list:
    """A learner before a sink: the trace goes on to `forwarded` untouched, and what pairing learns from it (paired()) to `learned`. Two streams of one source, each with its own progress."""
    raw = events.drop("role").writeStream.format("parquet").option("path", forwarded).option("checkpointLocation", f"{checkpoint}/forwarded")
    pairs = paired(events.select("session", "log_seq", "role", "query", "capability_id", "ts")).writeStream.format("parquet").option("path", learned).option("checkpointLocation", f"{checkpoint}/learned")
    return [w.trigger(availableNow=True).start() for w in (raw, pairs)]
