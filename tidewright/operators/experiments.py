"""Experiments: assignment, agreement of rankings, shadow admission, attribution of invocations."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tidewright.functions.schema_walk import SAFE_INTEGER
from tidewright.operators.catalog import json_strings
from tidewright.operators.walk import walked

# Fixed values.
AGREEMENT_K, MOST_UNITS, MOST_SELECTIONS = 10, 1000, 32


def unit_hash(unit: Column) -> Column:
    return F.substring(F.sha2(unit, 256), 1, 16)


def draw(experiment: Column, unit: Column, total: int) -> Column:
    """The hash of experiment and unit, as a whole 256-bit number, modulo the total weight: hex digits are folded one by one."""
    digits = F.split(F.sha2(json_strings(F.array(experiment, unit)), 256), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("long")) % total)


def assign(experiment: Column, unit: Column, split: Sequence[tuple[str, int]], explicit: Column | None = None) -> Column:
    """The arm whose range, in declared order, the draw falls in; an arm that is asked for wins."""
    at, upto, arm = draw(experiment, unit, sum(w for _, w in split)), 0, None
    for name, weight in split:
        upto += weight
        arm = F.when(at < upto, name) if arm is None else arm.when(at < upto, name)
    return arm if explicit is None else F.coalesce(explicit, arm)


def validate_split(arms: Sequence[str], split: Sequence[tuple[str, int]]) -> list[str]:
    """What is wrong with a split: it names every arm once, with safe-integer weights from 0 that sum to a positive safe integer."""
    names = [a for a, _ in split]
    found = [f"unknown arm {a}" for a in names if a not in arms] + [f"arm {a} missing" for a in arms if a not in names] + [f"arm {a} repeated" for a in sorted({a for a in names if names.count(a) > 1})]
    found += [f"weight of {a}" for a, w in split if isinstance(w, bool) or not isinstance(w, int) or not 0 <= w <= SAFE_INTEGER]
    return found if found or 0 < sum(w for _, w in split) <= SAFE_INTEGER else ["total weight"]


#: What an evaluation may refer to.
PEER, INVOCATION = "peer-selection", "invocation"


def _whole(x: object, least: int) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= least


def validate_config(config: dict[str, Any]) -> list[str]:
    """What is wrong with an experiment: {"arms": [...], "fallback": arm, "concurrency": n, "split": [(arm, weight)], "evaluation": {"k": n, "references": [PEER or {"kind": INVOCATION, "last": n, "max_age_ms": n, "every": bool}], "outcome": bool}}."""
    arms, evaluation = list(config.get("arms") or []), config.get("evaluation") or {}
    found = [] if arms else ["no arms"]
    if config.get("fallback") is not None and config["fallback"] not in arms:
        found.append("unknown fallback arm")
    if config.get("concurrency") is not None and not _whole(config["concurrency"], 1):
        found.append("concurrency")
    references = list(evaluation.get("references") or [])
    if not references:
        found.append("no references")
    if evaluation.get("k") is not None and not _whole(evaluation["k"], 1):
        found.append("k")
    kinds = [r if isinstance(r, str) else r.get("kind") for r in references]
    found += [f"reference {k}" for k in kinds if k not in (PEER, INVOCATION)] + [f"{k} repeated" for k in (PEER, INVOCATION) if kinds.count(k) > 1]
    for r in (r for r in references if isinstance(r, dict)):
        if r.get("last") is None and r.get("max_age_ms") is None:
            found.append("an invocation needs a window")
        if r.get("last") is not None and not (_whole(r["last"], 1) and r["last"] <= MOST_SELECTIONS):
            found.append("last")
        if r.get("max_age_ms") is not None and not _whole(r["max_age_ms"], 1):
            found.append("max_age_ms")
    return found + (validate_split(arms, config["split"]) if config.get("split") is not None else [])


def agreement_k(requested: Column, configured: Column) -> Column:
    valid = lambda k: F.when(k >= 1, k)
    return F.coalesce(valid(requested), valid(configured), F.lit(AGREEMENT_K))


def agreement(a: Column, b: Column, k: Column) -> dict[str, Column]:
    """How two rankings of ids agree: top1, exact order, overlap of the whole lists, Jaccard of the first k (1 if both are empty)."""
    ha, hb = F.array_distinct(F.slice(a, F.lit(1), k)), F.array_distinct(F.slice(b, F.lit(1), k))
    both = F.size(F.array_union(ha, hb))
    return {
        "top1": F.get(a, F.lit(0)).eqNullSafe(F.get(b, F.lit(0))),
        "exact_order": a == b,
        "overlap": F.size(F.array_intersect(a, b)),
        "jaccard": F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(ha, hb)) / both),
    }


def attributes_equal(a: Column, b: Column) -> Column:
    """Which attributes of two results (maps) are equal: one entry for each name that either has; a name that one lacks is unequal."""
    names = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.map_contains_key(a, n) & F.map_contains_key(b, n) & F.element_at(a, n).eqNullSafe(F.element_at(b, n))))


def outcome(error: Column, timed_out: Column, results: Column) -> Column:
    return F.when(F.coalesce(timed_out, F.lit(False)), "timeout").when(error.isNotNull(), "error").when(F.coalesce(results, F.lit(0)) == 0, "empty").otherwise("ok")


def serve(selections: DataFrame, runs: DataFrame, fallback: str | None) -> DataFrame:
    """(selection_id, assigned_arm, effective_arm, outcome, reused_shadow) of what was served.

    selections (selection_id, assigned_arm); runs (selection_id, arm, role, error, timed_out, source, results): source is
    where a failed run failed, select or transform. Only where the assigned arm failed to select, and another arm
    is the fallback, does that serve: the run that it has as a shadow, or one of its own. Without a sound run
    nothing is served and effective_arm is null."""
    told = runs.select("selection_id", "arm", "role", "source", outcome(F.col("error"), F.col("timed_out"), F.col("results")).alias("outcome"))
    serving = told.where(F.col("role") == "serving").groupBy("selection_id", "arm").agg(F.max(F.struct("outcome", "source")).alias("s"))
    shadow = told.where(F.col("role") == "shadow").groupBy("selection_id", "arm").agg(F.max("outcome").alias("h"))
    mine = serving.select("selection_id", F.col("arm").alias("assigned_arm"), F.col("s.outcome").alias("_o"), F.col("s.source").alias("_from"))
    other = lambda df, column, name: df.where(F.col("arm") == F.lit(fallback)).select("selection_id", F.col(column).alias(name))
    joined = selections.join(mine, ["selection_id", "assigned_arm"], "left").join(other(shadow, "h", "_shadow"), "selection_id", "left").join(other(serving, "s.outcome", "_second"), "selection_id", "left")
    sound = lambda c: F.coalesce(F.col(c).isin("ok", "empty"), F.lit(False))
    turns = ~sound("_o") & F.coalesce(F.col("_from") == "select", F.lit(False)) & (F.lit(fallback).isNotNull() & ~F.col("assigned_arm").eqNullSafe(F.lit(fallback)))
    reused = turns & F.col("_shadow").isNotNull()
    second = F.when(reused, F.col("_shadow")).otherwise(F.col("_second"))
    final = F.when(turns, second).otherwise(F.col("_o"))
    served = F.coalesce(final.isin("ok", "empty"), F.lit(False))
    return joined.select("selection_id", "assigned_arm", F.when(served, F.when(turns, F.lit(fallback)).otherwise(F.col("assigned_arm"))).alias("effective_arm"), F.coalesce(final, F.lit("error")).alias("outcome"), (reused & served).alias("reused_shadow"))


def _typed(df: DataFrame, **more: str) -> StructType:
    return StructType([df.schema[c] if c in df.columns else StructField(c, _parse_datatype_string(t)) for c, t in more.items()])


def admit_shadows(starts: DataFrame, concurrency: int = 1) -> DataFrame:
    """starts (experiment_id, seq, start_ms, end_ms) with admitted: a shadow that finds all places taken is skipped, never queued."""

    def step(busy: list[int], row: dict[str, Any]) -> list[tuple]:
        busy[:] = [end for end in busy if end > row["start_ms"]]
        admitted = len(busy) < concurrency
        if admitted:
            busy.append(row["end_ms"])
        return [(row["seq"], admitted)]

    return walked(starts, ["experiment_id"], ["start_ms", "seq"], list, step, None, _typed(starts, experiment_id="string", seq="long", admitted="boolean"))


def warmups(calls: DataFrame) -> DataFrame:
    """calls (arm, seq, at_ms, took_ms, failed) of arms that warm up, with runs and cold: a warmup runs if none has succeeded or is running; one that fails is tried again by the next call. A call is cold until a warmup has succeeded."""

    def step(state: dict[str, Any], row: dict[str, Any]) -> list[tuple]:
        if state["ends"] is not None and state["ends"] <= row["at_ms"]:
            state.update(warm=state["good"], ends=None)
        cold, runs = not state["warm"], not state["warm"] and state["ends"] is None
        if runs:
            state.update(ends=row["at_ms"] + row["took_ms"], good=not row["failed"])
        return [(row["seq"], runs, cold)]

    return walked(calls, ["arm"], ["at_ms", "seq"], lambda: {"warm": False, "ends": None, "good": False}, step, None, _typed(calls, arm="string", seq="long", runs="boolean", cold="boolean"))


def drop_reason(arm_failed: Column, selection_failed: Column, fallback: Column, served_failed: Column, compare_failed: Column) -> Column:
    return F.when(arm_failed, "arm-failed").when(selection_failed, "selection-failed").when(fallback, "fallback-consumed").when(served_failed, "served-ranking-failed").when(compare_failed, "comparison-failed")


def attribute(selections: DataFrame, invocations: DataFrame, last: int = 1, max_age_ms: int | None = None, every: bool = False) -> DataFrame:
    """(invocation_id, selection_id, rank): invocations to the unit's latest selections before them; rank is the tool's place in the selection, or -1.

    selections (unit, selection_id, at_ms, ids), invocations (unit, invocation_id, at_ms, tool_id). Selections of one
    millisecond follow each other by their id. Of a unit's latest `last` selections the newest counts, or every one. The as-of join goes by a window over both, never by all pairs."""
    last = min(last, MOST_SELECTIONS)
    s = selections.select("unit", "at_ms", F.lit(0).alias("side"), F.struct("selection_id", "at_ms", "ids").alias("sel"), F.lit(None).cast(dict(invocations.dtypes)["invocation_id"]).alias("invocation_id"), F.lit(None).cast("string").alias("tool_id"))
    i = invocations.select("unit", "at_ms", F.lit(1).alias("side"), F.lit(None).cast(s.schema["sel"].dataType).alias("sel"), "invocation_id", F.col("tool_id").cast("string").alias("tool_id"))
    order = Window.partitionBy("unit").orderBy("at_ms", "side", "sel.selection_id")
    both = s.unionByName(i).withColumn("n", F.sum((F.col("side") == 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = both.where("side = 0").select("unit", F.col("n").alias("k"), "sel")
    wanted = both.where("side = 1 and n > 0").withColumn("k", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - last + 1), F.col("n"))))
    if not every:
        wanted = wanted.where("k = n")
    joined = wanted.drop("sel").join(chosen, ["unit", "k"])
    if max_age_ms is not None:
        joined = joined.where(F.col("at_ms") - F.col("sel.at_ms") <= max_age_ms)
    return joined.select("invocation_id", F.col("sel.selection_id").alias("selection_id"), (F.array_position("sel.ids", F.col("tool_id")) - 1).cast("int").alias("rank"))


def delayed_outcomes(outcomes: DataFrame, selections: DataFrame) -> DataFrame:
    """Outcomes (selection_id, label, score) that are sound: a known selection, a label, and a score that is a number or null."""
    known = outcomes.join(selections.select("selection_id"), "selection_id", "left_semi")
    return known.where((F.coalesce(F.length(F.trim("label")), F.lit(0)) > 0) & (F.col("score").isNull() | ~F.isnan("score") & (F.abs("score") != float("inf"))))
