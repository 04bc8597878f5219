"""Every registered query of the reference's operators against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from tidewright.plans import PLANS


def rows(frame):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in PLANS.items() if sql))
def test_query_equals_sql(spark, small, duck, name):
    run, sql = PLANS[name]
    found, wanted = run(spark, small).toPandas(), duck.execute(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(PLANS) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_last_user_text_of_whole_conversations(spark, tmp_path):
    turns = [(c, t, ("user", "assistant")[(t + c) % 2], f"{c}.{t}") for c in range(6) for t in range(c + 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r["text"] for r in PLANS["last_user_text"][0](spark, str(tmp_path)).collect()}
    assert got == {c: f"{c}.{c}" for c in range(6)}
    closed = [(c, c + 1, "assistant", "closed") for c in (1, 4)]
    spark.createDataFrame(turns + closed, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert {r["conv_id"] for r in PLANS["last_user_text"][0](spark, str(tmp_path)).collect()} == {0, 2, 3, 5}


def test_bm25_stats_of_rare_terms(spark, tmp_path):
    texts = [(i, f"common word{i // 2}") for i in range(10)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["term"]: r["df"] for r in PLANS["bm25_stats"][0](spark, str(tmp_path)).collect()}
    assert got == {"common": 10} | {f"word{i}": 2 for i in range(5)}


def test_lexical_match_of_whole_items(spark, tmp_path):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(1, 0, "user", items[2][1][160:]), (2, 0, "user", "something else")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["query_id"]: (r["intent_id"], r["score"]) for r in PLANS["lexical_match"][0](spark, str(tmp_path)).collect()}
    assert {q: v for q, v in got.items() if q < 0} == {-i - 1: (f"intent_{i}", 1.0) for i in range(3)}
    assert got[1000][0] == "intent_2" and 2000 not in got
