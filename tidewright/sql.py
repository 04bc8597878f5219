"""The scalar functions as SQL functions of a session, and a folder's tables as views, for those who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewright.functions.text import LEAST_HEAD, MAX_DESCRIPTION, STOPWORDS
from tidewright.operators.usage import ARM_WEIGHT, FULL_SUPPORT, GRACE_MS, HALF_LIFE_MS
from tidewright.workers import files

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
#: Name, parameters, result and body; a function may use those before it.
FUNCTIONS = (
    ("split_identifier", "s STRING", "STRING", r"replace(regexp_replace(s, r'(?<=\p{Ll})(?=\p{Lu})', ' '), '_', ' ')"),
    ("push_identifier", "s STRING", "STRING", "CASE WHEN split_identifier(s) = s THEN s ELSE concat_ws(' ', s, split_identifier(s)) END"),
    ("usage_tokens", "t STRING", "ARRAY<STRING>", rf"filter(regexp_extract_all(lower(t), r'([\p{{L}}\p{{N}}]+)', 1), x -> x NOT IN ({_STOP}))"),
    ("usage_similarity", "a STRING, b STRING", "DOUBLE", "size(array_intersect(usage_tokens(a), usage_tokens(b))) / nullif(size(array_union(usage_tokens(a), usage_tokens(b))), 0)"),
    ("compact_description", "s STRING", "STRING", f"""CASE WHEN length(trim(regexp_replace(s, r'\\s+', ' '))) <= {MAX_DESCRIPTION} THEN trim(regexp_replace(s, r'\\s+', ' '))
        ELSE concat(rtrim(regexp_replace(substring(trim(regexp_replace(s, r'\\s+', ' ')), 1, {MAX_DESCRIPTION - 1}), r'^(.{{{LEAST_HEAD + 1},}}) [^ ]*$', '$1')), '…') END"""),
    ("server_of", "tool STRING", "STRING", "CASE WHEN instr(tool, '__') > 1 THEN substring_index(tool, '__', 1) ELSE tool END"),
    ("usage_recency", "newest BIGINT, last BIGINT", "DOUBLE", f"CASE WHEN newest - last <= {GRACE_MS} THEN 1D ELSE power(2D, -(newest - last - {GRACE_MS}) / {float(HALF_LIFE_MS)}D) END"),
    ("usage_weight", "support BIGINT, newest BIGINT, last BIGINT", "DOUBLE", f"{ARM_WEIGHT}D * least(1D, support / {float(FULL_SUPPORT)}D) * usage_recency(newest, last)"),
    ("unit_hash", "unit STRING", "STRING", "substring(sha2(unit, 256), 1, 16)"),
)


def register(spark: SparkSession) -> list[str]:
    """Make FUNCTIONS temporary functions of the session; their names."""
    for name, takes, gives, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    return [name for name, *_ in FUNCTIONS]


def views(spark: SparkSession, folder: str) -> list[str]:
    """Make every name.parquet in a folder a view of its name; their names."""
    at, system = files(spark, folder)
    found = sorted(name.removesuffix(".parquet") for f in system.listStatus(at) if (name := f.getPath().getName()).endswith(".parquet"))
    for name in found:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    return found
