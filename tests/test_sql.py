"""SQL functions give what the column expressions give."""

from pyspark.sql import functions as F

from tidewright import sql
from tidewright.functions import text
from tidewright.operators import experiments, usage


def test_functions(spark, small):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS) and {"documents", "part"} <= set(sql.views(spark, small))
    d = spark.table("documents")
    got = spark.sql("SELECT doc_id, usage_tokens(text) AS t, compact_description(text) AS c, unit_hash(source) AS u FROM documents")
    want = d.select("doc_id", text.usage_tokens(F.col("text")).alias("t"), text.compact_description(F.col("text")).alias("c"), experiments.unit_hash(F.col("source")).alias("u"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    names = spark.createDataFrame([("getUser_Id__x",), ("a_B",), ("plain",), ("__x",)], "s string")
    names.createOrReplaceTempView("names")
    got = spark.sql("SELECT s, push_identifier(s) AS p, server_of(s) AS v FROM names").collect()
    assert got == names.select("s", text.push_identifier(F.col("s")).alias("p"), text.server_of(F.col("s")).alias("v")).collect()
    ages = spark.range(6).select((F.col("id") * 40 * 86_400_000).alias("age"), "id")
    ages.createOrReplaceTempView("ages")
    got = [r[0] for r in spark.sql("SELECT usage_weight(id, 20000000000, 20000000000 - age) FROM ages").collect()]
    assert got == [r[0] for r in ages.select(usage.arm_weight(F.col("id"), F.lit(20_000_000_000), F.lit(20_000_000_000) - F.col("age"))).collect()]
    assert [r[0] for r in spark.sql("SELECT usage_similarity('read a file', 'Read the FILE now') UNION ALL SELECT usage_similarity('the', 'of')").collect()] == [2 / 3, None]
