"""Queries over the usage graph, capability search, grounding, traces and experiments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import bm25, capability, dense, experiments, grounding, learning, search, usage
from tidewright.plans import inputs
from tidewright.plans.inputs import table
from tidewright.plans.retrieval import _ASKED, sql_bm25, sql_tokens
from tidewright.sources import tracelog
from tidewright.workers import shared_dir

# The trace log of the events table, in SQL.
_TRACE = """trace AS (SELECT user_id AS session, event_id AS log_seq, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'invoke_start' WHEN 'purchase' THEN 'skill_invoke' ELSE event_type END AS type,
  'topic ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS query, 'tool_' || CAST(event_id % 17 AS VARCHAR) AS capability_id, epoch_us(ts) // 1000 AS ts FROM events),
roles AS (SELECT *, CASE type WHEN 'search' THEN 'search' WHEN 'invoke_start' THEN 'tool' WHEN 'skill_invoke' THEN 'skill' END AS role FROM trace),
seen AS (SELECT *, last_value(CASE WHEN role = 'search' THEN log_seq END IGNORE NULLS) OVER (PARTITION BY session ORDER BY log_seq ROWS UNBOUNDED PRECEDING) AS search_seq FROM roles WHERE role IS NOT NULL),
paired AS (SELECT s.session, s.log_seq, s.role AS kind, s.capability_id, s.ts, s.search_seq, q.query, row_number() OVER (PARTITION BY s.session, s.search_seq ORDER BY s.log_seq) = 1 AS first_confirmation
  FROM seen s JOIN trace q ON q.log_seq = s.search_seq WHERE s.role <> 'search')"""


def session_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN1, LN2, LN3: only searches of origin agent count, the others are no boundary."""
    return learning.observations_from(inputs.trace(spark, sf_dir), "agent").select("session", "log_seq", "kind", "capability_id", "search_seq", "query")


_AGENT = _TRACE.replace("WHEN 'search' THEN 'search'", "WHEN 'search' THEN CASE WHEN log_seq % 7 <> 0 THEN 'search' END", 1)
PAIRING = f"WITH {_AGENT} SELECT session, log_seq, kind, capability_id, search_seq, query FROM paired"


def first_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN4"""
    return learning.observations_from(inputs.trace(spark, sf_dir)).where("first_confirmation").select("session", "search_seq", "log_seq")


FIRST = f"WITH {_TRACE} SELECT session, search_seq, log_seq FROM paired WHERE first_confirmation"


def distinct_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN13"""
    return learning.distinct_queries(learning.observations_from(inputs.trace(spark, sf_dir)))


DISTINCT = f"WITH {_TRACE} SELECT query, min(log_seq) AS first_seq FROM paired GROUP BY query"


def graph_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph per part of the sessions, and for every other one vectors of the topics, some of another model."""
    seen = learning.observations_from(inputs.trace(spark, sf_dir)).withColumn("graph_id", (F.col("session") % 4).cast("string"))
    topics = inputs.vectors(spark, sf_dir).select(F.concat(F.lit("topic "), F.col("id").cast("string")).alias("query"), F.col("vec").cast("array<double>").alias("v"))
    known = seen.join(topics, "query", "left").withColumn("vec", F.when(F.col("session") % 2 == 0, F.col("v"))).drop("v")
    return known.withColumn("model", F.when(F.col("vec").isNotNull(), F.when(F.col("log_seq") % 5 == 0, "other").otherwise("m"))).withColumn("seeded", F.col("log_seq") % 6 == 0)


def graph_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN6-LN11, LN14: graphs folded in log order. The rule is recursive; tests hold this query against brute force."""
    made = learning.fold(graph_observations(spark, sf_dir))
    return made.select("graph_id", "intent_id", F.array_join("members", "|").alias("members"), "support", "seeded_support", "last_ts", "rev", "model", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("centroid"), F.to_json("tools").alias("tools"), F.to_json("skills").alias("skills"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph by events: each topic an intent with its query as member, edges by kind and capability, support by confirmed searches."""
    seen = learning.observations_from(inputs.trace(spark, sf_dir)).withColumn("intent_id", F.replace("query", F.lit(" "), F.lit("_")))
    members = seen.select("intent_id", F.col("query").alias("text")).distinct()
    edges = seen.groupBy("intent_id", "kind", "capability_id").agg(F.count("*").cast("double").alias("weight"))
    intents = seen.groupBy("intent_id").agg(F.sum(F.col("first_confirmation").cast("long")).alias("support"), F.max("ts").alias("last_ts"))
    return members, edges, intents


_GRAPH = _TRACE + """,
g AS (SELECT *, replace(query, ' ', '_') AS intent_id FROM paired),
edges AS (SELECT intent_id, kind, capability_id, CAST(count(*) AS DOUBLE) AS weight FROM g GROUP BY ALL),
intents AS (SELECT intent_id, CAST(sum(CASE WHEN first_confirmation THEN 1 ELSE 0 END) AS BIGINT) AS support, max(ts) AS last_ts FROM g GROUP BY intent_id)"""


def _known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("tool", f"tool_{i}") for i in range(0, 17, 2)], "kind string, id string")


_KNOWN = "capability_id IN (" + ", ".join(f"'tool_{i}'" for i in range(0, 17, 2)) + ") AND kind = 'tool'"


def edge_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """US5"""
    return usage.edge_ranking(_graph(spark, sf_dir)[1], _known(spark)).select("intent_id", "kind", "id", "weight", "rank")


EDGES = f"WITH {_GRAPH} SELECT intent_id, kind, capability_id AS id, weight, CAST(row_number() OVER (PARTITION BY intent_id ORDER BY weight DESC, capability_id) - 1 AS INTEGER) AS rank FROM edges WHERE {_KNOWN}"


def arm_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """US6, US7: with the graph's times stretched, so that some clusters have aged."""
    intents = _graph(spark, sf_dir)[2]
    newest = intents.agg(F.max("last_ts").alias("newest"))
    aged = intents.crossJoin(F.broadcast(newest)).withColumn("last", F.col("newest") - (F.col("newest") - F.col("last_ts")) * 100)
    return aged.select("intent_id", F.round(usage.arm_weight(F.col("support"), F.col("newest"), F.col("last")), 9).alias("weight"))


ARM = f"""WITH {_GRAPH}, n AS (SELECT max(last_ts) AS newest FROM intents), i AS (SELECT intent_id, support, (newest - last_ts) * 100 AS idle FROM intents, n)
SELECT intent_id, round(0.5e0 * least(1e0, support / 3e0) * CASE WHEN idle <= 7776000000 THEN 1e0 ELSE pow(2e0, -(idle - 7776000000) / 7776000000e0) END, 9) AS weight FROM i"""

_TURNS = "SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'"
_ITEMS = "SELECT 'intent_' || CAST(item_id AS VARCHAR) AS intent_id, text FROM benchmark"


def lexical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """US1, US2: user turns, and whole benchmark items, against all benchmark items as members."""
    b = table(spark, sf_dir, "benchmark")
    items = b.select((-F.col("item_id") - 1).alias("query_id"), "text")
    members = b.select(F.concat(F.lit("intent_"), F.col("item_id").cast("string")).alias("intent_id"), "text")
    return usage.lexical_match(inputs.turns(spark, sf_dir).unionByName(items), members).select("query_id", "intent_id", F.round("score", 9).alias("score"))


LEXICAL = f"""
WITH q AS (SELECT query_id, list_distinct({sql_tokens("text")}) AS t FROM ({_TURNS} UNION ALL SELECT -item_id - 1, text FROM benchmark)),
m AS (SELECT intent_id, list_distinct({sql_tokens("text")}) AS t FROM ({_ITEMS})),
s AS (SELECT query_id, intent_id, max(CAST(len(list_intersect(q.t, m.t)) AS DOUBLE) / (len(q.t) + len(m.t) - len(list_intersect(q.t, m.t)))) AS score FROM q, m WHERE len(q.t) > 0 AND len(m.t) > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, intent_id) AS r FROM s WHERE score >= 0.5e0)
SELECT query_id, intent_id, round(score, 9) AS score FROM r WHERE r = 1"""


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = inputs.vectors(spark, sf_dir)
    return dense.rebuild_centroids(v.select(F.col("label").alias("cluster"), "id"), v.select("id", "vec"))


def centroid_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN12: the sum and the first component of each centroid."""
    c = _centroids(spark, sf_dir)
    return c.select("cluster", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


_CENTROIDS = """
m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS l FROM m GROUP BY label),
c AS (SELECT m.label, list(round(x / l, 9) ORDER BY i) AS c FROM m JOIN n ON m.label = n.label GROUP BY m.label)"""
CENTROID = f"WITH {_CENTROIDS} SELECT label AS cluster, round(c[1], 6) AS first, round(list_sum(c), 5) AS total FROM c"


def dense_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """US3, US4's dense tier: vectors against the centroids of pairs of vectors."""
    v = inputs.vectors(spark, sf_dir)
    pairs = dense.rebuild_centroids(v.select(F.floor(F.col("id") / 2).cast("long").alias("cluster"), "id"), v.select("id", "vec"))
    return usage.dense_match(v.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), pairs.select(F.col("cluster").alias("intent_id"), "centroid"), 6)


_PAIRS = _CENTROIDS.replace("label", "(vec_id // 2)", 1).replace("SELECT (vec_id // 2),", "SELECT vec_id // 2 AS label,", 1)
DENSE = f"""WITH {_PAIRS},
s AS (SELECT vec_id AS query_id, label2 AS intent_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), c) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_inner_product(c, c)), 6) AS score
  FROM embeddings, (SELECT label AS label2, c FROM c)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, intent_id) AS r FROM s WHERE score >= 0.7e0)
SELECT query_id, intent_id, score FROM r WHERE r = 1"""


def usage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """US8, US4: what each topic query, and one without a cluster, is served with when half the tools are known."""
    members, edges, intents = _graph(spark, sf_dir)
    q = members.select(F.col("text").alias("query_id"), "text").unionByName(spark.createDataFrame([("none", "no such topic at all")], "query_id string, text string"))
    served = usage.serve_match(q.withColumn("qvec", F.lit(None).cast("array<float>")), intents.withColumn("centroid", F.lit(None).cast("array<double>")), members, edges, _known(spark))
    return served.select("query_id", "intent_id", "kept", "dropped", "outcome", "tier")


OUTCOMES = f"""WITH {_GRAPH}, c AS (SELECT intent_id, count(*) FILTER ({_KNOWN}) AS kept, count(*) FILTER (NOT ({_KNOWN})) AS dropped FROM edges GROUP BY intent_id)
SELECT replace(intent_id, '_', ' ') AS query_id, intent_id, kept, dropped, CASE WHEN kept > 0 THEN 'armed' ELSE 'all_filtered' END AS outcome, 'lexical' AS tier FROM c
UNION ALL SELECT 'none', NULL, 0, 0, 'no_match', 'lexical'"""


def usage_boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT7: BM25 with an arm for two of the queries; the others keep their raw scores."""
    arm = spark.createDataFrame([("q1", 5, 0, 0.5), ("q1", 7, 1, 0.5), ("q6", 3, 0, 0.25)], "query_id string, id long, rank int, weight double")
    return search.search("bm25", 10, inputs.asked(spark), bm25.kept(inputs.documents(spark, sf_dir)), arm=arm).drop("kind")


BOOSTED = f"""
WITH a AS ({sql_bm25("SELECT doc_id AS id, text FROM documents", 100)}),
arm AS (SELECT * FROM (VALUES ('q1', 5, 0, 0.5e0), ('q1', 7, 1, 0.5e0), ('q6', 3, 0, 0.25e0)) AS t(query_id, id, rank, weight)),
f AS (SELECT query_id, id, round(sum(p), 9) AS score FROM (SELECT query_id, id, 1e0 / (6e1 + rank) AS p FROM a WHERE query_id IN ('q1', 'q6') UNION ALL SELECT query_id, id, weight / (6e1 + rank) FROM arm) GROUP BY query_id, id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM f)
SELECT query_id, CAST(id AS BIGINT) AS id, score, rank, true AS fused FROM r WHERE rank < 10 UNION ALL SELECT query_id, id, score, rank, false FROM a WHERE rank < 10 AND query_id NOT IN ('q1', 'q6')"""


def ctfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN16: what sets the languages apart."""
    return learning.label_terms(table(spark, sf_dir, "documents").select(F.col("lang").alias("cluster"), "text"), 5, digits=12).select("cluster", "term", "score", "rank")


CTFIDF = f"""
WITH t AS (SELECT lang AS cluster, unnest({sql_tokens("text")}) AS term FROM documents), l AS (SELECT cluster, term, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY ALL),
f AS (SELECT term, sum(n) AS f FROM l GROUP BY term), s AS (SELECT cluster, sum(n) AS len FROM l GROUP BY cluster), a AS (SELECT (SELECT sum(n) FROM l) / (SELECT CAST(count(DISTINCT lang) AS DOUBLE) FROM documents) AS avg),
r AS (SELECT cluster, term, round((n / len) * ln(1e0 + avg / f), 12) AS score FROM l JOIN f USING (term) JOIN s USING (cluster), a)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) - 1 AS INTEGER) AS rank FROM r) WHERE rank < 5"""


def medoid_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN15: the part name that says most of what a brand's other names say."""
    p = table(spark, sf_dir, "part")
    return learning.medoid(p.select(F.col("p_brand").alias("cluster"), F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")).alias("text")))


MEDOID = f"""
WITH m AS (SELECT DISTINCT p_brand AS cluster, p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) AS text FROM part), b AS (SELECT cluster, text, {sql_tokens("text")} AS t FROM m),
w AS (SELECT cluster, text, unnest(t) AS term FROM b), s AS (SELECT cluster, term FROM (SELECT DISTINCT cluster, text, term FROM w) GROUP BY ALL HAVING count(*) > 1),
h AS (SELECT w.cluster, w.text, count(*) AS shared FROM w JOIN s USING (cluster, term) GROUP BY ALL),
r AS (SELECT b.cluster, b.text, coalesce(CAST(shared AS DOUBLE), 0) / len(t) AS score FROM b LEFT JOIN h ON b.cluster = h.cluster AND b.text = h.text)
SELECT cluster, text AS label FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, text) AS r FROM r) WHERE r = 1"""

_SOUND = '{"v":1,"built_from_ts":5,"rev":%s,"intents":[{"id":"a","members":%s,"support":%s,"seeded_support":%s,"last_ts":%s,%s"tools":{"t":%s},"skills":{}}%s]}'
_CASES = (
    ("sound", _SOUND % (1, '["x"]', 2, 1, 0, "", 1.0, ""), ""),
    ("rev", _SOUND % (-1, '["x"]', 2, 1, 0, "", 1.0, ""), "rev-negative"),
    ("version", (_SOUND % (1, '["x"]', 2, 1, 0, "", 1.0, "")).replace('"v":1', '"v":9'), "unknown-version"),
    ("no members", (_SOUND % (1, '["x"]', 2, 1, 0, "", 1.0, "")).replace('"members":["x"],', ""), "missing-members"),
    ("empty members", _SOUND % (1, "[]", 2, 1, 0, "", 1.0, ""), "empty-members"),
    ("support", _SOUND % (1, '["x"]', 0, 0, 0, "", 1.0, ""), "support-zero"),
    ("weight", _SOUND % (1, '["x"]', 2, 1, 0, "", -1.0, ""), "negative-edge-weight"),
    ("centroid", _SOUND % (1, '["x"]', 2, 1, 0, '"centroid":[],', 1.0, ""), "empty-centroid"),
    ("twice", _SOUND % (1, '["x"]', 2, 1, 0, "", 1.0, ',{"id":"a","members":["y"],"support":1,"tools":{},"skills":{}}'), "duplicate-intent-id"),
    ("seeded", _SOUND % (1, '["x"]', 2, 3, 0, "", 1.0, ""), "seeded-support-exceeds-support"),
    ("text", "no graph", "malformed"),
)


def graph_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN17"""
    raw = spark.createDataFrame([(n, j) for n, j, _ in _CASES], "name string, json string")
    return learning.parse_graphs(raw).select("name", F.array_join("problems", ",").alias("problems"), F.coalesce(F.get("graph.intents.last_ts", F.lit(0)), F.lit(-1)).alias("last_ts"))


VALIDATE = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{p}', CAST({-1 if n == 'text' else 5} AS BIGINT))" for n, _, p in _CASES) + ") AS t(name, problems, last_ts)"


def _capabilities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Hits of tools (parts, by size) and skills (documents, by length), skills that declare tools."""
    q = spark.createDataFrame([("small",), ("large",)], "query_id string")
    t = inputs.tools(spark, sf_dir)
    scored = t.crossJoin(F.broadcast(q)).where(F.lower("p_type") == F.col("query_id")).select("query_id", "id", F.col("p_size").cast("double").alias("score"))
    from tidewright.operators.ranking import top

    tool_hits = top(scored, ["query_id"], 5)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").cast("double").alias("score"), F.array(F.concat(F.lit("brand_1__"), (F.col("doc_id") % 100).cast("string")), F.concat(F.lit("brand_2__"), (F.col("doc_id") % 100).cast("string")), F.lit("unknown__1")).alias("tools"))
    skill_hits = top(d.crossJoin(F.broadcast(q)).select("query_id", "id", "score"), ["query_id"], 30)
    return tool_hits, skill_hits, d, t


def capability_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP1, CP2: both buckets; tools that matched skills declare follow the hits at score 0."""
    tool_hits, skill_hits, skills, tools = _capabilities(spark, sf_dir)
    return capability.search_capabilities(tool_hits, skill_hits, skills, tools)


_TOOLS = "tools AS (SELECT lower(replace(p_brand, '#', '_')) || '__' || CAST(p_partkey AS VARCHAR) AS id, p_type, p_size FROM part)"
_BUCKETS = f"""
q AS (SELECT unnest(['small', 'large']) AS query_id), {_TOOLS},
th AS (SELECT * FROM (SELECT query_id, id, CAST(p_size AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY p_size DESC, id) - 1 AS rank FROM tools, q WHERE lower(p_type) = query_id) WHERE rank < 5)"""
CAPABILITIES = f"""WITH {_BUCKETS},
sh AS (SELECT * FROM (SELECT query_id, CAST(doc_id AS VARCHAR) AS id, doc_id % 100 AS n, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) - 1 AS rank FROM documents, q) WHERE rank < 30),
d AS (SELECT query_id, rank * 10 AS pos, 'brand_1__' || CAST(n AS VARCHAR) AS id FROM sh UNION ALL SELECT query_id, rank * 10 + 1, 'brand_2__' || CAST(n AS VARCHAR) FROM sh),
p AS (SELECT query_id, id, min(pos) AS pos FROM d WHERE id IN (SELECT id FROM tools) AND NOT EXISTS (SELECT 1 FROM th WHERE th.query_id = d.query_id AND th.id = d.id) GROUP BY ALL),
m AS (SELECT query_id, id, 0e0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 + (SELECT count(*) FROM th WHERE th.query_id = p.query_id) AS place FROM p)
SELECT query_id, 'tools' AS bucket, CAST(rank AS INTEGER) AS place, substring(id, 1, instr(id, '__') - 1) AS server, id, score FROM th
UNION ALL SELECT query_id, 'tools', CAST(place AS INTEGER), substring(id, 1, instr(id, '__') - 1), id, score FROM m
UNION ALL SELECT query_id, 'skills', CAST(rank AS INTEGER), NULL, id, score FROM sh"""


def capability_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP1: the tools bucket by server, in the order of first hits."""
    return capability.grouped_tools(_capabilities(spark, sf_dir)[0]).select("query_id", "server", F.col("server_rank").cast("int").alias("server_rank"), "id", "rank")


SERVERS = f"""WITH {_BUCKETS}, s AS (SELECT *, substring(id, 1, instr(id, '__') - 1) AS server FROM th), f AS (SELECT query_id, server, min(rank) AS first FROM s GROUP BY ALL),
o AS (SELECT query_id, server, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS INTEGER) AS server_rank FROM f)
SELECT s.query_id, s.server, server_rank, id, CAST(rank AS INTEGER) AS rank FROM s JOIN o ON s.query_id = o.query_id AND s.server = o.server"""


def skill_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP6"""
    d = table(spark, sf_dir, "documents")
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("request_id"), (F.col("doc_id") * 2).cast("string").alias("skill_id"))
    found = capability.skill_content(wanted, d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body")))
    return found.select("request_id", F.md5("body").alias("body"), "error")


CONTENT = "SELECT l.doc_id AS request_id, md5(d.text) AS body, CASE WHEN d.doc_id IS NULL THEN 'unknown skill: ' || CAST(l.doc_id * 2 AS VARCHAR) END AS error FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 2"


def invocation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP4: what each call of a tool comes to."""
    t = inputs.tools(spark, sf_dir)
    calls = t.select(F.col("p_partkey").alias("request_id"), F.when(F.col("p_partkey") % 5 == 0, "nothing").otherwise(F.col("id")).alias("tool_id"), F.when(F.col("p_partkey") % 3 == 0, "[1]").when(F.col("p_partkey") % 3 == 1, '{"a": 1}').alias("arguments"), F.lit('{"b": 2}').alias("flat"))
    return capability.invocations(calls, t.select("id", (F.col("p_partkey") % 7 == 0).alias("needs_auth")))


STATUS = """
WITH r AS (SELECT p_partkey AS request_id, CASE WHEN p_partkey % 5 = 0 THEN 'nothing' ELSE lower(replace(p_brand, '#', '_')) || '__' || CAST(p_partkey AS VARCHAR) END AS tool_id,
  CASE WHEN p_partkey % 3 = 0 THEN '[1]' WHEN p_partkey % 3 = 1 THEN '{"a": 1}' ELSE '{"b": 2}' END AS arguments FROM part)
SELECT *, CASE WHEN tool_id = 'nothing' THEN 'unknown_tool' WHEN arguments = '[1]' THEN 'bad_arguments' WHEN request_id % 7 = 0 THEN 'needs_auth' ELSE 'ok' END AS status FROM r"""


def invoke_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP5"""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'error')")
    calls = e.select(F.col("event_id").alias("call_id"), F.concat(F.lit("tool_"), (F.col("event_id") % 5).cast("string")).alias("tool_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.floor("value").cast("long").alias("took_ms"), (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 3 == 0).alias("is_error"))
    return capability.lifecycle(calls).withColumn("took_ms", F.coalesce("took_ms", F.lit(-1).cast("long")))


LIFECYCLE = """
WITH c AS (SELECT event_id AS call_id, 'tool_' || CAST(event_id % 5 AS VARCHAR) AS tool_id, epoch_us(ts) // 1000 AS ts, CAST(floor(value) AS BIGINT) AS took, event_type = 'error' OR event_id % 3 = 0 AS bad FROM events WHERE event_type IN ('click', 'error'))
SELECT call_id, tool_id, 'invoke_start' AS type, ts, CAST(-1 AS BIGINT) AS took_ms FROM c UNION ALL SELECT call_id, tool_id, CASE WHEN bad THEN 'invoke_error' ELSE 'invoke_end' END, ts + took, took FROM c"""


def last_user_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX11"""
    return grounding.last_user_text(table(spark, sf_dir, "conversations")).select("conv_id", "text")


LAST = "SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1 AND role = 'user'"


def grounding_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP8, CP11: pinned items, then the three best retrieved that aren't pinned."""
    b = table(spark, sf_dir, "benchmark")
    facts = b.select(F.col("item_id").alias("id"), (F.lit(1000) - F.col("item_id")).alias("seq"), F.when(F.col("item_id") % 9 == 0, "always").otherwise("retrieved").alias("pin"))
    q = inputs.asked(spark)
    pins = facts.where("pin = 'always'").count()
    hits = bm25.search(bm25.kept(b.select(F.col("item_id").alias("id"), "text")), q, 3 + pins)
    return grounding.candidates(facts, hits, 3, q).select("query_id", "fact_id", F.col("place").cast("int").alias("place"), "pinned")


CANDIDATES = f"""
WITH a AS ({sql_bm25("SELECT item_id AS id, text FROM benchmark", None)}), pins AS (SELECT item_id, row_number() OVER (ORDER BY 1000 - item_id) - 1 AS place FROM benchmark WHERE item_id % 9 = 0),
h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS r FROM a WHERE rank < 3 + (SELECT count(*) FROM pins) AND id % 9 <> 0)
SELECT query_id, item_id AS fact_id, CAST(place AS INTEGER) AS place, true AS pinned FROM pins, {_ASKED} UNION ALL SELECT query_id, id, CAST(r + (SELECT count(*) FROM pins) AS INTEGER), false FROM h WHERE r < 3"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation facts of every kind: a body of its own text, benchmark items, an empty one; some shown before, some changed since."""
    c = table(spark, sf_dir, "conversations")
    first = c.where("turn = 0").select("conv_id", F.col("text").alias("head"))
    kinds = ((1, "''", "'x'"), (2, "head", "null"), (3, "concat('no ', head)", "null"), (4, "concat('no ', head)", "concat('no ', head)"), (5, "concat('no ', head)", "'other'"), (6, "concat('no ', head)", "head"), (7, "substring(head, 2)", "head"), (8, "head", "'gone'"), (9, "head", "head"))
    parts = [first.select("conv_id", F.lit(i).alias("fact_id"), F.expr(b).alias("body"), F.expr(l).cast("string").alias("last_injected")) for i, b, l in kinds]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def freshness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP9, CP10"""
    return grounding.freshness(_facts(spark, sf_dir), table(spark, sf_dir, "conversations"))


FRESHNESS = """
WITH first AS (SELECT conv_id, text AS head FROM conversations WHERE turn = 0),
f AS (SELECT conv_id, k AS fact_id, CASE k WHEN 1 THEN '' WHEN 2 THEN head WHEN 7 THEN substring(head, 2) WHEN 8 THEN head WHEN 9 THEN head ELSE 'no ' || head END AS body,
  CASE k WHEN 1 THEN 'x' WHEN 4 THEN 'no ' || head WHEN 5 THEN 'other' WHEN 6 THEN head WHEN 7 THEN head WHEN 8 THEN 'gone' WHEN 9 THEN head END AS last FROM first, (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS k)),
s AS (SELECT f.*, (SELECT coalesce(bool_or(contains(c.text, f.body)), false) FROM conversations c WHERE c.conv_id = f.conv_id) AS b, (SELECT coalesce(bool_or(contains(c.text, f.last)), false) FROM conversations c WHERE c.conv_id = f.conv_id) AS l FROM f),
r AS (SELECT conv_id, fact_id, CASE WHEN body = '' THEN 'fresh' WHEN last IS NOT NULL AND last <> body AND l THEN 'mutated' WHEN b THEN 'fresh' WHEN last IS NULL THEN 'never' WHEN last = body THEN 'evicted' ELSE 'mutated' END AS reason FROM s)
SELECT conv_id, fact_id, reason, reason <> 'fresh' AS inject FROM r"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase', 'error')")
    kind = F.when(F.col("event_type") == "click", "invoke_start").when(F.col("event_type") == "purchase", "invoke_end").otherwise("invoke_error")
    given = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("given-"), F.col("event_id").cast("string")))
    return e.select(F.col("user_id").cast("string").alias("source_id"), F.concat(F.lit("tool_"), (F.col("event_id") % 3).cast("string")).alias("tool_id"), kind.alias("type"), given.alias("invocation_id"), F.col("event_id").alias("log_seq"))


def invocation_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR2: starts of a tool wait in a queue for their ends."""
    return tracelog.correlate(_calls(spark, sf_dir)).select("log_seq", "invocation")


CORRELATION = """
WITH e AS (SELECT user_id AS s, event_id % 3 AS t, event_id AS log_seq, event_type = 'click' AS starts, event_id % 10 = 0 AS given FROM events WHERE event_type IN ('click', 'purchase', 'error')),
b AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE -1 END) OVER (PARTITION BY s, t ORDER BY log_seq ROWS UNBOUNDED PRECEDING) AS balance FROM e WHERE NOT given),
l AS (SELECT *, NOT starts AND balance < least(0, coalesce(min(balance) OVER (PARTITION BY s, t ORDER BY log_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lone FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY s, t, starts ORDER BY log_seq) AS n FROM l WHERE NOT lone)
SELECT log_seq, CAST(log_seq AS VARCHAR) AS invocation FROM l WHERE starts OR lone
UNION ALL SELECT x.log_seq, CAST(y.log_seq AS VARCHAR) FROM n x JOIN n y ON x.s = y.s AND x.t = y.t AND x.n = y.n AND y.starts WHERE NOT x.starts
UNION ALL SELECT log_seq, 'given-' || CAST(log_seq AS VARCHAR) FROM e WHERE given"""


def loss_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR3, TR4: queues of 8 that are drained after every 10 arrivals."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("subscriber"), F.col("event_id").alias("log_seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    return tracelog.loss_windows(e, 8, 10)


LOSS = """
WITH p AS (SELECT event_type AS subscriber, event_id, epoch_us(ts) // 1000 AS ts, floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 10e0) AS b FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY subscriber, b ORDER BY event_id DESC) AS back FROM p)
SELECT subscriber, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r WHERE back > 8 GROUP BY subscriber"""


def trace_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR1, TR6, TR7, TR8: events in envelopes as JSON lines, parsed again, within bounds."""
    e = inputs.trace(spark, sf_dir)
    wrapped = tracelog.envelope(e.select("type", F.repeat("query", 600).alias("query"), "origin", "log_seq"), F.lit("s"), F.lit("src"), F.col("log_seq") + 1_700_000_000_000, ["log_seq"])
    lines = wrapped.select("log_seq", F.to_json(F.struct(*(c for c in wrapped.columns if c != "log_seq"))).alias("value"))
    return tracelog.bounded(tracelog.parse(lines)).select("log_seq", "v", "ts", F.length("event_id").alias("id_length"), "type", F.octet_length("query").alias("query_bytes"))


TRACES = """SELECT event_id AS log_seq, 2 AS v, event_id + 1700000000000 AS ts, 26 AS id_length, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'invoke_start' WHEN 'purchase' THEN 'skill_invoke' ELSE event_type END AS type,
CAST(least(4096, 600 * length('topic ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR))) AS INTEGER) AS query_bytes FROM events"""

_SPLIT = (("control", 50), ("first", 30), ("second", 20))


def experiment_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX1, EX2"""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("unit"))
    asked = F.when(F.col("c_custkey") % 50 == 0, "second")
    return c.select("c_custkey", experiments.assign(F.lit("exp-1"), F.col("unit"), _SPLIT, asked).alias("arm"), experiments.unit_hash(F.col("unit")).alias("unit_hash"))


ASSIGNMENT = """
WITH h AS (SELECT c_custkey, sha256('["exp-1","' || CAST(c_custkey AS VARCHAR) || '"]') AS x FROM customer),
d AS (SELECT c_custkey, list_reduce(list_transform(string_split(x, ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, b: (a * 16 + b) % 100) AS n FROM h)
SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'second' WHEN n < 50 THEN 'control' WHEN n < 80 THEN 'first' ELSE 'second' END AS arm, substring(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) AS unit_hash FROM d"""


def ranking_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX3, EX4: the BM25 ranking of each query against that without documents of one source."""
    i = bm25.kept(inputs.documents(spark, sf_dir))
    j = bm25.kept(table(spark, sf_dir, "documents").where("source <> 'src0'").select(F.col("doc_id").alias("id"), "text"))
    ids = lambda x, n: bm25.search(x, inputs.asked(spark), 20).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias(n))
    none = F.array().cast("array<bigint>")
    both = inputs.asked(spark).join(ids(i, "a"), "query_id", "left").join(ids(j, "b"), "query_id", "left").select("query_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    k = experiments.agreement_k(F.when(F.col("query_id") == "q1", 5), F.lit(None).cast("int"))
    found = experiments.agreement(F.col("a"), F.col("b"), k)
    return both.select("query_id", *(c.alias(n) for n, c in found.items()), experiments.outcome(F.lit(None), F.lit(False), F.size("b")).alias("outcome")).withColumn("jaccard", F.round("jaccard", 9)).withColumn("overlap", F.col("overlap").cast("long"))


AGREEMENT = f"""
WITH a AS ({sql_bm25("SELECT doc_id AS id, text FROM documents", 20)}), b AS ({sql_bm25("SELECT doc_id AS id, text FROM documents WHERE source <> 'src0'", 20)}),
l AS (SELECT query_id, coalesce((SELECT list(id ORDER BY rank) FROM a WHERE a.query_id = asked.query_id), []) AS a, coalesce((SELECT list(id ORDER BY rank) FROM b WHERE b.query_id = asked.query_id), []) AS b, CASE WHEN query_id = 'q1' THEN 5 ELSE 10 END AS k FROM {_ASKED}),
h AS (SELECT *, list_intersect(a[1:k], b[1:k]) AS i, list_distinct(list_concat(a[1:k], b[1:k])) AS u FROM l)
SELECT query_id, a[1] IS NOT DISTINCT FROM b[1] AS top1, a = b AS exact_order, CAST(len(list_intersect(a, b)) AS BIGINT) AS overlap, CASE WHEN len(u) = 0 THEN 1e0 ELSE round(CAST(len(i) AS DOUBLE) / len(u), 9) END AS jaccard, CASE WHEN len(b) = 0 THEN 'empty' ELSE 'ok' END AS outcome FROM h"""


def _attribution(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = inputs.trace(spark, sf_dir)
    ids = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("tool_"), ((F.col("log_seq") + i * 3) % 17).cast("string")))
    s = e.where("type = 'search'").select(F.col("session").alias("unit"), F.col("log_seq").alias("selection_id"), F.col("ts").alias("at_ms"), ids.alias("ids"))
    return s, e.where("type = 'invoke_start'").select(F.col("session").alias("unit"), F.col("log_seq").alias("invocation_id"), F.col("ts").alias("at_ms"), F.col("capability_id").alias("tool_id"))


def invocation_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX6: every one of the last three selections of at most two days before."""
    return experiments.attribute(*_attribution(spark, sf_dir), last=3, max_age_ms=2 * 86_400_000, every=True)


ATTRIBUTION = f"""WITH {_TRACE},
s AS (SELECT session, log_seq AS selection_id, ts, list_transform(range(0, 5), lambda i: 'tool_' || CAST((log_seq + i * 3) % 17 AS VARCHAR)) AS ids FROM trace WHERE type = 'search'),
i AS (SELECT session, log_seq AS invocation_id, ts, capability_id FROM trace WHERE type = 'invoke_start'),
j AS (SELECT invocation_id, selection_id, i.ts - s.ts AS age, ids, capability_id, row_number() OVER (PARTITION BY invocation_id ORDER BY s.ts DESC, selection_id DESC) AS r FROM i JOIN s ON i.session = s.session AND s.ts <= i.ts)
SELECT invocation_id, selection_id, CAST(coalesce(list_position(ids, capability_id), 0) - 1 AS INTEGER) AS rank FROM j WHERE r <= 3 AND age <= 172800000"""


def shadow_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX5: shadows that run for ten minutes, one at a time for each of three experiments."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select((F.col("event_id") % 3).alias("experiment_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms"))
    return experiments.admit_shadows(e.withColumn("end_ms", F.col("start_ms") + 600_000))


ADMISSION = """
WITH RECURSIVE c AS (SELECT event_id % 3 AS experiment_id, event_id AS seq, epoch_us(ts) // 1000 AS start_ms, row_number() OVER (PARTITION BY event_id % 3 ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events WHERE event_type = 'view'),
w AS (SELECT experiment_id, n, start_ms + 600000 AS ends FROM c WHERE n = 1
  UNION ALL SELECT w.experiment_id, x.n, x.start_ms + 600000 FROM w, LATERAL (SELECT c.n, c.start_ms FROM c WHERE c.experiment_id = w.experiment_id AND c.n > w.n AND c.start_ms >= w.ends ORDER BY c.n LIMIT 1) x)
SELECT c.experiment_id, c.seq, w.n IS NOT NULL AS admitted FROM c LEFT JOIN w ON w.experiment_id = c.experiment_id AND w.n = c.n"""


def delayed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX8"""
    lab = table(spark, sf_dir, "labels")
    o = lab.select(F.col("doc_id").alias("selection_id"), F.when(F.col("doc_id") % 4 == 0, " ").otherwise("good").alias("label"), F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).when(F.col("doc_id") % 5 == 1, F.col("quality").cast("double")).alias("score"))
    return experiments.delayed_outcomes(o, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("selection_id")))


DELAYED = "SELECT doc_id AS selection_id, 'good' AS label, CASE WHEN doc_id % 5 = 1 THEN CAST(quality AS DOUBLE) END AS score FROM labels WHERE doc_id IN (SELECT vec_id FROM embeddings) AND doc_id % 4 <> 0 AND doc_id % 5 <> 0"


def stream_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR5, TR11, LN3: the trace as a stream of files; equals session_pairing."""
    from tidewright.streaming import traces

    root = f"{shared_dir(spark)}/stream-{abs(hash((sf_dir, tracelog.ulid())))}"
    rows = inputs.trace(spark, sf_dir).withColumn("role", learning.classify(F.col("type"), F.col("origin"), "agent")).drop("type", "origin")
    bounds = rows.agg(F.min("log_seq"), F.max("log_seq") + 1).first()
    width = -(-(bounds[1] - bounds[0]) // 4)
    for i in range(4):  # files in the order of the log, by their times
        rows.where((F.col("log_seq") >= bounds[0] + i * width) & (F.col("log_seq") < bounds[0] + (i + 1) * width)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    running = traces.paired(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.col("session").cast("long").alias("session"), "log_seq", "kind", "capability_id", "search_seq", "query")


PLANS = {
    "session_pairing": (session_pairing, PAIRING),
    "first_confirmation": (first_confirmation, FIRST),
    "distinct_queries": (distinct_queries, DISTINCT),
    "graph_fold": (graph_fold, None),
    "edge_ranking": (edge_ranking, EDGES),
    "arm_weight": (arm_weight, ARM),
    "lexical_match": (lexical_match, LEXICAL),
    "centroid_rebuild": (centroid_rebuild, CENTROID),
    "dense_match": (dense_match, DENSE),
    "usage_outcomes": (usage_outcomes, OUTCOMES),
    "usage_boosted_search": (usage_boosted_search, BOOSTED),
    "ctfidf_terms": (ctfidf_terms, CTFIDF),
    "medoid_label": (medoid_label, MEDOID),
    "graph_validate": (graph_validate, VALIDATE),
    "capability_search": (capability_search, CAPABILITIES),
    "capability_servers": (capability_servers, SERVERS),
    "skill_content": (skill_content, CONTENT),
    "invocation_status": (invocation_status, STATUS),
    "invoke_lifecycle": (invoke_lifecycle, LIFECYCLE),
    "last_user_text": (last_user_text, LAST),
    "grounding_candidates": (grounding_candidates, CANDIDATES),
    "freshness_gate": (freshness_gate, FRESHNESS),
    "invocation_correlation": (invocation_correlation, CORRELATION),
    "loss_windows": (loss_windows, LOSS),
    "trace_round_trip": (trace_round_trip, TRACES),
    "experiment_assignment": (experiment_assignment, ASSIGNMENT),
    "ranking_agreement": (ranking_agreement, AGREEMENT),
    "invocation_attribution": (invocation_attribution, ATTRIBUTION),
    "shadow_admission": (shadow_admission, ADMISSION),
    "delayed_outcomes": (delayed_outcomes, DELAYED),
    "stream_pairing": (stream_pairing, PAIRING),
}
