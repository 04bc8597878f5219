"""Queries over what surrounds search: live credit, graphs as JSON, tiers of the usage arm, models, recall, grounding, experiments, published events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.stemmer import english_tokens
from tidewright.operators import bm25, capability, catalog, dense, experiments, grounding, learning, search, usage
from tidewright.plans import inputs
from tidewright.plans.inputs import table
from tidewright.plans.retrieval import _ASKED, sql_bm25
from tidewright.plans.usage import _BUCKETS, _GRAPH, _PAIRS, _TRACE, _capabilities, _graph
from tidewright.sources import embedders, sanitise, tracelog
from tidewright.workers import settled, shared_dir


def live_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN5: confirmations when four graphs are each shared by a quarter of the sessions."""
    rows = inputs.trace(spark, sf_dir).withColumn("role", learning.classify(F.col("type"), F.col("origin"))).withColumn("graph_id", F.col("session") % 4)
    return learning.live_confirmations(rows).where("first_confirmation").select("session", "search_seq", "log_seq")


LIVE = f"""WITH {_TRACE},
slot AS (SELECT p.*, (SELECT max(s.log_seq) FROM trace s WHERE s.type = 'search' AND s.session % 4 = p.session % 4 AND s.log_seq < p.log_seq) AS armed FROM paired p),
mine AS (SELECT slot.* FROM slot JOIN trace a ON a.log_seq = slot.armed AND a.query = slot.query)
SELECT session, search_seq, log_seq FROM (SELECT *, row_number() OVER (PARTITION BY armed ORDER BY log_seq) AS r FROM mine) WHERE r = 1"""


def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN18: the graph of the events, written with the labels and terms that follow from it."""
    members, edges, intents = _graph(spark, sf_dir)
    weights = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("capability_id", "weight")))))
    tools = edges.groupBy("intent_id").agg(weights("tool").alias("tools"), weights("skill").alias("skills"))
    listed = members.groupBy("intent_id").agg(F.array_sort(F.collect_list("text")).alias("members"))
    whole = intents.join(tools, "intent_id").join(listed, "intent_id").select(F.lit("g").alias("graph_id"), "intent_id", "members", F.lit(None).cast("array<double>").alias("centroid"), F.greatest("support", F.lit(1)).alias("support"), F.lit(0).cast("long").alias("seeded_support"), "last_ts", "tools", "skills", F.lit(7).cast("long").alias("rev"), F.lit(9).cast("long").alias("built_from_ts"), F.lit("m").alias("model"))
    made = learning.serialise(whole)
    return made.select("graph_id", F.size(F.from_json("json", learning.GRAPH)["intents"]).alias("n_intents"), F.length("json").alias("n_chars"), F.sha2("json", 256).alias("digest"))


GRAPH_JSON = f"""WITH {_GRAPH},
side AS (SELECT intent_id, kind, string_agg('"' || capability_id || '":' || CAST(weight AS VARCHAR), ',' ORDER BY capability_id) AS w FROM edges GROUP BY ALL),
n AS (SELECT intent_id, CAST(regexp_extract(intent_id, '([0-9]+)$', 1) AS INTEGER) AS n, replace(intent_id, '_', ' ') AS text, greatest(support, 1) AS support, last_ts FROM intents),
t AS (SELECT intent_id, x AS term, (0.5e0 * ln(1e0 + 2e0 / CASE WHEN x = 'topic' THEN (SELECT count(*) FROM intents) ELSE 1 END)) AS s FROM n, (SELECT unnest([0, 1]) AS i), LATERAL (SELECT CASE i WHEN 0 THEN 'topic' ELSE CAST(n AS VARCHAR) END AS x)),
terms AS (SELECT intent_id, string_agg('"' || term || '"', ',' ORDER BY round(s, 9) DESC, term) AS terms FROM t GROUP BY intent_id),
j AS (SELECT n, '{{"id":"' || intent_id || '","label":"' || text || '","terms":[' || terms || '],"members":["' || text || '"],"support":' || support || ',"last_ts":' || last_ts || ',"tools":{{' || coalesce((SELECT w FROM side s WHERE s.intent_id = n.intent_id AND kind = 'tool'), '') || '}},"skills":{{' || coalesce((SELECT w FROM side s WHERE s.intent_id = n.intent_id AND kind = 'skill'), '') || '}}}}' AS o FROM n JOIN terms USING (intent_id)),
whole AS (SELECT CAST(count(*) AS INTEGER) AS k, '{{"v":1,"built_from_ts":9,"rev":7,"model":"m","intents":[' || string_agg(o, ',' ORDER BY n) || ']}}' AS doc FROM j)
SELECT 'g' AS graph_id, k AS n_intents, CAST(length(doc) AS INTEGER) AS n_chars, sha256(doc) AS digest FROM whole"""


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pairs of vectors as intents; every third has no centroid and a member of its own words; even pairs have a known tool, the others an unknown one."""
    v = inputs.vectors(spark, sf_dir)
    pair = F.floor(F.col("id") / 2).cast("long")
    centroids = dense.rebuild_centroids(v.select(pair.alias("cluster"), "id"), v.select("id", "vec")).select(F.col("cluster").alias("intent_id"), F.when(F.col("cluster") % 3 > 0, F.col("centroid")).alias("centroid"))
    centroids = settled(centroids, "centroids")  # all of intents, members and edges are made of them
    intents = centroids.select("intent_id", (F.col("intent_id") % 5).alias("support"), F.lit(0).cast("long").alias("last_ts"), "centroid")
    members = intents.select("intent_id", F.concat(F.lit("alpha"), F.col("intent_id").cast("string"), F.lit(" beta"), F.col("intent_id").cast("string")).alias("text"))
    edges = intents.select("intent_id", F.lit("tool").alias("kind"), F.when(F.col("intent_id") % 2 == 0, "known").otherwise("gone").alias("capability_id"), F.lit(1.0).alias("weight"))
    asked = v.select(F.col("id").alias("query_id"), F.concat(F.lit("alpha"), pair.cast("string"), F.when(F.col("id") % 4 > 0, F.concat(F.lit(" beta"), pair.cast("string"))).otherwise(" other")).alias("text"), F.when(F.col("id") % 5 > 0, F.col("vec")).alias("qvec"))
    return asked, intents, members, edges, spark.createDataFrame([("tool", "known")], "kind string, id string")


def usage_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """US4, US8, TR10: what every vector is served with when some clusters have centroids: dense first, then words against the clusters that have none; queries without a vector by words against all. One usage_boost event each."""
    asked, intents, members, edges, known = _tiers(spark, sf_dir)
    served = usage.serve_match(asked, intents, members, edges, known)
    weights = intents.select("intent_id", usage.arm_weight(F.col("support"), F.lit(0), F.col("last_ts")).alias("weight"))
    return search.usage_boost(served, asked, weights).withColumn("weight", F.round("weight", 9)).withColumn("intent_id", F.col("intent_id").cast("string"))


TIERS = f"""WITH {_PAIRS},
dots AS (SELECT vec_id, c.label AS intent_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), c) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_inner_product(c, c)), 9) AS s FROM embeddings, c WHERE vec_id % 5 > 0 AND c.label % 3 > 0),
near AS (SELECT vec_id, intent_id FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, intent_id) AS r FROM dots WHERE s >= 0.7e0) WHERE r = 1),
q AS (SELECT vec_id, vec_id // 2 AS pair, vec_id % 5 > 0 AS has_vec, CASE WHEN vec_id % 4 > 0 THEN 1 ELSE 0 END AS full_text FROM embeddings),
words AS (SELECT vec_id, CASE WHEN full_text = 1 AND (NOT has_vec OR pair % 3 = 0) THEN pair END AS lex, has_vec FROM q),
pick AS (SELECT w.vec_id, has_vec, n.intent_id AS den, lex FROM words w LEFT JOIN near n ON n.vec_id = w.vec_id),
rated AS (SELECT *, CASE WHEN den IS NULL THEN 2 WHEN den % 2 = 0 THEN 0 ELSE 1 END AS d, CASE WHEN lex IS NULL THEN 2 WHEN lex % 2 = 0 THEN 0 ELSE 1 END AS l FROM pick),
picked AS (SELECT vec_id, CASE WHEN has_vec AND (d = 0 OR d <= l) THEN 'dense' ELSE 'lexical' END AS tier, CASE WHEN has_vec AND (d = 0 OR d <= l) THEN den ELSE lex END AS intent_id FROM rated)
SELECT vec_id AS query_id, 'usage_boost' AS type, CAST(intent_id AS VARCHAR) AS intent_id, CASE WHEN intent_id IS NULL THEN 'no_match' WHEN intent_id % 2 = 0 THEN 'armed' ELSE 'all_filtered' END AS outcome, tier,
  CAST(CASE WHEN intent_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS kept, CAST(CASE WHEN intent_id % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS dropped, round(CASE WHEN intent_id % 2 = 0 THEN 0.5e0 * least(1e0, (intent_id % 5) / 3e0) ELSE 0e0 END, 9) AS weight FROM picked"""


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = inputs.vectors(spark, sf_dir)
    return v.select("id", F.when(F.col("id") % 7 == 0, F.slice("vec", 1, 8)).otherwise(F.col("vec")).alias("vec"), F.when(F.col("id") % 5 == 0, "old").when(F.col("id") % 11 == 0, F.lit(None)).otherwise("new").alias("model"))


def model_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM7: vectors of another model or width than the active one."""
    return dense.model_events(_models(spark, sf_dir), "new", 64)


MISMATCH = """SELECT * FROM (SELECT vec_id AS id, 'embedder_model_mismatch' AS type, CASE WHEN vec_id % 5 = 0 THEN 'old' WHEN vec_id % 11 = 0 THEN NULL ELSE 'new' END AS stored_model, CAST(CASE WHEN vec_id % 7 = 0 THEN 8 ELSE 64 END AS INTEGER) AS stored_dim FROM embeddings) WHERE stored_model IS DISTINCT FROM 'new' OR stored_dim <> 64"""


def adaptive_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """US9, US10: whether a graph's centroids can be used with the active model, and so the state of the arm."""
    m = _models(spark, sf_dir).select("id", usage.model_status_of(F.col("model"), F.size("vec"), F.when(F.col("id") % 13 > 0, "new"), F.lit(64)).alias("status"))
    return m.select("id", "status", usage.adaptive_status_of(F.col("id") % 3 > 0, F.when(F.col("id") % 17 > 0, F.col("status"))).alias("state"))


ADAPTIVE = """WITH m AS (SELECT vec_id AS id, CASE WHEN vec_id % 13 = 0 OR (vec_id % 5 <> 0 AND vec_id % 11 = 0) THEN 'ok' WHEN vec_id % 7 = 0 THEN 'dim_mismatch' WHEN vec_id % 5 = 0 THEN 'model_mismatch' ELSE 'ok' END AS status FROM embeddings)
SELECT *, CASE WHEN id % 3 = 0 THEN 'inactive' WHEN id % 17 = 0 THEN 'unknown' WHEN status = 'ok' THEN 'active' ELSE 'paused' END AS state FROM m"""


def dense_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM5, CM8: vectors rebuilt twice under one folder; what is stored is the second version, whole, and then what one that fails has left."""
    root = f"{shared_dir(spark)}/tidewright-vectors-{tracelog.ulid()}"
    v = inputs.vectors(spark, sf_dir)
    corpus = v.select("id", F.col("label").cast("string").alias("text"))
    dense.rebuild(corpus, root, lambda c: c.join(v.select("id", "vec"), "id"), "first")
    dense.rebuild(corpus, root, lambda c: c.join(v.select("id", F.slice("vec", 1, 8).alias("vec")), "id"), "second")
    try:
        dense.rebuild(corpus, root, lambda c: c.join(v.where("id % 2 = 0").select("id", "vec"), "id"), "third")
    except dense.EmbeddingsNotBuilt:
        pass
    return dense.stored(spark, root).groupBy("model", F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


REBUILD = "SELECT 'second' AS model, CAST(8 AS INTEGER) AS dim, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings"


def capability_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP3, CP15: recall of two queries that find something and one that doesn't, as message pairs before the last turn of every conversation, inserted twice."""
    tool_hits, skill_hits, skills, tools = _capabilities(spark, sf_dir)
    q = spark.createDataFrame([("small", "a small thing"), ("large", "a large thing"), ("none", "nothing")], "query_id string, text string")
    found = capability.search_capabilities(tool_hits, skill_hits, skills, tools)
    pairs = capability.recall_messages(found, q)
    c = table(spark, sf_dir, "conversations")
    messages = c.select("conv_id", F.col("turn").cast("int").alias("turn"), "role", F.lit(None).cast("string").alias("call_id"), F.col("text").alias("content"))
    last = c.groupBy("conv_id").agg(F.max("turn").cast("int").alias("turn"))
    mine = last.select("conv_id", F.element_at(F.array(F.lit("small"), F.lit("large"), F.lit("none")), (F.col("conv_id") % 3 + 1).cast("int")).alias("query_id")).join(pairs, "query_id").drop("query_id")
    once = capability.insert_recall(messages, mine, last)
    twice = capability.insert_recall(once, mine, last)
    return twice.select("conv_id", "turn", "role", F.col("call_id").isNotNull().alias("recalled"), F.when(F.col("call_id").isNull(), F.md5("content")).alias("content"))


RECALL = """
WITH m AS (SELECT conv_id, turn, role, md5(text) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations)
SELECT conv_id, CAST(n + CASE WHEN n = size - 1 AND conv_id % 3 < 2 THEN 2 ELSE 0 END AS INTEGER) AS turn, role, false AS recalled, content FROM m
UNION ALL SELECT conv_id, CAST(size - 1 + k AS INTEGER), CASE k WHEN 0 THEN 'assistant' ELSE 'tool' END, true, NULL FROM (SELECT DISTINCT conv_id, size FROM m), (SELECT unnest([0, 1]) AS k) WHERE conv_id % 3 < 2"""


def recall_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP3: how much each query recalls; null where both buckets are empty."""
    tool_hits, skill_hits, skills, tools = _capabilities(spark, sf_dir)
    q = spark.createDataFrame([("small",), ("large",), ("none",)], "query_id string")
    return capability.recall(capability.search_capabilities(tool_hits, skill_hits.where("rank < 3"), skills, tools), q).withColumn("n", F.coalesce(F.col("n").cast("string"), F.lit("null")))


RECALL_COUNTS = f"""WITH {_BUCKETS},
sh AS (SELECT * FROM (SELECT query_id, doc_id % 100 AS n, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) - 1 AS rank FROM documents, q) WHERE rank < 3),
d AS (SELECT query_id, 'brand_1__' || CAST(n AS VARCHAR) AS id FROM sh UNION SELECT query_id, 'brand_2__' || CAST(n AS VARCHAR) FROM sh),
a AS (SELECT query_id, id, 0 AS b FROM th UNION SELECT query_id, id, 0 FROM d WHERE id IN (SELECT id FROM tools) UNION ALL SELECT query_id, CAST(rank AS VARCHAR), 1 FROM sh)
SELECT query_id, CAST(count(*) AS VARCHAR) AS n FROM a GROUP BY query_id UNION ALL SELECT 'none', 'null'"""


def tools_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP7: all tools of a type, by server, without the bound of fifty."""
    from tidewright.operators.ranking import top

    t = inputs.tools(spark, sf_dir)
    hits = top(t.select(F.lower("p_type").alias("query_id"), "id", F.col("p_size").cast("double").alias("score")), ["query_id"], 100_000)
    return capability.search_tools(hits, 70).select("query_id", "server", F.col("server_rank").cast("int").alias("server_rank"), "id", "rank")


TOOLS_ONLY = """WITH t AS (SELECT lower(p_type) AS query_id, lower(replace(p_brand, '#', '_')) || '__' || CAST(p_partkey AS VARCHAR) AS id, p_size FROM part),
h AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p_size DESC, id) - 1 AS INTEGER) AS rank, substring(id, 1, instr(id, '__') - 1) AS server FROM t),
k AS (SELECT * FROM h WHERE rank < 70), f AS (SELECT query_id, server, min(rank) AS first FROM k GROUP BY ALL),
o AS (SELECT query_id, server, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS INTEGER) AS server_rank FROM f)
SELECT query_id, server, server_rank, id, rank FROM k JOIN o USING (query_id, server)"""


def first_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP12, CP14: entries that three adapters register, some under reserved names; the first of each id stays."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 50 == 0, F.element_at(F.array(*map(F.lit, capability.MODEL_TOOLS)), (F.col("p_partkey") % 3 + 1).cast("int"))).otherwise(F.concat(F.lit("t"), (F.floor(F.col("p_partkey") / 3)).cast("string")))
    return capability.ingest_first_wins(p.select(name.alias("id"), (F.lit(10_000_000) - F.col("p_partkey")).alias("seq"), "p_name"))


FIRST_WINS = """WITH e AS (SELECT 't' || CAST(p_partkey // 3 AS VARCHAR) AS id, 10000000 - p_partkey AS seq, p_name FROM part WHERE p_partkey % 50 <> 0)
SELECT id, seq, p_name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM e) WHERE r = 1"""


def ground_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP10: two turns of grounding in every conversation, on its first half and on all of it: what a turn has shown, the next one remembers, by conversation."""
    c = table(spark, sf_dir, "conversations")
    half = c.where("turn < 2")
    b = table(spark, sf_dir, "benchmark").where("item_id < 3").select((F.col("item_id") + 1).alias("fact_id"), "text")
    head = c.where("turn = 2").select("conv_id", F.lit(0).cast("long").alias("fact_id"), F.col("text").alias("body"))
    facts = c.select("conv_id").distinct().crossJoin(F.broadcast(b)).select("conv_id", "fact_id", F.col("text").alias("body")).unionByName(head)
    none = facts.limit(0)
    first, shown = grounding.ground(facts, half, none)
    changed = facts.withColumn("body", F.when(F.col("fact_id") == 2, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    second, _ = grounding.ground(changed, c, shown)
    return first.withColumn("turn", F.lit(1)).unionByName(second.withColumn("turn", F.lit(2)))


GROUND = """
WITH f AS (SELECT conv_id, item_id + 1 AS fact_id, text AS body FROM (SELECT DISTINCT conv_id FROM conversations), benchmark WHERE item_id < 3 UNION ALL SELECT conv_id, 0, text FROM conversations WHERE turn = 2),
p AS (SELECT f.*, (SELECT coalesce(bool_or(contains(c.text, f.body)), false) FROM conversations c WHERE c.conv_id = f.conv_id AND c.turn < 2) AS a, CASE WHEN fact_id = 2 THEN body || '!' ELSE body END AS body2 FROM f),
s AS (SELECT p.*, CASE WHEN body = '' OR a THEN NULL ELSE body END AS last FROM p),
w AS (SELECT s.*, (SELECT coalesce(bool_or(contains(c.text, s.body2)), false) FROM conversations c WHERE c.conv_id = s.conv_id) AS b, (SELECT coalesce(bool_or(contains(c.text, s.last)), false) FROM conversations c WHERE c.conv_id = s.conv_id) AS l FROM s),
r AS (SELECT conv_id, fact_id, 1 AS turn, CASE WHEN body = '' OR a THEN 'fresh' ELSE 'never' END AS reason FROM w
  UNION ALL SELECT conv_id, fact_id, 2, CASE WHEN body2 = '' THEN 'fresh' WHEN last IS NOT NULL AND last <> body2 AND l THEN 'mutated' WHEN b THEN 'fresh' WHEN last IS NULL THEN 'never' WHEN last = body2 THEN 'evicted' ELSE 'mutated' END FROM w)
SELECT conv_id, fact_id, turn, reason, CASE WHEN reason = 'fresh' THEN 'fact_inject_skip' ELSE 'fact_inject' END AS type FROM r"""


def ground_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP11: pinned and retrieved facts of each query as events, without state."""
    b = table(spark, sf_dir, "benchmark")
    facts = b.select(F.col("item_id").alias("id"), F.col("item_id").alias("seq"), F.when(F.col("item_id") % 16 == 0, "always").otherwise("retrieved").alias("pin"))
    q = inputs.asked(spark)
    hits = bm25.search(bm25.kept(b.select(F.col("item_id").alias("id"), "text")), q, 3 + facts.where("pin = 'always'").count())
    return grounding.snapshot_events(grounding.candidates(facts, hits, 3, q)).withColumn("place", F.col("place").cast("int"))


GROUND_SNAPSHOT = f"""
WITH a AS ({sql_bm25("SELECT item_id AS id, text FROM benchmark", None)}), n AS (SELECT count(*) AS n FROM benchmark WHERE item_id % 16 = 0),
h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS r FROM a, n WHERE rank < 3 + n AND id % 16 <> 0)
SELECT query_id, item_id AS fact_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY item_id) - 1 AS INTEGER) AS place, 'fact_snapshot' AS type, 'always' AS tier FROM benchmark, {_ASKED} WHERE item_id % 16 = 0
UNION ALL SELECT query_id, id, CAST(r + n AS INTEGER), 'fact_snapshot', 'retrieved' FROM h, n WHERE r < 3"""


def experiment_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX7: customers as selections; arms that fail to select or to transform, time out or find nothing, and a fallback that some have as a shadow."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("selection_id"))
    k = F.col("selection_id")
    chosen = c.withColumn("assigned_arm", F.when(k % 4 == 0, "control").otherwise("new"))
    first = chosen.select("selection_id", F.col("assigned_arm").alias("arm"), F.lit("serving").alias("role"), F.when(k % 3 == 1, "broken").alias("error"), (k % 6 == 2).alias("timed_out"), F.when(k % 5 == 0, "transform").otherwise("select").alias("source"), (k % 7).cast("int").alias("results"))
    second = c.where("selection_id % 2 = 0").select("selection_id", F.lit("control").alias("arm"), F.when(k % 8 == 2, "shadow").otherwise("serving").alias("role"), F.when(k % 9 == 0, "broken").alias("error"), F.lit(False).alias("timed_out"), F.lit("select").alias("source"), F.lit(1).alias("results"))
    runs = first.unionByName(second.where("selection_id % 4 <> 0"))
    return experiments.serve(chosen, runs, "control")


SERVING = """
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'control' ELSE 'new' END AS arm FROM customer),
o AS (SELECT *, CASE WHEN k % 6 = 2 THEN 'timeout' WHEN k % 3 = 1 THEN 'error' WHEN k % 7 = 0 THEN 'empty' ELSE 'ok' END AS first, k % 5 = 0 AS transformed, CASE WHEN k % 4 = 2 THEN CASE WHEN k % 9 = 0 THEN 'error' ELSE 'ok' END END AS other FROM c),
t AS (SELECT *, first NOT IN ('ok', 'empty') AND NOT transformed AND arm <> 'control' AS turns FROM o),
f AS (SELECT *, CASE WHEN turns THEN coalesce(other, 'error') ELSE first END AS outcome FROM t)
SELECT k AS selection_id, arm AS assigned_arm, CASE WHEN outcome IN ('ok', 'empty') THEN CASE WHEN turns THEN 'control' ELSE arm END END AS effective_arm, outcome, turns AND other = 'ok' AND k % 8 = 2 AS reused_shadow FROM f"""


def attribute_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX3: which attributes of two results agree."""
    k = F.col("p_partkey")
    a = F.map_from_arrays(F.array(F.lit("size"), F.lit("type")), F.array(F.col("p_size").cast("string"), F.col("p_type")))
    b = F.when(k % 3 == 0, F.map_from_arrays(F.array(F.lit("type"), F.lit("zone")), F.array(F.col("p_type"), F.lit("z")))).otherwise(F.map_from_arrays(F.array(F.lit("size"), F.lit("type")), F.array((F.col("p_size") + k % 2).cast("string"), F.col("p_type"))))
    same = experiments.attributes_equal(a, b)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.map_entries(same), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("agree"))


ATTRIBUTES = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'size=false,type=true,zone=false' WHEN p_partkey % 2 = 0 THEN 'size=true,type=true' ELSE 'size=false,type=true' END AS agree FROM part"


def arm_warmups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX10: warmups of three arms, one at each view, that fail now and then; they take 200 seconds. Tests hold the rule against brute force."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    calls = e.select((F.col("event_id") % 3).cast("string").alias("arm"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.lit(200_000).cast("long").alias("took_ms"), (F.col("event_id") % 11 < 9).alias("failed"))
    return experiments.warmups(calls)


WARMUPS = """
WITH RECURSIVE c AS (SELECT CAST(event_id % 3 AS VARCHAR) AS arm, event_id AS seq, epoch_us(ts) // 1000 AS at_ms, event_id % 11 < 9 AS failed, row_number() OVER (PARTITION BY event_id % 3 ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events WHERE event_type = 'view'),
w AS (SELECT arm, n, at_ms + 200000 AS ends, failed FROM c WHERE n = 1
  UNION ALL SELECT w.arm, x.n, x.at_ms + 200000, x.failed FROM w, LATERAL (SELECT c.n, c.at_ms, c.failed FROM c WHERE c.arm = w.arm AND c.at_ms >= w.ends AND w.failed ORDER BY c.n LIMIT 1) x)
SELECT c.arm, c.seq, w.n IS NOT NULL AS runs, NOT EXISTS (SELECT 1 FROM w g WHERE g.arm = c.arm AND NOT g.failed AND g.ends <= c.at_ms) AS cold FROM c LEFT JOIN w ON w.arm = c.arm AND w.n = c.n"""


def wire_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CS5: skills on the wire, some with a field too few, one that nothing knows, or one that must not be there."""
    p = table(spark, sf_dir, "part")
    base = '"id":"1","name":"n","description":"d","tags":[],"tools":[],"metadata":{"token":"inside is no field"}'
    k = F.col("p_partkey") % 5
    end = F.when(k == 0, ',"body":"b"}').when(k == 1, "}").when(k == 2, ',"body":"b","extra":1}').when(k == 3, ',"body":"b","Api_Key_2":"x","zBearerToken":2}').otherwise("")
    return p.select("p_partkey", F.array_join(catalog.wire_problems(F.concat(F.lit("{" + base), end)), ",").alias("problems"))


WIRE = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'missing body' WHEN 2 THEN 'unknown extra' WHEN 3 THEN 'forbidden Api_Key_2,forbidden zBearerToken' END AS problems FROM part"


def sanitised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR8: events with long queries and long lists, of the product or not, within the bounds of what is published."""
    k = F.col("p_partkey")
    event = F.struct(
        F.lit(2).alias("v"), F.lit("e").alias("event_id"), k.alias("ts"), F.lit("s").alias("session_id"), F.lit("x").alias("source_id"), F.lit("search").alias("type"),
        F.repeat(F.lit("q"), ((k % 9) * 1000).cast("int")).alias("query"), F.array_repeat(F.repeat(F.lit("j"), 4000), (k % 40).cast("int")).alias("junk"), F.array_repeat(F.lit("h"), (k % 150).cast("int")).alias("hits"),
    )
    # A row is a few bytes in its file and 80 KB as an event: rows are dealt to all cores.
    keys = table(spark, sf_dir, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)
    raw = keys.select("p_partkey", sanitise.sanitised(F.to_json(event)).alias("json"))
    told = raw.select("p_partkey", F.json_tuple("json", "query", "junk", "hits", "payload_truncated").alias("query", "junk", "hits", "cut"))
    size = lambda name: F.coalesce(F.json_array_length(name), F.lit(-1)).alias(name)
    return told.select("p_partkey", F.length("query").alias("query"), size("junk"), size("hits"), F.coalesce("cut", F.lit("false")).alias("cut"))


SANITISED = """
WITH e AS (SELECT p_partkey, CAST(least(4096, (p_partkey % 9) * 1000) AS INTEGER) AS query, CAST(p_partkey % 40 AS INTEGER) AS junk, CAST(least(100, p_partkey % 150) AS INTEGER) AS hits FROM part),
b AS (SELECT *, 94 + length(CAST(p_partkey AS VARCHAR)) + query + CASE WHEN junk = 0 THEN 0 ELSE junk * 4003 - 1 END + CASE WHEN hits = 0 THEN 0 ELSE hits * 4 - 1 END > 65536 AS over FROM e)
SELECT p_partkey, query, CASE WHEN over THEN -1 ELSE junk END AS junk, hits, CASE WHEN over THEN 'true' ELSE 'false' END AS cut FROM b"""


def trace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR6, TR7, TR12: the trace as files of JSON lines, read with the order of files and lines, and half of it by hash."""
    root = f"{shared_dir(spark)}/tidewright-trace-{tracelog.ulid()}"
    e = inputs.trace(spark, sf_dir).select("type", "query", "origin", F.col("log_seq").cast("string").alias("event_id"), "ts")
    tracelog.write(e.repartitionByRange(3, F.col("event_id").cast("long")).sortWithinPartitions(F.col("event_id").cast("long")), root)
    read = tracelog.read(spark, root)
    order = read.withColumn("n", F.count("*").over(Window.partitionBy("file"))).groupBy("file", "n").agg(F.count_if(F.col("line") < 0).alias("bad"), F.min_by(F.col("event_id").cast("long"), "log_seq").alias("first"), F.max_by(F.col("event_id").cast("long"), "log_seq").alias("last"), F.min(F.col("event_id").cast("long")).alias("least"), F.max(F.col("event_id").cast("long")).alias("most"))
    sound = order.agg(F.bool_and((F.col("first") == F.col("least")) & (F.col("last") == F.col("most")) & (F.col("bad") == 0)).alias("in_order"))
    half = tracelog.sampled(read, 0.5)
    return half.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("event_id").cast("long")).alias("ids")).crossJoin(F.broadcast(sound))


TRACE_FILES = f"""WITH {_TRACE}, s AS (SELECT type, log_seq, list_reduce(list_transform(string_split(substring(md5(CAST(log_seq AS VARCHAR)), 1, 8), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, b: a * 16 + b) AS h FROM trace)
SELECT type, count(*) AS n, CAST(sum(log_seq) AS BIGINT) AS ids, true AS in_order FROM s WHERE h < 2147483648 GROUP BY type"""


def baseline_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN19: user turns as baseline turns of a host without search, with what they invoked."""
    call = lambda kind, n: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit("c"), ((F.col("conv_id") + n) % 7).cast("string")).alias("capability"))
    none = F.array().cast("array<struct<kind:string,capability:string>>")
    invoked = F.when(F.col("conv_id") % 3 == 0, none).when(F.col("conv_id") % 3 == 1, F.array(call("tool", 1))).otherwise(F.array(call("skill", 2), call("tool", 3)))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session"), "turn", F.col("text").alias("query"), F.lit(5).cast("long").alias("ts"), invoked.alias("invoked"), "conv_id")
    rows = learning.baseline_rows(turns)
    return rows.select("session", "log_seq", "type", "origin", F.md5("query").alias("query"), F.coalesce(F.col("top_k").cast("string"), F.lit("null")).alias("top_k"), "capability_id")


BASELINE = """
WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
e AS (SELECT conv_id, turn, 0 AS p, 'search' AS type, md5(text) AS query, '0' AS top_k, NULL AS capability_id FROM t
  UNION ALL SELECT conv_id, turn, 1, 'invoke_start', NULL, 'null', 'c' || CAST((conv_id + 1) % 7 AS VARCHAR) FROM t WHERE conv_id % 3 = 1
  UNION ALL SELECT conv_id, turn, 1, 'skill_invoke', NULL, 'null', 'c' || CAST((conv_id + 2) % 7 AS VARCHAR) FROM t WHERE conv_id % 3 = 2
  UNION ALL SELECT conv_id, turn, 2, 'invoke_start', NULL, 'null', 'c' || CAST((conv_id + 3) % 7 AS VARCHAR) FROM t WHERE conv_id % 3 = 2)
SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) - 1 AS log_seq, type, 'baseline' AS origin, query, top_k, capability_id FROM e"""


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM1, EM4: part names embedded as queries of the built-in model by signed hashes of words; a weighted sum of each unit vector."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    made = embedders.embed(p, embedders.hashing, "hashing-64", embedders.Spec(spec=embedders.DEFAULT), query=True)
    return made.select("id", F.round(F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


HASH_EMBEDDING = f"""
WITH w AS (SELECT p_partkey AS id, unnest(regexp_extract_all(lower('{embedders.DEFAULT_QUERY_PREFIX}' || p_name || ' ' || p_type), '[a-z0-9]+')) AS w FROM part),
h AS (SELECT id, (16 * (instr('0123456789abcdef', substring(md5(w), 15, 1)) - 1) + instr('0123456789abcdef', substring(md5(w), 16, 1)) - 1) % 64 AS b, CASE WHEN substring(md5(w), 1, 1) >= '8' THEN 1e0 ELSE -1e0 END AS s FROM w),
v AS (SELECT id, b, sum(s) AS x FROM h GROUP BY id, b), n AS (SELECT id, sqrt(sum(x * x)) AS l FROM v GROUP BY id)
SELECT id, round(CASE WHEN l = 0 THEN 1e0 ELSE sum((b + 1) * CAST(CAST(x / l AS FLOAT) AS DOUBLE)) END, 4) AS total FROM v JOIN n USING (id) GROUP BY id, l"""


def embedder_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM8, EM9: models loaded on two workers, one of which always fails."""

    def broken():
        raise OSError("no such model")

    return embedders.load_events(spark, {"hashing": embedders.hashing, "broken": broken}, 2).drop("took_ms")


LOADS = "SELECT model, 'embedder_load' AS type, status FROM (VALUES ('hashing', 'ok'), ('broken', 'failed')) AS m(model, status), (SELECT unnest([1, 2]))"

# Words and their stems, of the published sample of the English stemmer.
_STEMS = "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot".split()


def stemmed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX6: the analyser on the published sample words, alone and in a sentence."""
    words = spark.createDataFrame([(w,) for w in _STEMS[::2]], "word string")
    said = words.withColumn("text", F.concat(F.lit("The "), F.initcap("word"), F.lit(", and it!")))
    return said.select("word", F.array_join(english_tokens(F.col("text")), " ").alias("tokens"))


STEMMED = "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in zip(_STEMS[::2], _STEMS[1::2], strict=True)) + ") AS t(word, tokens)"


def ranking_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RK5, RT9: scores that are no numbers are not ranked; a search for nothing, or in nothing, finds nothing."""
    from tidewright.operators.ranking import top

    p = table(spark, sf_dir, "part")
    hits = p.select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 == 0, F.lit(float("nan"))).when(F.col("p_size") % 7 == 1, F.lit(None).cast("double")).otherwise(F.col("p_size").cast("double")).alias("score"))
    v = inputs.vectors(spark, sf_dir)
    q = v.where("id < 3").select(F.col("id").cast("string").alias("query_id"), F.lit("x").alias("text"), F.col("vec").alias("qvec"))
    nothing = search.search("semantic", 0, q, None, v).unionByName(search.search("hybrid", 5, q, None, v.limit(0))).select("query_id", F.lit(0).cast("long").alias("id"), "score", "rank")
    return top(hits, ["query_id"], 4).select("query_id", "id", "score", "rank").unionByName(nothing)


RANKING_EDGES = "SELECT * FROM (SELECT p_brand AS query_id, p_partkey AS id, CAST(p_size AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) - 1 AS INTEGER) AS rank FROM part WHERE p_size % 7 > 1) WHERE rank < 4"


PLANS = {
    "baseline_turns": (baseline_turns, BASELINE),
    "hash_embedding": (hash_embedding, HASH_EMBEDDING),
    "embedder_loads": (embedder_loads, LOADS),
    "stemmed_words": (stemmed_words, STEMMED),
    "ranking_edges": (ranking_edges, RANKING_EDGES),
    "live_credit": (live_credit, LIVE),
    "graph_json": (graph_json, GRAPH_JSON),
    "usage_tiers": (usage_tiers, TIERS),
    "model_mismatch": (model_mismatch, MISMATCH),
    "adaptive_state": (adaptive_state, ADAPTIVE),
    "dense_rebuild": (dense_rebuild, REBUILD),
    "capability_recall": (capability_recall, RECALL),
    "recall_counts": (recall_counts, RECALL_COUNTS),
    "tools_only": (tools_only, TOOLS_ONLY),
    "first_registration": (first_registration, FIRST_WINS),
    "ground_turns": (ground_turns, GROUND),
    "ground_snapshot": (ground_snapshot, GROUND_SNAPSHOT),
    "experiment_serving": (experiment_serving, SERVING),
    "attribute_agreement": (attribute_agreement, ATTRIBUTES),
    "arm_warmups": (arm_warmups, WARMUPS),
    "wire_rule": (wire_rule, WIRE),
    "sanitised_events": (sanitised_events, SANITISED),
    "trace_files": (trace_files, TRACE_FILES),
}
