"""Queries over text, retrieval, ranking and corpus maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import schema_walk, text, vectors
from tidewright.functions.text import STOPWORDS
from tidewright.operators import bm25, catalog, dense, ranking, search
from tidewright.plans import inputs
from tidewright.plans.inputs import QUERIES, table
from tidewright.sources import artifact, mcp

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def sql_tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '([\\p{{L}}\\p{{N}}]+)', 1), lambda t: t NOT IN ({_STOP}))"


_ASKED = "(VALUES " + ", ".join(f"('{q}', '{t}')" for q, t in QUERIES) + ") AS asked(query_id, text)"


def sql_bm25(docs: str, k: int | None, queries: str = _ASKED) -> str:
    """BM25 of a query list over a (id, text) relation; every constant a double."""
    ranked = f"""
    WITH docs AS ({docs}),
    bags AS (SELECT id, {sql_tokens("text")} AS t FROM docs),
    stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(t) AS DOUBLE)) AS avgdl FROM bags),
    postings AS (SELECT id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT id, CAST(len(t) AS DOUBLE) AS dl, unnest(t) AS term FROM bags) GROUP BY ALL),
    terms AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM postings GROUP BY term),
    q AS (SELECT query_id, term, CAST(count(*) AS DOUBLE) AS qf FROM (SELECT query_id, unnest({sql_tokens("text")}) AS term FROM {queries}) GROUP BY ALL),
    scored AS (
      SELECT query_id, id, round(sum(qf * ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 1.9e0) / (tf + 0.9e0 * (0.6e0 + 0.4e0 * dl / avgdl))), 6) AS score
      FROM q JOIN postings USING (term) JOIN terms USING (term), stats GROUP BY query_id, id),
    ranked AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM scored)
    SELECT query_id, id, score, rank FROM ranked"""
    return ranked + (f" WHERE rank < {k}" if k is not None else "")


def index_of(spark: SparkSession, sf_dir: str) -> bm25.Index:
    return bm25.kept(inputs.documents(spark, sf_dir))


def split_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX1, TX2: identifiers built from part names and types."""
    name = F.concat(F.lit("get"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("_by_"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.split_identifier(name).alias("words"), text.push_identifier(name).alias("pushed"))


_IDENT = "'get' || list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') || '_by_' || p_type"
SPLIT = f"""
WITH n AS (SELECT p_partkey, {_IDENT} AS s FROM part),
w AS (SELECT p_partkey, s, replace(regexp_replace(s, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '_', ' ') AS words FROM n)
SELECT p_partkey, words, CASE WHEN words = s THEN s ELSE s || ' ' || words END AS pushed FROM w"""


def projection_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX5: parts as skills with a tag, an empty tag, and an override for some (an empty one counts)."""
    override = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).when(F.col("p_partkey") % 7 == 0, F.lit("special"))
    shown = text.entry_projection(F.col("p_name"), F.col("p_type"), F.array("p_brand", F.lit("")), override)
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("shown"))


PROJECTION = """
SELECT p_partkey, p_name || ' ' || CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'special' ELSE p_type END || ' ' || p_brand AS shown FROM part"""


def tool_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX3, TX4: names, descriptions (an override for some, an empty one counts), and what input and output schemas say in the author's order."""
    p = table(spark, sf_dir, "part")
    takes = F.concat(F.lit('{"type":"object","properties":{"partSize":{"type":"integer","description":"'), F.col("p_type"), F.lit('"},"brand":{"enum":["'), F.col("p_brand"), F.lit('",1]},"dims":{"items":{"properties":{"width_mm":{"description":"w"}}}}},"anyOf":[{"properties":{"no":{}}}]}'))
    gives = F.when(F.col("p_partkey") % 2 == 0, '{"properties":{"unitPrice":{"description":"in cents"}}}')
    override = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).when(F.col("p_partkey") % 7 == 0, F.lit("special"))
    return p.select("p_partkey", text.tool_projection(F.col("p_name"), F.lit("part"), takes, gives, override).alias("shown"))


TOOL_PROJECTION = """SELECT p_partkey, p_name || ' ' || CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'special' ELSE 'part' END || ' partSize part Size ' || p_type || ' brand ' || p_brand || ' dims width_mm width mm w'
  || CASE WHEN p_partkey % 2 = 0 THEN ' unitPrice unit Price in cents' ELSE '' END AS shown FROM part"""


def usage_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX7"""
    t = table(spark, sf_dir, "documents").select("doc_id", text.usage_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


TOKENS = f"WITH x AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents) SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM x"


def compact_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX8, TX10"""
    d = table(spark, sf_dir, "documents")
    count = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 10)
    return d.select("doc_id", text.compact_description(F.col("text")).alias("short"), text.upstream_line(F.col("source"), F.col("text"), count, F.col("doc_id") % 2 == 0).alias("line"))


COMPACT = r"""
WITH f AS (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents),
c AS (SELECT *, substring(flat, 1, 159) AS cut FROM f),
l AS (SELECT *, length(cut) - instr(reverse(cut), ' ') AS last FROM c),
s AS (SELECT doc_id, source, CASE WHEN length(flat) <= 160 THEN flat WHEN instr(cut, ' ') > 0 AND last > 80 THEN rtrim(substring(cut, 1, last)) || '…' ELSE rtrim(cut) || '…' END AS short FROM l)
SELECT doc_id, short, '- ' || source || CASE WHEN short <> '' THEN ' — ' || short ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' (' || CAST(doc_id % 10 AS VARCHAR) || ' tools)' ELSE '' END
  || CASE WHEN doc_id % 2 = 0 THEN ' (auth required)' ELSE '' END AS line FROM s"""


def server_of_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX9: ids with a server, without, and with nothing before the underscores."""
    i = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("__"), "p_name")).when(F.col("p_partkey") % 4 == 1, F.col("p_name")).otherwise(F.col("id"))
    return inputs.tools(spark, sf_dir).select("p_partkey", text.server_of(i).alias("server"), text.auth_server_of(i).alias("auth_server"))


SERVER = """
WITH i AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '__' || p_name WHEN p_partkey % 4 = 1 THEN p_name ELSE lower(replace(p_brand, '#', '_')) || '__' || CAST(p_partkey AS VARCHAR) END AS id FROM part)
SELECT p_partkey, CASE WHEN instr(id, '__') > 1 THEN substring(id, 1, instr(id, '__') - 1) ELSE id END AS server, CASE WHEN instr(id, '__') > 1 THEN substring(id, 1, instr(id, '__') - 1) END AS auth_server FROM i"""


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT1, CM3: all terms, with the statistics of the index."""
    i = index_of(spark, sf_dir)
    return i.terms.join(F.broadcast(i.stats), "kind").select("term", "df", F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avgdl"))


BM25_STATS = f"""
WITH bags AS (SELECT doc_id, {sql_tokens("text")} AS t FROM documents), s AS (SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avgdl FROM bags),
p AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM bags)
SELECT term, count(*) AS df, n_docs, avgdl FROM p, s GROUP BY term, n_docs, avgdl"""


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT2, RK1, RK3, RT12"""
    return bm25.search(index_of(spark, sf_dir), inputs.asked(spark), 10).select("query_id", "id", "score", "rank")


BM25_TOPK = sql_bm25("SELECT doc_id AS id, text FROM documents", 10)


def bm25_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT2, CM3: every user turn against all documents."""
    return bm25.search(index_of(spark, sf_dir), inputs.turns(spark, sf_dir), 10).select("query_id", "id", "score", "rank")


BM25_TURNS = sql_bm25("SELECT doc_id AS id, text FROM documents", 10, "(SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user')")


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.vectors(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT3"""
    return dense.search(inputs.vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), 10).drop("kind")


_DOT = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_DENSE = f"SELECT q.vec_id AS query_id, e.vec_id AS id, round({_DOT.format(a='q.embedding', b='e.embedding')}, 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"
DENSE_TOPK = f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM ({_DENSE})) WHERE rank < 10"


def cosine_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT4: unscaled vectors against the first, and a vector of zeros."""
    v = inputs.vectors(spark, sf_dir)
    first = v.where("id = 0").select(F.col("vec").alias("b"))
    scaled = F.transform("vec", lambda x: x.cast("double") * (F.col("id") % 3).cast("double"))
    return v.crossJoin(F.broadcast(first)).select("id", F.round(vectors.cosine(scaled, F.col("b")), 6).alias("cosine"))


COSINE = f"SELECT e.vec_id AS id, CASE WHEN e.vec_id % 3 = 0 THEN 0e0 ELSE round({_DOT.format(a='e.embedding', b='f.embedding')} / sqrt({_DOT.format(a='e.embedding', b='e.embedding')} * {_DOT.format(a='f.embedding', b='f.embedding')}), 6) END AS cosine FROM embeddings e, embeddings f WHERE f.vec_id = 0"


def _asked_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asked queries with the first vectors as theirs."""
    first = inputs.vectors(spark, sf_dir).where("id < 6").select((F.col("id") + 1).alias("n"), F.col("vec").alias("qvec"))
    return inputs.asked(spark).withColumn("n", F.substring("query_id", 2, 2).cast("long")).join(F.broadcast(first), "n").drop("n")


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT5, RK2: BM25 and vectors, depth 100 in each arm, the second at half weight, ranks from 0, cut to 10."""
    q = _asked_both(spark, sf_dir)
    lexical = bm25.search(index_of(spark, sf_dir), q, ranking.depth(10))
    near = dense.search(inputs.vectors(spark, sf_dir), q, ranking.depth(10))
    return ranking.rrf([(lexical, 1.0), (near, 0.5)], ["query_id"], 10)


_ARMS = f"""
a AS ({sql_bm25("SELECT doc_id AS id, text FROM documents", 100)}),
d AS (SELECT 'q' || CAST(q.vec_id + 1 AS VARCHAR) AS query_id, e.vec_id AS id, round({_DOT.format(a='q.embedding', b='e.embedding')}, 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id < 6),
b AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM d) WHERE rank < 100)"""
RRF = f"""
WITH {_ARMS},
f AS (SELECT query_id, id, round(sum(p), 9) AS score FROM (SELECT query_id, id, 1e0 / (6e1 + rank) AS p FROM a UNION ALL SELECT query_id, id, 0.5e0 / (6e1 + rank) FROM b) GROUP BY query_id, id)
SELECT *, true AS fused FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM f) WHERE rank < 10"""


def search_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT5, RT6, RT8: the three methods on one corpus of (id, text, vec), one table."""
    v, q = inputs.vectors(spark, sf_dir), _asked_both(spark, sf_dir)
    index = index_of(spark, sf_dir)
    found = [search.search(m, 5, q, index, v.select("id", "vec")).withColumn("method", F.lit(m)).select("method", "query_id", "id", "score", "rank", "fused") for m in ("bm25", "dense", "hybrid")]
    return found[0].unionByName(found[1]).unionByName(found[2])


SEARCH_METHODS = f"""
WITH {_ARMS},
f AS (SELECT query_id, id, round(sum(1e0 / (6e1 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM a UNION ALL SELECT query_id, id, rank FROM b) GROUP BY query_id, id),
h AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM f)
SELECT 'bm25' AS method, query_id, id, score, rank, false AS fused FROM a WHERE rank < 5 UNION ALL SELECT 'dense', query_id, id, score, rank, false FROM b WHERE rank < 5
UNION ALL SELECT 'hybrid', query_id, id, score, rank, true FROM h WHERE rank < 5"""


def _kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as tools, benchmark items as skills, parts as facts, with equal ids; vectors for all, one table shifted for each kind."""
    texts = (table(spark, sf_dir, "documents").select(F.lit("tool").alias("kind"), F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "benchmark").select(F.lit("skill").alias("kind"), F.col("item_id").alias("id"), "text"), table(spark, sf_dir, "part").select(F.lit("fact").alias("kind"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lit("and the"), "p_type").alias("text")))
    v = inputs.vectors(spark, sf_dir)
    vecs = [v.select(F.lit(kind).alias("kind"), (F.col("id") + shift).alias("id"), "vec") for kind, shift in (("tool", 0), ("skill", 1), ("fact", 2))]
    return texts[0].unionByName(texts[1]).unionByName(texts[2]), vecs[0].unionByName(vecs[1]).unionByName(vecs[2])


_ARM_ROWS = (("q1", "tool", 5, 0, 0.5), ("q1", "skill", 7, 0, 0.5), ("q1", "fact", 3, 0, 0.5), ("q2", "tool", 5, 0, 0.25))


def kind_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT10, RT11, RT12: tools, skills and facts in one index, each kind with its statistics, ranks and budget; the arm boosts tools and skills, never facts."""
    corpus, vecs = _kinds(spark, sf_dir)
    q, index = _asked_both(spark, sf_dir), bm25.kept(corpus)
    arm = spark.createDataFrame(list(_ARM_ROWS), "query_id string, kind string, id long, rank int, weight double")
    found = [search.budgeted(search.search(m, 5, q, index, vecs, arm)).withColumn("method", F.lit(m)).select("method", "query_id", "kind", "id", "score", "rank", "fused") for m in ("bm25", "semantic", "hybrid")]
    return found[0].unionByName(found[1]).unionByName(found[2])


_KIND_DOCS = (("tool", "SELECT doc_id AS id, text FROM documents"), ("skill", "SELECT item_id AS id, text FROM benchmark"), ("fact", "SELECT p_partkey AS id, p_name || ' and the ' || p_type AS text FROM part"))
_KIND_ARMS = f"""
lex AS ({" UNION ALL ".join(f"SELECT '{kind}' AS kind, * FROM ({sql_bm25(docs, 100)})" for kind, docs in _KIND_DOCS)}),
dots AS (SELECT 'q' || CAST(q.vec_id + 1 AS VARCHAR) AS query_id, k.kind, e.vec_id + k.shift AS id, round({_DOT.format(a='q.embedding', b='e.embedding')}, 6) AS score FROM embeddings q, embeddings e, (VALUES ('tool', 0), ('skill', 1), ('fact', 2)) AS k(kind, shift) WHERE q.vec_id < 6),
near AS (SELECT * FROM (SELECT kind, query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM dots) WHERE rank < 100),
usage AS (SELECT * FROM (VALUES {", ".join(f"('{q}', '{k}', {i}, {r}, {w}e0)" for q, k, i, r, w in _ARM_ROWS if k != "fact")}) AS t(query_id, kind, id, rank, weight)),
base AS (SELECT 'bm25' AS method, kind, query_id, id, score, rank FROM lex UNION ALL SELECT 'semantic', kind, query_id, id, score, rank FROM near),
parts AS (SELECT b.method, b.kind, b.query_id, b.id, 1e0 / (6e1 + b.rank) AS p FROM base b WHERE EXISTS (SELECT 1 FROM usage u WHERE u.query_id = b.query_id AND u.kind = b.kind)
  UNION ALL SELECT m.method, u.kind, u.query_id, u.id, u.weight / (6e1 + u.rank) FROM usage u, (VALUES ('bm25'), ('semantic')) AS m(method)
  UNION ALL SELECT 'hybrid', kind, query_id, id, 1e0 / (6e1 + rank) FROM base UNION ALL SELECT 'hybrid', kind, query_id, id, weight / (6e1 + rank) FROM usage),
fused AS (SELECT method, kind, query_id, id, round(sum(p), 9) AS score FROM parts GROUP BY ALL)"""
KIND_SEARCH = f"""
WITH {_KIND_ARMS},
f AS (SELECT method, query_id, kind, CAST(id AS BIGINT) AS id, score, CAST(row_number() OVER (PARTITION BY method, query_id, kind ORDER BY score DESC, id) - 1 AS INTEGER) AS rank, true AS fused FROM fused
  UNION ALL SELECT method, query_id, kind, id, score, rank, false FROM base b WHERE NOT EXISTS (SELECT 1 FROM usage u WHERE u.query_id = b.query_id AND u.kind = b.kind))
SELECT * FROM f WHERE rank < CASE kind WHEN 'tool' THEN 5 ELSE 3 END"""


def search_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR9: for each hybrid search with an arm the stages that ran, in order, with their best scores."""
    corpus, vecs = _kinds(spark, sf_dir)
    arm = spark.createDataFrame(list(_ARM_ROWS), "query_id string, kind string, id long, rank int, weight double")
    ran = search.arms("hybrid", 5, _asked_both(spark, sf_dir), bm25.kept(corpus), vecs, arm)
    ran["rrf"] = search.search("hybrid", 5, _asked_both(spark, sf_dir), bm25.kept(corpus), vecs, arm)
    told = lambda s: F.concat_ws(":", s["name"], s["n"].cast("string"), F.format_string("%.6f", F.coalesce(s["top_score"], F.lit(-1.0))))
    return search.stages(ran).select("query_id", "kind", F.array_join(F.transform("stages", told), " ").alias("stages"))


STAGES = f"""
WITH {_KIND_ARMS},
top AS (SELECT * FROM (SELECT query_id, kind, score, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id) AS r FROM fused WHERE method = 'hybrid') WHERE r <= 5),
s AS (SELECT query_id, kind, 0 AS i, 'bm25' AS name, count(*) AS n, max(score) AS top FROM lex GROUP BY ALL UNION ALL SELECT query_id, kind, 1, 'dense', count(*), max(score) FROM near GROUP BY ALL
  UNION ALL SELECT query_id, kind, 2, 'usage', count(*), -1e0 FROM usage GROUP BY ALL UNION ALL SELECT query_id, kind, 3, 'rrf', count(*), max(score) FROM top GROUP BY ALL)
SELECT query_id, kind, string_agg(name || ':' || CAST(n AS VARCHAR) || ':' || printf('%.6f', top), ' ' ORDER BY i) AS stages FROM s GROUP BY query_id, kind"""


def clamp_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RK4"""
    return table(spark, sf_dir, "part").select("p_partkey", ranking.clamp_k_column(F.when(F.col("p_size") % 7 > 0, F.col("p_size") * 2 - 10), 5).cast("int").alias("k"))


CLAMP = "WITH x AS (SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN p_size * 2 - 10 END AS k FROM part) SELECT p_partkey, CAST(CASE WHEN k IS NULL OR k < 1 THEN 5 ELSE least(k, 50) END AS INTEGER) AS k FROM x"


def corpus_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM1: parts, then some again with another name, then some once more."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    again = p.where("id % 3 = 0").select("id", F.upper("p_name").alias("p_name"), "p_brand", (F.lit(10_000_000) + F.col("id")).alias("seq"))
    more = p.where("id % 9 = 0").select("id", F.concat("p_name", F.lit("!")).alias("p_name"), F.lit("x").alias("p_brand"), (F.lit(20_000_000) + F.col("id")).alias("seq"))
    return catalog.upsert(p.withColumn("seq", F.col("id")).unionByName(again).unionByName(more))


UPSERT = "SELECT p_partkey AS id, p_partkey AS seq, CASE WHEN p_partkey % 9 = 0 THEN p_name || '!' WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE p_brand END AS p_brand FROM part"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type")
    new = p.where("id % 10 <> 0").withColumn("p_name", F.when(F.col("id") % 7 == 0, F.concat("p_name", F.lit(" v2"))).otherwise(F.col("p_name")))
    return p.where("id % 11 <> 0"), new


def replace_all_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM2"""
    return catalog.replace_all(*_versions(spark, sf_dir), ["p_name", "p_type"]).groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_DIFF = """
WITH o AS (SELECT p_partkey AS id, p_name FROM part WHERE p_partkey % 11 <> 0),
n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' v2' ELSE p_name END AS p_name FROM part WHERE p_partkey % 10 <> 0),
j AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.p_name = n.p_name THEN 'unchanged' ELSE 'updated' END AS status FROM o FULL JOIN n ON o.id = n.id)
"""
REPLACE_ALL = _DIFF + "SELECT status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM j GROUP BY status"


def churn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM2: events of a replacement."""
    return catalog.churn(catalog.replace_all(*_versions(spark, sf_dir), ["p_name", "p_type"]))


CHURN = _DIFF + "SELECT status, count(*) AS n FROM j WHERE status <> 'unchanged' GROUP BY status"


def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM4, CM6: documents without a vector."""
    return dense.missing(inputs.documents(spark, sf_dir).select("id"), inputs.vectors(spark, sf_dir))


COVERAGE = "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"


def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM8, AR1"""
    spoilt = F.when(F.col("id") % 50 == 1, F.transform("vec", lambda x: x * 2)).when(F.col("id") % 50 == 2, F.array().cast("array<float>")).otherwise(F.col("vec"))
    return dense.validate(inputs.vectors(spark, sf_dir).withColumn("vec", spoilt))


VALIDATION = """
WITH v AS (SELECT vec_id % 50 AS m, embedding FROM embeddings)
SELECT count(*) AS n, CAST(2 AS BIGINT) AS widths, count(*) FILTER (m = 2) AS n_empty, CAST(0 AS BIGINT) AS n_not_finite, count(*) FILTER (m = 1 OR m = 2) AS n_not_unit FROM v"""


def definition_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM12: sound overrides of tools, and a batch with one that is too long, which changes nothing."""
    p = table(spark, sf_dir, "part").select(F.lit("tool").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("description"))
    good = p.where("id % 4 = 0").select("kind", "id", F.when(F.col("id") % 8 == 0, F.col("description")).otherwise(F.lit("")).alias("override"))
    bad = good.unionByName(p.where("id = '1'").select("kind", "id", F.repeat(F.lit("x"), 16_385).alias("override")))
    a = catalog.apply_overrides(p, good).select(F.lit("sound").alias("batch"), "id", "shown", "changed")
    return a.unionByName(catalog.apply_overrides(p, bad).select(F.lit("refused").alias("batch"), "id", "shown", "changed"))


OVERRIDES = """
SELECT 'sound' AS batch, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 8 <> 0 THEN '' ELSE p_type END AS shown, p_partkey % 4 = 0 AND p_partkey % 8 <> 0 AS changed FROM part
UNION ALL SELECT 'refused', CAST(p_partkey AS VARCHAR), p_type, false FROM part"""


def definition_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM11: four versions of each part's definition, nine fields in canonical JSON; only changes are listed. Some versions hold an integer beyond doubles: they make no event, the next one does."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type", "p_size", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("version"))
    size = F.when((F.col("version") == 3) & (F.col("id") % 4 == 0), "9007199254740993").otherwise((F.col("p_size") + F.when(F.col("version") > F.col("id") % 5, 1).otherwise(0)).cast("string"))
    takes = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "a": '), size, F.lit("}"))
    override = F.when((F.col("version") == 4) & (F.col("id") % 3 == 0), F.lit(""))
    content = catalog.definition(F.lit("tool"), F.col("id").cast("string"), F.col("p_name"), F.col("p_type"), F.array(F.lit("t"), F.lit('"u"')), schema_walk.canonical_json(takes), F.lit("null"), override)
    return catalog.definition_changes(p, content)


CHANGES = """
WITH v AS (SELECT p_partkey AS id, CAST(version AS INTEGER) AS version, p_name, p_type, CASE WHEN version = 4 AND p_partkey % 3 = 0 THEN '' END AS o, CASE WHEN version = 3 AND p_partkey % 4 = 0 THEN NULL ELSE p_size + CASE WHEN version > p_partkey % 5 THEN 1 ELSE 0 END END AS a FROM part, (SELECT unnest([1, 2, 3, 4]) AS version)),
h AS (SELECT id, version, sha256('{"description":"' || p_type || '","id":"' || id || '","input_schema":{"a":' || a || ',"name":"' || p_name || '"},"kind":"tool","name":"' || p_name || '","output_schema":null,"searchable_description":"' || coalesce(o, p_type)
  || '","searchable_description_overridden":' || CASE WHEN o IS NULL THEN 'false' ELSE 'true' END || ',"tags":["t","\\"u\\""]}') AS hash FROM v),
l AS (SELECT *, lag(hash) OVER (PARTITION BY id ORDER BY version) AS before FROM h)
SELECT id, version, hash FROM l WHERE hash IS NOT NULL AND (before IS NULL OR before <> hash)"""


def pinned_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM9"""
    b = table(spark, sf_dir, "benchmark").select("item_id", (F.lit(1000) - F.col("item_id")).alias("seq"), F.when(F.col("item_id") % 3 == 0, "always").otherwise("retrieved").alias("pin"))
    return catalog.pinned(b).select("item_id", "seq")


PINNED = "SELECT item_id, 1000 - item_id AS seq FROM benchmark WHERE item_id % 3 = 0"


def catalog_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM10, EX-free definitions by id, with the problems of fact ids."""
    p = inputs.tools(spark, sf_dir)
    bad = F.when(F.col("p_partkey") % 6 == 0, F.concat("id", F.lit(" x"))).otherwise(F.col("id"))
    pin = F.when(F.col("p_partkey") % 4 == 0, "sometimes").when(F.col("p_partkey") % 4 == 1, "always")
    return catalog.snapshot(p.select(bad.alias("id"), "p_name", catalog.fact_problem(bad, pin).alias("problem")), ["id", "p_name", "problem"])


SNAPSHOT = """
WITH i AS (SELECT p_partkey, p_name, lower(replace(p_brand, '#', '_')) || '__' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 6 = 0 THEN ' x' ELSE '' END AS id FROM part)
SELECT id, p_name, CASE WHEN p_partkey % 6 = 0 THEN 'id' WHEN p_partkey % 4 = 0 THEN 'pin' END AS problem FROM i"""


def artifact_warm_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR4: vectors are reused where the hash of the text is that of the artifact."""
    d = table(spark, sf_dir, "documents").select(F.lit("skill").alias("kind"), F.col("doc_id").alias("id"), "text")
    old = d.join(inputs.vectors(spark, sf_dir).select("id", "vec"), "id").withColumn("hash", artifact.projection_hash(F.when(F.col("id") % 4 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))))
    return artifact.warm(d, old).groupBy(F.col("vec").isNotNull().alias("reused")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


WARM = """
WITH w AS (SELECT d.doc_id, e.vec_id IS NOT NULL AND d.doc_id % 4 <> 0 AS reused FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)
SELECT reused, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM w GROUP BY reused"""


def artifact_merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR3: entries that two overlapping artifacts both have; each lacks a third of the vectors."""
    v = inputs.vectors(spark, sf_dir).select(F.lit("tool").alias("kind"), "id")
    return artifact.conflicts(v.where("id % 3 <> 0").unionByName(v.where("id % 3 <> 1")))


CONFLICTS = "SELECT 'tool' AS kind, vec_id AS id, CAST(2 AS BIGINT) AS n FROM embeddings WHERE vec_id % 3 = 2"


def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR1, AR2: vectors to artifact bytes, a file for each label, and back."""
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        data = artifact.encode(((r.kind, r.id, bytes.fromhex(r.hash), r.vec) for r in rows.itertuples()), len(rows["vec"].iloc[0]), "m")
        _, dim, _, entries = artifact.decode(data)
        return pd.DataFrame({"label": [key[0]], "n": [len(entries)], "dim": [dim], "total": [round(sum(sum(map(float, e[3])) for e in entries), 4)]})

    v = inputs.vectors(spark, sf_dir).select(F.lit("tool").alias("kind"), F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("hash"), "vec", "label")
    return v.groupBy("label").applyInPandas(run, "label int, n long, dim int, total double")


ROUND_TRIP = "SELECT label, count(*) AS n, CAST(64 AS INTEGER) AS dim, round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 4) AS total FROM embeddings GROUP BY label"


def mcp_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP13: parts as pages of upstream tool lists."""
    p = table(spark, sf_dir, "part")
    tool = F.concat(F.lit('{"name":"'), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit('","description":"'), "p_type", F.lit('","inputSchema":{"b":1,"a":2}}'))
    pages = p.groupBy(F.col("p_brand").alias("server"), (F.col("p_partkey") % 4).cast("int").alias("page")).agg(F.concat(F.lit('{"tools":['), F.array_join(F.sort_array(F.collect_list(tool)), ","), F.lit("]}")).alias("json"))
    return mcp.entries(pages).select("id", "description", "input_schema")


MCP = """SELECT p_brand || '__' || p_name || ' ' || CAST(p_partkey AS VARCHAR) AS id, p_type AS description, '{"b":1,"a":2}' AS input_schema FROM part"""


def scope_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CS1: a global layer, two subjects, and a subject that isn't known."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), "p_type")
    layers = p.withColumn("layer", F.lit("global")).withColumn("subject", F.lit(None).cast("string"))
    mine = p.where("id % 5 = 0").select((F.col("id") + 100_000).alias("id"), F.when(F.col("id") % 10 == 0, F.col("name")).otherwise(F.concat("name", F.lit("+"))).alias("name"), F.lit("mine").alias("p_type"), F.lit("subject").alias("layer"), F.lit("s1").alias("subject"))
    layers = layers.unionByName(mine)
    found = [catalog.resolve_scope(layers, s).select(F.lit(s or "none").alias("scope"), "id", "name", "p_type") for s in (None, "s1", "s9")]
    return found[0].unionByName(found[1]).unionByName(found[2])


SCOPE = """
WITH g AS (SELECT p_partkey AS id, p_brand || ' ' || CAST(p_partkey AS VARCHAR) AS name, p_type FROM part),
m AS (SELECT id + 100000 AS id, CASE WHEN id % 10 = 0 THEN name ELSE name || '+' END AS name, 'mine' AS p_type FROM g WHERE id % 5 = 0)
SELECT 'none' AS scope, * FROM g UNION ALL SELECT 's9', * FROM g UNION ALL SELECT 's1', * FROM m UNION ALL SELECT 's1', * FROM g WHERE name NOT IN (SELECT name FROM m)"""


def catalog_etag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CS2, CS3: benchmark items as skills, in groups."""
    b = table(spark, sf_dir, "benchmark").select(F.format_string("i%05d", "item_id").alias("id"), (F.col("item_id") % 4).alias("grp"), "text")
    meta = F.map_from_arrays(F.array(F.lit("z"), F.lit("a")), F.array(F.array(F.lit("1")), F.array(F.lit("x"), F.lit("y"))))
    none = F.array().cast("array<string>")
    return catalog.etag(b, catalog.canonical_skill(F.col("id"), F.lit("n"), F.col("text"), F.lit(None).cast("string"), F.array(F.lit("t")), none, meta, F.lit("")), ["grp"])


ETAG = r"""
WITH s AS (SELECT item_id % 4 AS grp, printf('i%05d', item_id) AS id, '"' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' AS d FROM benchmark),
c AS (SELECT grp, id, '{"id":"' || id || '","name":"n","description":' || d || ',"searchableDescription":null,"tags":["t"],"tools":[],"metadata":{"a":["x","y"],"z":["1"]},"body":""}' AS j FROM s)
SELECT grp, count(*) AS n, sha256('[' || string_agg(j, ',' ORDER BY id) || ']') AS etag FROM c GROUP BY grp"""

_HEADERS = [("h1", '"abc"'), ("h2", "abc"), ("h3", 'W/"abc"'), ("h4", '"x", W/"abc"'), ("h5", "*"), ("h6", ""), ("h7", '"abd"'), ("h8", '""'), ("h9", None)]


def if_none_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CS4"""
    return spark.createDataFrame(_HEADERS, "name string, header string").select("name", catalog.not_modified(F.col("header"), F.lit('"abc"')).alias("hit"))


NONE_MATCH = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {'true' if n in ('h1', 'h2', 'h3', 'h4', 'h5') else 'false'})" for n, _ in _HEADERS) + ") AS t(name, hit)"

PLANS = {
    "split_identifier": (split_identifier, SPLIT),
    "projection_text": (projection_text, PROJECTION),
    "tool_projection": (tool_projection, TOOL_PROJECTION),
    "usage_tokens": (usage_tokens, TOKENS),
    "compact_description": (compact_description, COMPACT),
    "server_of_tool": (server_of_tool, SERVER),
    "bm25_stats": (bm25_stats, BM25_STATS),
    "bm25_topk": (bm25_topk, BM25_TOPK),
    "bm25_turns": (bm25_turns, BM25_TURNS),
    "dense_topk": (dense_topk, DENSE_TOPK),
    "cosine_full": (cosine_full, COSINE),
    "rrf_hybrid": (rrf_hybrid, RRF),
    "search_methods": (search_methods, SEARCH_METHODS),
    "kind_search": (kind_search, KIND_SEARCH),
    "search_stages": (search_stages, STAGES),
    "clamp_top_k": (clamp_top_k, CLAMP),
    "corpus_upsert": (corpus_upsert, UPSERT),
    "replace_all_diff": (replace_all_diff, REPLACE_ALL),
    "churn_events": (churn_events, CHURN),
    "embedding_coverage": (embedding_coverage, COVERAGE),
    "vector_validation": (vector_validation, VALIDATION),
    "definition_overrides": (definition_overrides, OVERRIDES),
    "definition_changes": (definition_changes, CHANGES),
    "pinned_facts": (pinned_facts, PINNED),
    "catalog_snapshot": (catalog_snapshot, SNAPSHOT),
    "artifact_warm_split": (artifact_warm_split, WARM),
    "artifact_merge_conflicts": (artifact_merge_conflicts, CONFLICTS),
    "artifact_round_trip": (artifact_round_trip, ROUND_TRIP),
    "mcp_entries": (mcp_entries, MCP),
    "scope_overlay": (scope_overlay, SCOPE),
    "catalog_etag": (catalog_etag, ETAG),
    "if_none_match": (if_none_match, NONE_MATCH),
}
