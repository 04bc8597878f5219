"""Usage graph, write side: from a trace log to intent clusters.

Pairing, and everything that is derived from observations and the clusters that took them,
is relational. Which cluster takes an observation depends on those before it, so that alone
is walked in order, graphs in parallel."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from tidewright.functions.text import STOPWORDS, usage_tokens
from tidewright.operators.usage import DENSE_LEAST, EVICTION_FLOOR, GRACE_MS, HALF_LIFE_MS, LEXICAL_LEAST
from tidewright.operators.walk import walked

# Fixed values.
MOST_MEMBERS, LABEL_TERMS, GRAPH_VERSION = 50, 5, 1
#: Vectors of which the closest cluster is remembered.
MOST_FOUND = 4096


def classify(kind: Column, origin: Column, accepted: str | None = None) -> Column:
    """What an event is to the learner: search, tool, skill, or null. A search of another origin than the accepted one is ignored, so it is no boundary either."""
    fits = F.lit(True) if accepted is None else origin.eqNullSafe(F.lit(accepted))
    return F.when(kind.isin("search", "skill_search") & fits, "search").when(kind == "invoke_start", "tool").when(kind == "skill_invoke", "skill")


def pair(events: DataFrame) -> DataFrame:
    """Confirmations with the search they belong to: the session's last accepted search before them, in log order.

    events: (session, log_seq, role, query, capability_id, ts), role as of classify(). Result: (session, log_seq,
    kind, capability_id, ts, search_seq, query, first_confirmation)."""
    order = Window.partitionBy("session").orderBy("log_seq").rowsBetween(Window.unboundedPreceding, 0)
    is_search = F.col("role") == "search"
    seen = events.where("role is not null").withColumn("_s", F.last(F.when(is_search, F.struct(F.col("log_seq").alias("search_seq"), F.col("query").alias("q"))), ignorenulls=True).over(order))
    paired = seen.where(~is_search & F.col("_s").isNotNull())
    # The event, not its text: asking the same again is a new search.
    turn = Window.partitionBy("session", "_s.search_seq").orderBy("log_seq")
    return paired.withColumn("_n", F.row_number().over(turn)).select(
        "session", "log_seq", F.col("role").alias("kind"), "capability_id", "ts", F.col("_s.search_seq").alias("search_seq"), F.col("_s.q").alias("query"), (F.col("_n") == 1).alias("first_confirmation")
    )


def distinct_queries(observations: DataFrame) -> DataFrame:
    """Texts to embed, with the place of their first appearance."""
    return observations.groupBy("query").agg(F.min("log_seq").alias("first_seq"))


_RUN = re.compile(r"[^\W_]+")
_STOP = frozenset(STOPWORDS)


def _words(text: str) -> frozenset[str]:
    return frozenset(w for w in (m.lower() for m in _RUN.findall(text)) if w not in _STOP)


#: Age from which a cluster's recency is below the floor.
_OLD_MS = GRACE_MS + HALF_LIFE_MS * math.log2(1 / EVICTION_FLOOR)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (float(np.linalg.norm(v)) or 1.0)


@dataclass(eq=False)
class _Cluster:
    """What matching needs of a cluster; all else is counted afterwards from the observations that it took."""

    number: int
    birth: int
    last: int
    members: dict[str, frozenset[str]] = field(default_factory=dict)
    centroid: np.ndarray | None = None
    folded: int = 0
    name: str = field(init=False)

    def __post_init__(self) -> None:
        self.name = f"intent_{self.number}"


class Assigner:
    """Gives each observation of one graph, in order, the cluster that takes it."""

    def __init__(self) -> None:
        self.alive: list[_Cluster] = []
        self.bags: dict[str, dict[tuple[int, str], tuple[_Cluster, frozenset[str]]]] = {}
        self.sets: dict[frozenset[str], dict[tuple[int, str], _Cluster]] = {}  # members by their words
        self.newest = self.taken = self.births = self.oldest = 0  # none was used before `oldest`
        self.model: str | None = None
        self.tables: dict[int, tuple[list[_Cluster], np.ndarray, np.ndarray]] = {}  # centroids by width, until one changes
        self.found: dict[bytes, _Cluster | None] = {}  # what _closest() gave, as long

    def _moved(self) -> None:
        """Centroids have changed."""
        self.tables.clear()
        self.found.clear()

    def _closest(self, vector: np.ndarray) -> _Cluster | None:
        if (key := vector.tobytes()) not in self.found:
            if len(self.found) >= MOST_FOUND:
                self.found.clear()
            self.found[key] = self._nearest(vector)
        return self.found[key]

    def _nearest(self, vector: np.ndarray) -> _Cluster | None:
        if len(vector) not in self.tables:
            some = [c for c in self.alive if c.centroid is not None and len(c.centroid) == len(vector)]
            table = np.array([c.centroid for c in some]).reshape(len(some), len(vector))
            self.tables[len(vector)] = some, table, np.linalg.norm(table, axis=1)
        some, table, norms = self.tables[len(vector)]
        size = norms * float(np.linalg.norm(vector))
        cosine = np.divide(table @ vector, size, out=np.zeros(len(some)), where=size > 0)
        near = np.flatnonzero(cosine >= max(DENSE_LEAST, cosine.max(initial=0.0)))
        return min((some[i] for i in near), key=lambda c: c.name, default=None)

    def _alike(self, words: frozenset[str]) -> _Cluster | None:
        """The cluster with a member of at least half the words in common. Such a member has one of the rarest words, as many as it may lack and one more."""
        if same := self.sets.get(words):  # nothing is more alike
            return min(same.values(), key=lambda c: c.name)
        ranked = sorted(words, key=lambda w: (len(self.bags.get(w, ())), w))
        need = math.ceil(LEXICAL_LEAST * len(words))
        near = {id(bag): (c, bag) for w in ranked[: len(words) - need + 1] for c, bag in self.bags.get(w, {}).values()}
        scored = [(-len(words & bag) / len(words | bag), c.name, c) for c, bag in near.values()]
        score, _, best = min(scored, key=lambda x: x[:2], default=(0.0, "", None))
        return best if -score >= LEXICAL_LEAST else None

    def _list(self, cluster: _Cluster, text: str, words: frozenset[str]) -> None:
        cluster.members[text] = words
        self.sets.setdefault(words, {})[cluster.birth, text] = cluster
        for w in words:
            self.bags.setdefault(w, {})[cluster.birth, text] = (cluster, words)

    def _unlist(self, cluster: _Cluster, text: str) -> None:
        words = cluster.members.pop(text)
        del self.sets[words][cluster.birth, text]
        if not self.sets[words]:
            del self.sets[words]
        for w in words:
            del self.bags[w][cluster.birth, text]
            if not self.bags[w]:
                del self.bags[w]

    def take(self, query: str, ts: int, vector: np.ndarray | None = None, model: str | None = None) -> tuple[_Cluster, bool] | None:
        """The cluster, and whether it is new; none for a query without words and vector. A vector of another model than the graph's changes no centroid."""
        words = _words(query)
        if vector is None and not words:
            return None
        self.newest = max(self.newest, ts)
        own = None if vector is not None and None not in (self.model, model) and self.model != model else vector
        cluster = (self._closest(own) if own is not None else None) or (self._alike(words) if words else None)
        fresh = cluster is None
        if fresh:
            self.births += 1
            cluster = _Cluster(1 + max((c.number for c in self.alive), default=0), self.births, 0)
            self.oldest = min(self.oldest, ts)
            self.alive.append(cluster)
        cluster.last = max(cluster.last, ts)
        if query not in cluster.members:
            self._list(cluster, query, words)
            if own is not None:
                self._moved()
                if cluster.centroid is None or len(cluster.centroid) != len(own):
                    cluster.centroid, cluster.folded = _unit(own), 1
                else:
                    cluster.centroid, cluster.folded = _unit(cluster.centroid * cluster.folded + own), cluster.folded + 1
            for text in list(cluster.members)[:-MOST_MEMBERS]:
                self._unlist(cluster, text)
        if self.model is None and cluster.centroid is not None:
            self.model = model
        if self.newest - self.oldest > _OLD_MS:
            for old in [c for c in self.alive if self.newest - c.last > _OLD_MS]:
                self._moved()
                self.alive.remove(old)
                for text in list(old.members):
                    self._unlist(old, text)
            self.oldest = min((c.last for c in self.alive), default=self.newest)
        self.taken += 1
        return cluster, fresh


_TAKEN = "birth int, intent_id string, kind string, capability_id string, ts long, supports boolean, seeded boolean, rev long, built_from_ts long, model string, members array<string>, centroid array<double>"
FOLDED = "graph_id string, rev long, built_from_ts long, model string, intent_id string, members array<string>, centroid array<double>, support long, seeded_support long, last_ts long, tools map<string,double>, skills map<string,double>"


def _step(state: Assigner, row: dict[str, Any]) -> list[tuple]:
    vec = row.get("vec")
    found = state.take(row["query"], int(row["ts"]), None if vec is None else np.asarray(vec, float), row.get("model"))
    if found is None:
        return []
    cluster, fresh = found
    return [(cluster.birth, cluster.name, row["kind"], row["capability_id"], int(row["ts"]), fresh or bool(row["first_confirmation"]), bool(row.get("seeded")), None, None, None, None, None)]


def _finish(state: Assigner) -> list[tuple]:
    return [(c.birth, c.name, None, None, None, None, None, state.taken, state.newest, state.model, list(c.members), None if c.centroid is None else c.centroid.tolist()) for c in state.alive]


def fold(observations: DataFrame, graph: str = "graph_id") -> DataFrame:
    """Clusters of each graph: FOLDED. observations: (graph_id, log_seq, query, kind, capability_id, ts, first_confirmation[, seeded, vec, model]).

    Which cluster takes an observation depends on those before it and is walked in order; edges, support and times
    are sums over what each cluster took. Support counts first confirmations and what a cluster began with."""
    rest = [c for c in observations.columns if c != graph]
    rows = observations.select(F.col(graph).cast("string").alias("graph_id"), *rest)
    schema = StructType([StructField("graph_id", StringType()), *_parse_datatype_string(_TAKEN).fields])
    taken = walked(rows, ["graph_id"], ["log_seq"], Assigner, _step, _finish, schema)
    last = F.max(F.when(F.col("rev").isNotNull(), F.struct("rev", "built_from_ts", "model", "intent_id", "members", "centroid"))).alias("end")
    edges = taken.groupBy("graph_id", "birth", "kind", "capability_id").agg(F.count("*").cast("double").alias("weight"), F.sum(F.col("supports").cast("long")).alias("s"), F.sum((F.col("supports") & F.col("seeded")).cast("long")).alias("z"), F.max("ts").alias("t"), last)
    weights = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("capability_id", "weight")))))
    made = edges.groupBy("graph_id", "birth").agg(F.sum("s").alias("support"), F.sum("z").alias("seeded_support"), F.max("t").alias("last_ts"), weights("tool").alias("tools"), weights("skill").alias("skills"), F.max("end").alias("end"))
    return made.where("end is not null").select("graph_id", "end.rev", "end.built_from_ts", "end.model", "end.intent_id", "end.members", "end.centroid", "support", "seeded_support", "last_ts", "tools", "skills")


def live_confirmations(events: DataFrame, graph: str = "graph_id") -> DataFrame:
    """pair() with the credit of a live learner: sessions that share a graph share one slot, which holds the text of the graph's last search. An invocation confirms first if its own query is in the slot and none has since that search, so of concurrent sessions that ask the same only one does.

    events: as of pair(), with the graph's column."""
    whole = Window.partitionBy(graph).orderBy("log_seq").rowsBetween(Window.unboundedPreceding, 0)
    search = F.when(F.col("role") == "search", F.struct(F.col("log_seq").alias("armed_seq"), F.col("query").alias("armed")))
    slots = events.where("role is not null").select(graph, "log_seq", F.last(search, ignorenulls=True).over(whole).alias("_a"))
    paired = pair(events).drop("first_confirmation").join(slots, "log_seq").withColumn("_mine", F.col("_a.armed").eqNullSafe(F.col("query")))
    turn = Window.partitionBy(graph, "_a.armed_seq", "_mine").orderBy("log_seq")
    return paired.withColumn("first_confirmation", F.col("_mine") & (F.row_number().over(turn) == 1)).drop("_a", "_mine")


def label_terms(members: DataFrame, k: int = LABEL_TERMS, analyse: Callable[[Column], Column] = usage_tokens, digits: int = 9, within: str | None = None) -> DataFrame:
    """(cluster, term, score, rank): the words that set a cluster apart, by class-based TF-IDF. members: (cluster, text); clusters are held against all others, or those of one `within` column."""
    members = members.withColumn("_w", F.lit(0) if within is None else F.col(within))
    tokens = members.select("_w", "cluster", F.explode(analyse(F.col("text"))).alias("term"))
    local = tokens.groupBy("_w", "cluster", "term").agg(F.count("*").alias("n"))
    whole = local.groupBy("_w", "term").agg(F.sum("n").alias("f"))
    sizes = local.groupBy("cluster").agg(F.sum("n").alias("len"))
    clusters = members.groupBy("_w").agg(F.countDistinct("cluster").alias("clusters"))
    average = local.groupBy("_w").agg(F.sum("n").alias("total")).join(clusters, "_w").select("_w", (F.col("total") / F.col("clusters")).alias("avg"))
    score = (F.col("n") / F.col("len")) * F.log(F.lit(1.0) + F.col("avg") / F.col("f"))
    scored = local.join(whole, ["_w", "term"]).join(sizes, "cluster").join(average, "_w").select("cluster", "term", F.round(score, digits).alias("score"))
    order = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "term")
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def medoid(members: DataFrame, analyse: Callable[[Column], Column] = usage_tokens) -> DataFrame:
    """(cluster, label): the member of which the largest share of words, with repeats, is also in another member; of equals the smallest text."""
    bag = members.select("cluster", "text", analyse(F.col("text")).alias("t")).distinct()
    words = bag.select("cluster", "text", F.explode("t").alias("term"))
    spread = words.distinct().groupBy("cluster", "term").agg(F.count("*").alias("in_members"))
    shared = words.join(spread.where("in_members > 1").select("cluster", "term"), ["cluster", "term"], "left_semi").groupBy("cluster", "text").agg(F.count("*").alias("shared"))
    scored = bag.join(shared, ["cluster", "text"], "left").select("cluster", "text", F.when(F.size("t") > 0, F.coalesce("shared", F.lit(0)) / F.size("t")).otherwise(F.lit(0.0)).alias("score"))
    order = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "text")
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("cluster", F.col("text").alias("label"))


GRAPH = (
    "v int, built_from_ts long, rev long, model string, intents array<struct<id:string, label:string, terms:array<string>, members:array<string>, centroid:array<double>, "
    "support:long, seeded_support:long, last_ts:long, tools:map<string,double>, skills:map<string,double>>>"
)


def parse_graphs(raw: DataFrame, column: str = "json") -> DataFrame:
    """raw with graph (null if it isn't one) and problems, an array of the rules it breaks; a last_ts of 0 becomes built_from_ts."""
    parsed = raw.withColumn("graph", F.from_json(column, GRAPH))
    g = F.col("graph")
    intents = F.coalesce(g["intents"], F.array().cast(parsed.schema["graph"].dataType["intents"].dataType))
    some = lambda rule: F.exists(intents, rule)
    weights = lambda i: F.concat(F.coalesce(F.map_values(i["tools"]), F.array().cast("array<double>")), F.coalesce(F.map_values(i["skills"]), F.array().cast("array<double>")))
    rules = (
        ("malformed", g.isNull() | g["v"].isNull()),
        ("unknown-version", g["v"] != GRAPH_VERSION),
        ("rev-negative", g["rev"] < 0),
        ("duplicate-intent-id", F.size(F.array_distinct(F.transform(intents, lambda i: i["id"]))) < F.size(intents)),
        ("missing-members", some(lambda i: i["members"].isNull())),
        ("empty-members", some(lambda i: F.size(i["members"]) == 0)),
        ("support-zero", some(lambda i: F.coalesce(i["support"], F.lit(0)) < 1)),
        ("empty-centroid", some(lambda i: i["centroid"].isNotNull() & (F.size(i["centroid"]) == 0))),
        ("seeded-support-exceeds-support", some(lambda i: F.coalesce(i["seeded_support"], F.lit(0)) > i["support"])),
        ("negative-edge-weight", some(lambda i: F.exists(weights(i), lambda w: w <= 0))),
    )
    problems = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules)))
    dated = F.transform(intents, lambda i: i.withField("last_ts", F.when(F.coalesce(i["last_ts"], F.lit(0)) == 0, g["built_from_ts"]).otherwise(i["last_ts"])))
    return parsed.withColumn("problems", problems).withColumn("graph", F.when(g.isNotNull(), g.withField("intents", dated)))


def labelled(folded: DataFrame) -> DataFrame:
    """folded with the label (medoid) and the terms (class-based TF-IDF within the graph) of each cluster."""
    key = F.to_json(F.struct("graph_id", "intent_id"))
    members = folded.select("graph_id", key.alias("cluster"), F.explode("members").alias("text"))
    names = medoid(members.select("cluster", "text"))
    said = label_terms(members.select("graph_id", "cluster", "text"), within="graph_id").groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]).alias("terms"))
    return folded.withColumn("cluster", key).join(names, "cluster", "left").join(said, "cluster", "left").drop("cluster").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def serialise(folded: DataFrame) -> DataFrame:
    """(graph_id, json) of folded clusters, with labels and terms derived from what is written; null fields and a seeded support of 0 are left out. A graph is one document by its meaning."""
    seeded = F.when(F.col("seeded_support") > 0, F.col("seeded_support")).alias("seeded_support")
    intent = F.struct(F.col("intent_id").alias("id"), "label", "terms", "members", "centroid", "support", seeded, "last_ts", "tools", "skills")
    number = F.regexp_extract("intent_id", "([0-9]+)$", 1).cast("int")
    whole = labelled(folded).groupBy("graph_id").agg(F.max("built_from_ts").alias("built_from_ts"), F.max("rev").alias("rev"), F.max("model").alias("model"), F.array_sort(F.collect_list(F.struct(number.alias("n"), write_graphs(intent).alias("i")))).alias("intents"))
    head = write_graphs(F.struct(F.lit(GRAPH_VERSION).alias("v"), "built_from_ts", "rev", "model"))
    return whole.select("graph_id", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"intents":['), F.array_join(F.transform("intents", lambda x: x["i"]), ","), F.lit("]}")).alias("json"))


def write_graphs(column: Column | str = "graph") -> Column:
    """JSON of a graph struct; null fields are left out."""
    return F.to_json(column, {"ignoreNullFields": "true"})


class BaselineTurn:
    """One turn of a host that has no search, as the trace of one: its query with no results, then what it invoked.

    Nothing is recorded before the turn is done; a turn that fails records nothing, and done is done once.

        with BaselineTurn("book a flight", "s1", 10, 1_700_000_000_000) as turn:
            turn.invoked("tool", "flights__book")
        turn.rows"""

    def __init__(self, query: str, session: str, start_seq: int = 0, ts: int = 0) -> None:
        self.query, self.session, self.start, self.ts = query, session, start_seq, ts
        self._held: list[tuple[str, str]] = []
        self.rows: list[dict[str, object]] = []
        self._done = False

    def __enter__(self) -> BaselineTurn:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        if kind is None:
            self.done()
        self._done, self._held = True, []

    def invoked(self, kind: str, capability: str) -> BaselineTurn:
        if self._done:
            raise ValueError("the turn is over")
        self._held.append((kind, capability))
        return self

    def done(self) -> list[dict[str, object]]:
        if not self._done:
            types = [("search", None), *(("invoke_start" if kind == "tool" else "skill_invoke", c) for kind, c in self._held)]
            self.rows = [{"session": self.session, "log_seq": self.start + i, "type": t, "origin": "baseline", "query": None if i else self.query, "top_k": None if i else 0, "capability_id": c, "ts": self.ts} for i, (t, c) in enumerate(types)]
            self._done = True
        return self.rows


def baseline_events(turns: list[tuple[str, list[tuple[str, str]]]], session: str, start_seq: int = 0, ts: int = 0) -> list[dict[str, object]]:
    """Event rows of recorded baseline turns, one after another."""
    rows: list[dict[str, object]] = []
    for query, invoked in turns:
        turn = BaselineTurn(query, session, start_seq + len(rows), ts)
        for kind, capability in invoked:
            turn.invoked(kind, capability)
        rows += turn.done()
    return rows


def baseline_rows(turns: DataFrame) -> DataFrame:
    """Event rows (session, log_seq, type, origin, query, top_k, capability_id, ts) of baseline turns (session, turn, query, ts, invoked), in the order of turns; invoked is an array of (kind, capability). As baseline_events(), for many sessions."""
    one = F.array(F.struct(F.lit("search").alias("type"), F.col("query").alias("query"), F.lit(0).alias("top_k"), F.lit(None).cast("string").alias("capability_id")))
    each = F.transform(F.coalesce("invoked", F.array().cast("array<struct<kind:string,capability:string>>")), lambda i: F.struct(F.when(i["kind"] == "tool", "invoke_start").otherwise("skill_invoke").alias("type"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("int").alias("top_k"), i["capability"].alias("capability_id")))
    rows = turns.select("session", "turn", "ts", F.posexplode(F.concat(one, each)).alias("place", "e"))
    seq = F.row_number().over(Window.partitionBy("session").orderBy("turn", "place")) - 1
    return rows.select("session", seq.cast("long").alias("log_seq"), "e.type", F.lit("baseline").alias("origin"), "e.query", "e.top_k", "e.capability_id", "ts")


def observations_from(events: DataFrame, accepted: str | None = None) -> DataFrame:
    """The learner's observations from trace rows (session, log_seq, type, origin, query, capability_id, ts)."""
    roles = events.withColumn("role", classify(F.col("type"), F.col("origin"), accepted))
    return pair(roles)


def longest_idle_days() -> float:
    """Days of no use after which a cluster is evicted."""
    return _OLD_MS / 86_400_000

