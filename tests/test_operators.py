"""Rules of the operators that the queries don't show."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import schema_walk, text
from tidewright.operators import catalog, dense, experiments, learning, ranking, search, usage
from tidewright.sources import artifact, mcp, tracelog


def test_split_identifier(spark):
    names = ["HTTPServer", "parseHTTP", "a_B", "read-file", "getUserId", "snake_case", ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(text.split_identifier(F.col("s"))).collect()]
    assert got == ["HTTPServer", "parse HTTP", "a B", "read-file", "get User Id", "snake case", ""]


def test_schema_walk_keeps_order():
    schema = {"properties": {"b": {"description": "x", "enum": ["p", 1]}, "aB": {"items": {"properties": {"c_d": {}}}}}, "anyOf": [{"properties": {"no": {}}}]}
    assert schema_walk.walk(schema) == ["b", "x", "p", "aB", "a B", "c_d", "c d"]


def test_canonical_json():
    assert schema_walk.canonical('{"b": 1.0, "a": [true, null, "é\\n"]}') == '{"a":[true,null,"é\\n"],"b":1}'
    assert schema_walk.canonical("{") is None
    assert schema_walk.canonical(json.dumps({"x": 2**60})) is None


def test_rrf_counts_ranks_from_zero(spark):
    a = spark.createDataFrame([("q", "x", 0), ("q", "y", 1)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 0), ("q", "z", 1)], "query_id string, id string, rank int")
    got = {r["id"]: r["score"] for r in ranking.fuse([(a, 1.0), (b, 0.0)], ["query_id"]).collect()}
    assert got == {"x": 1 / 60, "y": 1 / 61, "z": 0.0}


def test_not_a_number_is_not_ranked(spark):
    hits = spark.createDataFrame([("q", "a", 1.0), ("q", "b", float("nan")), ("q", "c", 1.0)], "query_id string, id string, score double")
    assert [(r["id"], r["rank"]) for r in ranking.top(hits, ["query_id"], 5).orderBy("rank").collect()] == [("a", 0), ("c", 1)]


@pytest.mark.parametrize(("k", "want"), [(None, 5), (True, 5), (0, 5), (-1, 5), ("3", 5), (3, 3), (99, 50)])
def test_clamp(k, want):
    assert ranking.clamp_k(k, 5) == want


def test_methods(spark):
    assert search.method_of("Dense") == "semantic"
    with pytest.raises(ValueError):
        search.method_of("magic")
    q = spark.createDataFrame([("q", "x")], "query_id string, text string")
    assert search.search("hybrid", 0, q).count() == 0


def test_missing_vectors_are_an_error(spark):
    corpus, vectors = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, [1.0])], "id long, vec array<float>")
    with pytest.raises(dense.EmbeddingsNotBuilt):
        dense.require_built(corpus, vectors)
    dense.require_built(corpus.where("id = 1"), vectors)


def test_recency_and_eviction():
    assert math.isclose(learning.longest_idle_days(), 90 + 90 * math.log2(100))


def test_assigner_members_and_numbers():
    f = learning.Assigner()
    for i in range(60):
        f.take(f"deploy service number{i}", i)
    assert len(f.alive) == 1 and list(f.alive[0].members) == [f"deploy service number{i}" for i in range(10, 60)]
    assert f.take("deploy service number59", 61)[1] is False
    assert f.take("the of", 99) is None and f.taken == 61  # no words and no vector: nothing happened
    f.take("entirely other words", usage.GRACE_MS * 20)
    assert [c.name for c in f.alive] == ["intent_2"] and set(f.bags) == {"entirely", "other", "words"}  # the first has decayed


def test_vectors_freeze_on_another_model():
    f = learning.Assigner()
    f.take("a1", 1, np.array([1.0, 0.0]), "m")
    f.take("a2", 2, np.array([0.8, 0.6]), "m")
    assert len(f.alive) == 1 and f.alive[0].folded == 2
    before = f.alive[0].centroid.copy()
    f.take("a1 again", 3, np.array([0.0, 1.0]), "other")
    assert (f.alive[0].centroid == before).all() and f.model == "m"


def brute_graph(rows):
    """The rules of a graph, one by one over plain lists: every cluster remembers all that it took."""
    clusters, model, newest, rev = [], None, 0, 0
    words = lambda t: {w for w in text_words(t)}
    for r in rows:
        w, v = words(r["query"]), r["vec"]
        if v is None and not w:
            continue
        rev, newest = rev + 1, max(newest, r["ts"])
        if v is not None and model is not None and r["model"] is not None and model != r["model"]:
            v = None
        rated = []
        if v is not None:
            for c in clusters:
                if c["centroid"] is not None and len(c["centroid"]) == len(v):
                    cosine = sum(x * y for x, y in zip(c["centroid"], v)) / math.sqrt(sum(x * x for x in v) * sum(x * x for x in c["centroid"]))
                    if cosine >= 0.7:
                        rated.append((-round(cosine, 12), f"intent_{c['n']}", c))
        if not rated and w:
            for c in clusters:
                best = max((len(w & words(m)) / len(w | words(m)) for m in c["members"] if words(m)), default=0)
                if best >= 0.5:
                    rated.append((-best, f"intent_{c['n']}", c))
        if rated:
            c = min(rated, key=lambda x: x[:2])[2]
        else:
            c = {"n": max((x["n"] for x in clusters), default=0) + 1, "members": [], "centroid": None, "k": 0, "took": []}
            clusters.append(c)
        if r["query"] not in c["members"]:
            c["members"] = [*c["members"], r["query"]][-50:]
            if v is not None:
                same = c["centroid"] is not None and len(c["centroid"]) == len(v)
                total = [x * c["k"] + y for x, y in zip(c["centroid"], v)] if same else v
                length = math.sqrt(sum(x * x for x in total)) or 1.0
                c["centroid"], c["k"] = [x / length for x in total], c["k"] + 1 if same else 1
        c["took"].append(r)
        if model is None and c["centroid"] is not None:
            model = r["model"]
        day = 86_400_000
        clusters = [c for c in clusters if (idle := newest - max(t["ts"] for t in c["took"])) <= 90 * day or 2 ** (-(idle - 90 * day) / (90 * day)) >= 0.01]
    made = {}
    for c in clusters:
        counted = [t for i, t in enumerate(c["took"]) if t["first_confirmation"] or i == 0]
        weights = {}
        for t in c["took"]:
            weights[t["kind"], t["capability_id"]] = weights.get((t["kind"], t["capability_id"]), 0) + 1
        made[f"intent_{c['n']}"] = (rev, newest, model, c["members"], c["centroid"] and [round(x, 9) for x in c["centroid"]], len(counted), sum(bool(t["seeded"]) for t in counted), max(t["ts"] for t in c["took"]), weights)
    return made


def text_words(t):
    from tidewright.functions.text import STOPWORDS

    found, run = [], ""
    for ch in t + " ":
        if ch.isalnum():
            run += ch
        elif run:
            found.append(run.lower())
            run = ""
    return [w for w in found if w not in STOPWORDS]


def test_fold_equals_brute_force(spark):
    """Graphs with vectors of two widths and two models, ageing clusters, more than fifty members, and queries without words."""
    rng = random.Random(12)
    day, rows = 86_400_000, []
    for graph in ("g1", "g2", "g3", "g4"):
        ts = 1000
        for i in range(260):
            ts += rng.choice((1, day, 5 * day)) if graph != "g3" else 1
            topic = rng.randrange(8)
            query = rng.choice((f"topic{topic} alpha beta", f"topic{topic} alpha w{rng.randrange(90)}", f"Topic{topic} w{rng.randrange(4)}", "the of", f"topic{topic}"))
            vec = None
            if graph in ("g2", "g4") and rng.random() < 0.6:
                width = 3 if rng.random() < 0.9 else 2
                vec = [float(rng.choice((0.1, 0.5, 1.0, -0.4)) + (j == topic % width)) for j in range(width)]
            rows.append((graph, i, query, rng.choice(("tool", "skill")), f"c{rng.randrange(4)}", ts + rng.randrange(3), rng.random() < 0.5, rng.random() < 0.3, vec, None if vec is None else rng.choice(("m", "m", "other")) if graph == "g4" else "m"))
    columns = "graph_id string, log_seq long, query string, kind string, capability_id string, ts long, first_confirmation boolean, seeded boolean, vec array<double>, model string"
    frame = spark.createDataFrame(rows, columns).repartition(3)
    names = [c.split()[0] for c in columns.split(", ")]
    for graph in ("g1", "g2", "g3", "g4"):
        want = brute_graph([dict(zip(names, r, strict=True)) for r in rows if r[0] == graph])
        got = {}
        for r in learning.fold(frame.where(F.col("graph_id") == graph)).collect():
            weights = {("tool", k): v for k, v in r["tools"].items()} | {("skill", k): v for k, v in r["skills"].items()}
            got[r["intent_id"]] = (r["rev"], r["built_from_ts"], r["model"], r["members"], r["centroid"] and [round(x, 9) for x in r["centroid"]], r["support"], r["seeded_support"], r["last_ts"], weights)
        assert got == want


def test_graph_query_equals_brute_force(spark, small):
    from tidewright.plans import PLANS
    from tidewright.plans.usage import graph_observations

    rows = [r.asDict() for r in graph_observations(spark, small).orderBy("log_seq").collect()]
    want = {}
    for graph in {r["graph_id"] for r in rows}:
        for name, (rev, _, model, members, centroid, support, seeded, last, weights) in brute_graph([r for r in rows if r["graph_id"] == graph]).items():
            told = [json.dumps({c: float(n) for (k, c), n in sorted(weights.items()) if k == kind}, separators=(",", ":")) for kind in ("tool", "skill")]
            want[graph, name] = ("|".join(members), support, seeded, last, rev, model, None if centroid is None else sum(centroid), *told)
    got = {(r["graph_id"], r["intent_id"]): (r["members"], r["support"], r["seeded_support"], r["last_ts"], r["rev"], r["model"], r["centroid"], r["tools"], r["skills"]) for r in PLANS["graph_fold"][0](spark, small).collect()}
    assert got.keys() == want.keys() and sum(x[6] is not None for x in want.values()) > 10
    for k, found in got.items():
        assert found[:6] + found[7:] == want[k][:6] + want[k][7:]
        assert (found[6] is None) == (want[k][6] is None) and (found[6] is None or abs(found[6] - want[k][6]) < 1e-5)


def test_graph_is_written_and_parsed(spark):
    rows = [("g", i, f"topic{i % 3} word{i % 2}", "tool", f"t{i % 4}", 10 + i, True) for i in range(12)]
    frame = spark.createDataFrame(rows, "graph_id string, log_seq long, query string, kind string, capability_id string, ts long, first_confirmation boolean")
    made = learning.serialise(learning.fold(frame))
    found = json.loads(made.first()["json"])
    assert found["v"] == 1 and [i["id"] for i in found["intents"]] == [f"intent_{n}" for n in range(1, 7)]
    assert all(i["label"] in i["members"] and i["terms"] and "seeded_support" not in i and "centroid" not in i for i in found["intents"])
    assert learning.parse_graphs(made).select("problems").first()["problems"] == []


def test_baseline_turns():
    with learning.BaselineTurn("find it", "s", 5, 9) as turn:
        turn.invoked("tool", "t").invoked("skill", "k")
    assert [(r["log_seq"], r["type"], r["query"], r["capability_id"]) for r in turn.rows] == [(5, "search", "find it", None), (6, "invoke_start", None, "t"), (7, "skill_invoke", None, "k")]
    assert turn.done() is turn.rows
    with pytest.raises(ValueError):
        turn.invoked("tool", "late")
    with pytest.raises(KeyError), learning.BaselineTurn("x", "s") as failed:
        failed.invoked("tool", "t")
        raise KeyError
    assert failed.rows == [] and failed.done() == []
    assert [r["log_seq"] for r in learning.baseline_events([("a", [("tool", "t")]), ("b", [])], "s")] == [0, 1, 2]


def test_interleaved_sessions_never_pair_across(spark):
    events = [("a", 1, "search", "x"), ("b", 2, "search", "y"), ("a", 3, "invoke_start", None), ("b", 4, "invoke_start", None), ("a", 5, "search", "x"), ("a", 6, "invoke_start", None), ("c", 7, "invoke_start", None)]
    rows = spark.createDataFrame([(s, n, t, "agent", q, "tool", n) for s, n, t, q in events], "session string, log_seq long, type string, origin string, query string, capability_id string, ts long")
    got = {r["log_seq"]: (r["query"], r["first_confirmation"]) for r in learning.observations_from(rows).collect()}
    assert got == {3: ("x", True), 4: ("y", True), 6: ("x", True)}


def test_artifact_is_checked():
    entries = [("tool", "a", b"h" * 32, [1.0, 0.0]), ("fact", "b", b"g" * 32, [0.6, 0.8])]
    data = artifact.encode(entries, 2, "m")
    assert artifact.decode(data)[3][0] == entries[0]
    for spoilt in (data[:-1], data + b"x", b"XXXX" + data[4:], data[:60] + b"\xff" + data[61:], data[:10], data[:4] + b"\x09" + data[5:]):
        with pytest.raises(artifact.ArtifactError):
            artifact.decode(spoilt)
    with pytest.raises(artifact.ArtifactError):
        artifact.encode([("tool", "a", b"h" * 32, [2.0, 0.0])], 2, "m")


def test_artifact_files_are_read(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(artifact.encode([("tool", "a", b"h" * 32, [1.0, 0.0])], 2, "m"))
    (tmp_path / "b.bin").write_bytes(artifact.encode([], 0, "m"))
    assert [(r["id"], r["dim"], r["vec"]) for r in artifact.read(spark, str(tmp_path)).collect()] == [("a", 2, [1.0, 0.0])]


def test_artifacts_are_merged(spark):
    part = lambda ids, dim=2, model="m": spark.createDataFrame([("tool", i, b"h", [0.0] * dim, dim, model, 1) for i in ids], "kind string, id string, hash binary, vec array<double>, dim int, model string, projection_version int")
    assert artifact.merge([part("ab"), part(""), part("c")]).count() == 3
    for wrong in (part("ax"), part("z", 3), part("z", 2, "other")):
        with pytest.raises(artifact.ArtifactError):
            artifact.merge([part("ab"), wrong])


def test_pages():
    made = {None: {"nextCursor": ""}, "": {"nextCursor": "b"}, "b": {}}
    assert len(mcp.pages(made.__getitem__)) == 3
    with pytest.raises(ValueError):
        mcp.pages(lambda c: {"nextCursor": "same"})


def test_trace_lines(spark):
    lines = spark.createDataFrame([(1, '{"type":"search","hits":[{"tool_id":"t","score":1.5}]}'), (2, "  "), (3, "{")], "log_seq long, value string")
    good = tracelog.parse(lines.where("log_seq < 3")).collect()
    assert len(good) == 1 and good[0]["hits"][0]["id"] == "t"
    with pytest.raises(Exception, match="(?i)malformed"):
        tracelog.parse(lines).collect()
    assert tracelog.parse(lines, strict=False).count() == 1
    assert len(tracelog.ulid()) == 26


def test_admission_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(e, n, (start := rng.randrange(300)), start + rng.randrange(1, 60)) for e in range(3) for n in range(80)]
    frame = spark.createDataFrame(rows, "experiment_id long, seq long, start_ms long, end_ms long")
    for places in (1, 3):
        want = {}
        for e in range(3):
            taken = []
            for _, n, start, end in sorted((r for r in rows if r[0] == e), key=lambda r: (r[2], r[1])):
                want[e, n] = sum(a <= start < b for a, b in taken) < places
                if want[e, n]:
                    taken.append((start, end))
        assert {(r["experiment_id"], r["seq"]): r["admitted"] for r in experiments.admit_shadows(frame, places).collect()} == want


def test_warmups_are_tried_again(spark):
    calls = [("a", 0, 0, 10, True), ("a", 1, 5, 10, False), ("a", 2, 10, 10, False), ("a", 3, 15, 10, False), ("a", 4, 20, 10, False), ("b", 0, 0, 1, False)]
    got = {(r["arm"], r["seq"]): (r["runs"], r["cold"]) for r in experiments.warmups(spark.createDataFrame(calls, "arm string, seq long, at_ms long, took_ms long, failed boolean")).collect()}
    assert got == {("a", 0): (True, True), ("a", 1): (False, True), ("a", 2): (True, True), ("a", 3): (False, True), ("a", 4): (False, False), ("b", 0): (True, True)}


def test_draw_is_the_big_integer_modulo(spark):
    import hashlib

    units = [f"u{i}" for i in range(50)]
    got = spark.createDataFrame([(u,) for u in units], "u string").select(experiments.draw(F.lit("e"), F.col("u"), 97)).collect()
    want = [int(hashlib.sha256(json.dumps(["e", u], separators=(",", ":")).encode()).hexdigest(), 16) % 97 for u in units]
    assert [r[0] for r in got] == want


def test_split_is_validated():
    assert experiments.validate_split(["a", "b"], [("a", 1), ("b", 2)]) == []
    assert experiments.validate_split(["a", "b"], [("a", -1), ("a", 1), ("c", 1)]) == ["unknown arm c", "arm b missing", "arm a repeated", "weight of a"]
    assert experiments.validate_split(["a", "b"], [("a", 0), ("b", 2)]) == [] and experiments.validate_split(["a"], [("a", 0)]) == ["total weight"]


def test_config_is_validated():
    sound = {"arms": ["a", "b"], "fallback": "a", "split": [("a", 1), ("b", 1)], "evaluation": {"k": 5, "references": ["peer-selection", {"kind": "invocation", "last": 3}]}}
    assert experiments.validate_config(sound) == []
    bad = {"arms": ["a"], "fallback": "z", "concurrency": 0, "evaluation": {"k": True, "references": ["peer-selection", "peer-selection", "x", {"kind": "invocation"}, {"kind": "invocation", "last": 99, "max_age_ms": 0}]}}
    assert experiments.validate_config(bad) == ["unknown fallback arm", "concurrency", "k", "reference x", "peer-selection repeated", "invocation repeated", "an invocation needs a window", "last", "max_age_ms"]
    assert experiments.validate_config({}) == ["no arms", "no references"]


def test_drop_reasons(spark):
    names = ("arm-failed", "selection-failed", "fallback-consumed", "served-ranking-failed", "comparison-failed")
    flags = [tuple(j == i or j > i + 1 for j in range(5)) for i in range(6)]
    frame = spark.createDataFrame(flags, ", ".join(f"f{i} boolean" for i in range(5)))
    assert [r[0] for r in frame.select(experiments.drop_reason(*(F.col(f"f{i}") for i in range(5)))).collect()] == [*names, None]


def test_lone_ends_take_nothing(spark):
    """A queue for each tool: early ends, more starts than may wait, and ends that are given a start's name."""
    rng = random.Random(7)
    rows = [("s", f"t{rng.randrange(2)}", n, rng.choice(("invoke_start", "invoke_end", "invoke_error", "search")), None if rng.random() < 0.8 else rng.choice((f"given{n}", str(max(0, n - 2))))) for n in range(400)]
    rows += [("s", "many", 1000 + n, "invoke_start" if n < 1030 else "invoke_end", None) for n in range(1040)]
    want, waiting = {}, {}
    for s, t, n, kind, given in rows:
        queue = waiting.setdefault((s, t), [])
        if kind == "search":
            want[n] = given
        elif kind == "invoke_start":
            want[n] = given or str(n)
            if given is None:
                queue.append(str(n))
                del queue[:-1024]
        elif given is not None:
            want[n] = given
            waiting[s, t] = [q for q in queue if q != given]
        else:
            want[n] = queue.pop(0) if queue else str(n)
    frame = spark.createDataFrame(rows, "source_id string, tool_id string, log_seq long, type string, invocation_id string").repartition(4)
    assert {r["log_seq"]: r["invocation"] for r in tracelog.correlate(frame).collect()} == want


def test_events_are_sanitised():
    from tidewright.sources import sanitise as s

    small = {"v": 2, "type": "search", "query": "é" * 3000, "hits": list(range(200)), "deep": {str(i): i for i in range(150)}}
    got = s.sanitise(small)
    assert got["query"] == "é" * 2048 and got["hits"] == list(range(100)) and len(got["deep"]) == 100 and s.CUT not in got
    envelope = {k: "e" for k in s.ENVELOPE} | {"type": "catalog_definition"}
    big = [["x" * 4000] * 9 for _ in range(2)]
    schemas = envelope | {"id": "i", "name": "n", "kind": "tool", "content_hash": "h", "input_schema": big, "output_schema": big[:1]}
    got = s.sanitise(schemas)
    assert "input_schema" not in got and "output_schema" in got and got[s.CUT] is True
    noise = envelope | {"noise": [["x" * 4000] * 9] * 2, "also": "y", "took_ms": 5}
    assert s.sanitise(noise) == envelope | {"also": "y", "took_ms": 5, s.CUT: True}
    stuffed = envelope | {f"{i}_id": ["z" * 4000] * 5 for i in range(9)} | {"id": "i" * 4000}
    got = s.sanitise(stuffed)
    assert s.size_of(got) <= 65_536 and got["id"] == "i" * 512 and got["0_id"] == ["z" * 512] * 5


def test_events_are_written_out_once(monkeypatch):
    from tidewright.sources import sanitise as s

    written, keep = [], s.json.dumps
    monkeypatch.setattr(s.json, "dumps", lambda *a, **b: written.append(0) or keep(*a, **b))
    envelope = {k: "e" for k in s.ENVELOPE}
    for junk, texts in ((9, 1), (40, 1)):  # the second is too long by its characters alone
        event, _ = envelope | {"junk": ["j" * 4000] * junk, "query": "q"}, written.clear()
        got = s._column(keep(event))
        assert s.json.loads(got) == (event if junk == 9 else envelope | {"query": "q", s.CUT: True}) and len(written) == texts
    odd = envelope | {"query": "é\x7f\ud83d\ude00", "junk": ["\x7f" * 4000] * 3}  # 72,000 bytes when escaped
    assert s.json.loads(s._column(keep(odd))) == envelope | {"query": odd["query"].encode("utf-16", "surrogatepass").decode("utf-16"), s.CUT: True}


def test_another_model_is_refused(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>")
    q = lambda n: spark.createDataFrame([("q", "x", [1.0] * n)], "query_id string, text string, qvec array<double>")
    assert search.search("semantic", 1, q(2), None, vectors, model="m", built_with="m").count() == 1
    with pytest.raises(dense.ModelMismatch):
        search.search("semantic", 1, q(2), None, vectors, model="m", built_with="other")
    with pytest.raises(dense.ModelMismatch):
        search.search("semantic", 1, q(3), None, vectors)


def test_kept_index_follows_its_corpus(spark):
    from tidewright.operators import bm25

    q = spark.createDataFrame([("q", "apple")], "query_id string, text string")
    corpus = lambda t: spark.createDataFrame([(1, "apple pie"), (2, t)], "id long, text string")
    hits = lambda c: [r["id"] for r in bm25.search(bm25.kept(c), q, 5).orderBy("rank").collect()]
    assert hits(corpus("pear")) == [1] and hits(corpus("apple")) == [2, 1] and hits(corpus("pear")) == [1]
    assert bm25.content_key(corpus("pear"), "usage") == bm25.content_key(corpus("pear").repartition(2), "usage")


def test_files_are_read_in_order(spark, tmp_path):
    for name, n in (("b", 3), ("a", 50_000), ("c", 20)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"type":"search","query":"{name}{i}"}}\n' for i in range(n)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        got = [r["query"] for r in tracelog.read(spark, str(tmp_path)).orderBy("log_seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [f"a{i}" for i in range(50_000)] + [f"b{i}" for i in range(3)] + [f"c{i}" for i in range(20)]


def test_learner_forwards_what_it_learns_from(spark, tmp_path):
    from tidewright.streaming import traces

    rows = [("s", 1, "search", "q", None, 1, "search"), ("s", 2, "tool", None, "t", 2, "invoke_start"), ("s", 3, None, None, "t", 3, "invoke_end")]
    frame = spark.createDataFrame(rows, "session string, log_seq long, role string, query string, capability_id string, ts long, type string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    for run in traces.learn_and_forward(stream, f"{tmp_path}/learned", f"{tmp_path}/forwarded", f"{tmp_path}/state"):
        run.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/forwarded").count() == 3
    assert [(r["capability_id"], r["query"]) for r in spark.read.parquet(f"{tmp_path}/learned").collect()] == [("t", "q")]


def test_sinks_all_see_every_batch(spark, tmp_path):
    from tidewright.streaming import traces

    spark.range(10).write.parquet(f"{tmp_path}/in")
    seen = ([], [])
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    traces.fan_out(stream, [lambda b, n, s=s: s.extend(r["id"] for r in b.collect()) for s in seen], f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen[0]) == sorted(seen[1]) == list(range(10))


def test_replace_counts_add_up(spark):
    rng = random.Random(3)
    old, new = {i: rng.randint(0, 2) for i in rng.sample(range(40), 20)}, {i: rng.randint(0, 2) for i in rng.sample(range(40), 20)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, v long")
    got = {r["id"]: r["status"] for r in catalog.replace_all(frame(old), frame(new), ["v"]).collect()}
    want = {i: "added" if i not in old else "removed" if i not in new else "unchanged" if old[i] == new[i] else "updated" for i in old.keys() | new.keys()}
    assert got == want


def test_streams_equal_batches(spark, tmp_path):
    from tidewright.streaming import traces

    rows = [("s", "t", n, "invoke_start" if n % 3 else "invoke_end", None if n % 5 else f"given{n}") for n in range(1, 30)]
    frame = spark.createDataFrame(rows, "source_id string, tool_id string, log_seq long, type string, invocation_id string")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    run = traces.correlated(stream).writeStream.format("memory").queryName("correlated").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["log_seq"]: r["invocation"] for r in spark.table("correlated").collect()}
    assert got == {r["log_seq"]: r["invocation"] for r in tracelog.correlate(frame).collect()}
