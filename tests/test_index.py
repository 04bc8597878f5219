import random

import pandas as pd

from tidewright.operators import bm25, dense, learning
from tidewright.plans import inputs
from tidewright.streaming import traces


def test_written_index_answers_as_a_fresh_one(spark, small, tmp_path):
    fresh = bm25.build(inputs.documents(spark, small))
    written = fresh.write(str(tmp_path / "index"))
    rows = lambda i: sorted(map(tuple, bm25.search(i, inputs.asked(spark), 5).collect()))
    assert rows(fresh) == rows(written)


def test_a_task_returns_the_best_of_all_its_buckets(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BUCKET", 4)
    monkeypatch.setattr(bm25, "PRODUCTS", 8)
    docs = spark.createDataFrame([(i, f"common pear{i % 3} w{i}" + " common" * (i % 5)) for i in range(200)], "id long, text string")
    asked = spark.createDataFrame([(q, f"common pear{q % 3} w{q} w{q}") for q in range(7)], "query_id long, text string")
    index, parts = bm25.build(docs), []
    keep = bm25.top
    monkeypatch.setattr(bm25, "top", lambda hits, by, k: parts.append(hits) or keep(hits, by, k))
    whole = sorted(map(tuple, bm25.search(index, asked, 3).collect()))
    assert len(whole) == 7 * 3 and [r for r in whole if r[4] == 0] == [r for r in whole if r[2] == r[0]]
    tasks = parts[0].rdd.getNumPartitions()
    assert parts[0].count() <= 7 * 3 * tasks < 7 * 3 * 50  # there are 50 buckets
    monkeypatch.setattr(bm25, "GROUP", 2)
    assert sorted(map(tuple, bm25.search(index, asked, 3).collect())) == whole
    rows = index.postings.where("term is not null")
    assert rows.count() and rows.where("ids is not null or dls is not null").count() == 0  # a bucket names its entries once


def test_dense_groups_read_vectors_that_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(dense, "GROUP", 4)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    vecs = [(i, [float(i % 3), float(i % 7), 1.0]) for i in range(200)]  # many equal scores
    vectors = spark.createDataFrame(vecs, "id long, vec array<double>").mapInArrow(counted, "id long, vec array<double>")
    queries = [(q, [1.0, float(q % 5) - 2.0, 0.5]) for q in range(20)]
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in dense.search(vectors, spark.createDataFrame(queries, "query_id long, qvec array<double>"), 3).collect()}
    assert made.value == 200
    wanted = {}
    for q, a in queries:
        best = sorted((-round(sum(x * y for x, y in zip(a, v, strict=True)), 6), i) for i, v in vecs)[:3]
        wanted |= {(q, n): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == wanted


def test_a_query_that_is_a_member_scores_no_other():
    f = learning.Assigner()
    for i in range(30):
        f.take(f"topic {i}", i)
    scored = []

    class Bag(dict):
        def values(self):
            scored.append(len(self))
            return super().values()

    f.bags = {w: Bag(b) for w, b in f.bags.items()}
    assert [f.take(f"Topic {i}!", 40)[0].name for i in (3, 29)] == ["intent_4", "intent_30"] and not scored
    f.take("topic other", 50)
    assert scored  # a new text is held against those that share a rare word
    f._unlist(f.alive[3], "topic 3")
    f._unlist(f.alive[3], "Topic 3!")
    assert f.take("topic 3", 60)[1]


def test_sessions_of_a_bucket_are_paired_in_one_call():
    rng = random.Random(5)
    names = {"search": "search", "tool": "tool", "skill": "skill"}
    log = [(f"s{rng.randrange(9)}", i, rng.choice(list(names)), rng.choice([f"q{i}", None]), f"c{i}", i * 10) for i in range(300)]

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, got = State(), []
    for a in (0, 2, 100, 101, 230):  # batches of one bucket; rows of a batch come in any order, in two frames
        part = log[a : {0: 2, 2: 100, 100: 101, 101: 230, 230: 300}[a]]
        rng.shuffle(part)
        frames = [pd.DataFrame(p, columns=["session", "log_seq", "role", "query", "capability_id", "ts"]) for p in (part[:1], part[1:]) if p]
        got += [tuple(r) for f in traces._pair((3,), iter(frames), state) for r in f.itertuples(index=False)]
    last, wanted = {}, []
    for session, seq, role, query, capability, ts in log:
        if role == "search":
            last[session] = [seq, query or "", True]
        elif session in last:
            wanted.append((session, seq, role, capability, ts, *last[session]))
            last[session][2] = False
    assert sorted(got, key=lambda r: r[1]) == wanted and len(state.get[0]) == len(last)
