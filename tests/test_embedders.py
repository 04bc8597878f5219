import numpy as np
import pytest

from tidewright.functions.stemmer import analyse, stem
from tidewright.operators import bm25, dense
from tidewright.functions.stemmer import english_tokens
from tidewright.sources import embedders as E


def test_spec_rules():
    for wrong in ({}, {"local": "a", "url": "b"}, {"local": " "}, {"url": "u", "pooling": "cls"}, {"local": "a", "pooling": "max"}, {"local": "a", "model": "m"}):
        with pytest.raises(E.EmbeddingError):
            E.Spec(**wrong)
    a, b = E.Spec(local="m"), E.Spec(local="m", query_prefix="q: ")
    assert a.fingerprint != b.fingerprint and b.for_query("x") == "q: x" and b.for_doc("x") == "x"


def test_endpoint_answers_are_checked():
    ok = {"data": [{"index": 1, "embedding": [0.0, 2.0]}, {"index": 0, "embedding": [3.0, 4.0]}]}
    assert E.endpoint_vectors(ok, 2) == [[0.6, 0.8], [0.0, 1.0]]
    for wrong in ({}, {"data": ok["data"][:1]}, {"data": [ok["data"][0]] * 2}, {"data": [{"index": 5, "embedding": [1.0]}]}, {"data": [{"index": 0, "embedding": [0.0]}, {"index": 1, "embedding": [1.0]}]}, {"data": [{"index": 0, "embedding": [1.0]}, {"index": 1, "embedding": [1.0, 2.0]}]}):
        with pytest.raises(E.EmbeddingError):
            E.endpoint_vectors(wrong, 2)
    sizes = []
    E.endpoint(lambda texts: sizes.append(len(texts)) or {"data": [{"index": i, "embedding": [1.0]} for i in range(len(texts))]})(["x"] * 130)
    assert sizes == [64, 64, 2]


def test_pooling():
    hidden, mask = np.array([[[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]]]), np.array([[1, 1, 0]])
    assert np.allclose(E.pooled(hidden, mask), [[0.5**0.5, 0.5**0.5]])
    assert np.allclose(E.pooled(hidden, mask, "cls"), [[1, 0]])


def test_texts_are_cut_and_padded():
    given = []

    def forward(ids, mask):
        given.append((ids.tolist(), mask.tolist()))
        return np.stack([ids, mask], axis=-1).astype(float)

    model = E.encoder_model(lambda texts: [[len(t)] * len(t) for t in texts], forward, "mean", 3)
    got = model(["ab", "abcdef"])
    assert given == [([[2, 2, 0], [6, 6, 6]], [[1, 1, 0], [1, 1, 1]])]
    assert np.allclose(got, [np.array([2, 1]) / 5**0.5, np.array([6, 1]) / 37**0.5])
    assert E.Spec(spec=E.DEFAULT).for_query("x").endswith(": x") and E.Spec(local="m").for_query("x") == "x" and E.Spec(spec=E.DEFAULT).for_doc("x") == "x"


def test_load_once_and_again_after_failure():
    seen = E.Loaded()
    with pytest.raises(RuntimeError):
        seen.get("m", lambda: (_ for _ in ()).throw(RuntimeError()))
    first = seen.get("m", lambda: (lambda t: []))
    assert seen.get("m", lambda: 1 / 0) is first and [e["status"] for e in seen.events] == ["failed", "ok"]


def test_extend_embeds_what_is_missing(spark):
    corpus = spark.createDataFrame([(1, "read a file"), (2, "send mail"), (3, None)], "id long, text string")
    vectors = spark.createDataFrame([(1, [1.0] + [0.0] * 63)], "id long, vec array<float>")
    whole = dense.extend(corpus, vectors, lambda some: E.embed(some, E.hashing, "hashing"))
    assert {r["id"] for r in whole.collect()} == {1, 2, 3}
    assert dense.validate(whole).first()["n_not_unit"] == 0


def test_stems():
    pairs = {"consistency": "consist", "knackeries": "knackeri", "running": "run", "hoping": "hope", "relational": "relat", "flies": "fli", "dying": "die", "agreed": "agre", "luxuriating": "luxuri", "generously": "generous", "kiwis": "kiwi", "bed": "bed", "apologies": "apolog"}
    assert {w: stem(w) for w in pairs} == pairs
    assert analyse("The Files’ readers are reading") == ["file", "reader", "read"] or analyse("The Files’ readers are reading")[1:] == ["reader", "read"]


def test_stemmed_search(spark):
    docs = spark.createDataFrame([(1, "Reads the file from disk"), (2, "Sends a mail")], "id long, text string")
    q = spark.createDataFrame([("q", "reading files")], "query_id string, text string")
    assert [r["id"] for r in bm25.search(bm25.build(docs, english_tokens), q, 5, english_tokens).collect()] == [1]
