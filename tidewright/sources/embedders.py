"""Embedders: texts to unit vectors in Arrow batches, from a local function, an endpoint, or hashing; with the checks of what they return."""

from __future__ import annotations

import contextlib
import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Inputs of one request, seconds it may take, bytes of an answer, and what counts as a slow load.
ENDPOINT_BATCH, ENDPOINT_TIMEOUT, MOST_RESPONSE, SLOW_LOAD = 64, 30, 64 << 20, 5.0
#: Documents that a local model is given at once.
LOCAL_BATCH = 32
SOURCES = ("spec", "huggingface", "local", "ollama", "url")
#: The name of the built-in model, and what its queries begin with. Other models have prefixes of their own, or none.
DEFAULT, DEFAULT_QUERY_PREFIX = "default", "Represent this sentence for searching relevant passages: "
#: Tokens that a local model takes at most.
MOST_TOKENS = 512


class EmbeddingError(ValueError):
    pass


@dataclass(frozen=True)
class Spec:
    """Where vectors come from: exactly one source; blank fields and fields that don't go with the source are errors."""

    spec: str | None = None
    huggingface: str | None = None
    local: str | None = None
    ollama: str | None = None
    url: str | None = None
    model: str | None = None
    pooling: str | None = None
    query_prefix: str | None = None
    doc_prefix: str | None = None

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if value is not None and not value.strip() and not name.endswith("prefix"):
                raise EmbeddingError(f"{name} is blank")
        if len(given := [s for s in SOURCES if getattr(self, s) is not None]) != 1:
            raise EmbeddingError(f"one of {', '.join(SOURCES)} is asked for; there are {len(given)}")
        if self.pooling is not None and given[0] in ("ollama", "url"):
            raise EmbeddingError("an endpoint does its own pooling")
        if self.pooling not in (None, "cls", "mean"):
            raise EmbeddingError(f"no pooling {self.pooling!r}")
        if self.model is not None and given[0] not in ("ollama", "url"):
            raise EmbeddingError("model goes with an endpoint")

    @property
    def kind(self) -> str:
        return next(s for s in SOURCES if getattr(self, s) is not None)

    @property
    def fingerprint(self) -> str:
        """Vectors of one fingerprint can be compared."""
        parts = [self.kind, getattr(self, self.kind), self.model or "", self.pooling or "", self.query_prefix or "", self.doc_prefix or ""]
        return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()

    def for_query(self, text: str) -> str:
        own = DEFAULT_QUERY_PREFIX if self.spec == DEFAULT else ""
        return (own if self.query_prefix is None else self.query_prefix) + text

    def for_doc(self, text: str) -> str:
        return (self.doc_prefix or "") + text


def pooling_of(folder: str) -> str:
    """Pooling that a model folder asks for: cls if its configuration says so and not mean, else mean."""
    at = Path(folder, "1_Pooling", "config.json")
    made = json.loads(at.read_text()) if at.exists() else {}
    return "cls" if made.get("pooling_mode_cls_token") and not made.get("pooling_mode_mean_tokens") else "mean"


def pooled(hidden: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """Unit vectors of token vectors (texts, tokens, width) under a mask."""
    if how == "cls":
        vec = hidden[:, 0]
    else:
        vec = (hidden * mask[..., None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)
    return vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)


def encoder_model(encode: Callable[[list[str]], list[list[int]]], forward: Callable[[np.ndarray, np.ndarray], np.ndarray], how: str = "mean", most: int = MOST_TOKENS) -> Callable[[list[str]], list[list[float]]]:
    """An embedder of a token encoder and a forward pass (ids, mask) -> token vectors: texts are cut at the model's limit, padded to the batch's longest, pooled and scaled."""

    def embed(texts: list[str]) -> list[list[float]]:
        rows = [ids[:most] for ids in encode(texts)]
        width = max(1, max(map(len, rows), default=1))
        mask = np.array([[1] * len(r) + [0] * (width - len(r)) for r in rows], np.int64).reshape(-1, width)
        ids = np.array([[*r, *[0] * (width - len(r))] for r in rows], np.int64).reshape(-1, width)
        return checked(pooled(np.asarray(forward(ids, mask), np.float64), mask, how).tolist(), len(texts))

    return embed


def local_model(folder: str, how: str | None = None) -> Callable[[list[str]], list[list[float]]]:
    """An embedder of a model folder (tokenizer.json, model.onnx, and its pooling), run in this process."""
    import onnxruntime
    from tokenizers import Tokenizer

    tokenizer, session = Tokenizer.from_file(str(Path(folder, "tokenizer.json"))), onnxruntime.InferenceSession(str(Path(folder, "model.onnx")))
    takes = {i.name for i in session.get_inputs()}

    def forward(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        return session.run(None, {k: v for k, v in given.items() if k in takes})[0]

    return encoder_model(lambda texts: [e.ids for e in tokenizer.encode_batch(texts)], forward, how or pooling_of(folder))


def checked(vectors: Sequence[Sequence[float]], count: int, width: int | None = None) -> list[list[float]]:
    """Vectors of one batch, scaled to unit length; an error if there are too few, of mixed width, of no length, or not finite."""
    if len(vectors) != count:
        raise EmbeddingError(f"{len(vectors)} vectors for {count} texts")
    found = []
    for v in vectors:
        x = np.asarray(v, np.float64)
        width = len(x) if width is None else width
        if len(x) != width or not len(x):
            raise EmbeddingError(f"a vector of {len(x)} numbers among those of {width}")
        size = math.sqrt(float(x @ x)) if np.isfinite(x).all() else 0.0
        if not size or not math.isfinite(size):
            raise EmbeddingError("a vector that isn't finite, or of no length")
        found.append((x / size).tolist())
    return found


def endpoint_vectors(answer: dict, count: int) -> list[list[float]]:
    """Vectors of an endpoint's answer in the order of the inputs: every index once, and none beyond."""
    data = answer.get("data")
    if not isinstance(data, list):
        raise EmbeddingError("no data")
    by: dict[int, list[float]] = {}
    for item in data:
        i = item.get("index")
        if not isinstance(i, int) or not 0 <= i < count or i in by:
            raise EmbeddingError(f"index {i!r}")
        by[i] = item.get("embedding") or []
    if len(by) != count:
        raise EmbeddingError(f"{count - len(by)} indexes missing")
    return checked([by[i] for i in range(count)], count)


def endpoint(post: Callable[[list[str]], dict]) -> Callable[[list[str]], list[list[float]]]:
    """An embedder over a function that posts at most ENDPOINT_BATCH inputs."""

    def embed(texts: list[str]) -> list[list[float]]:
        found = [v for a in range(0, len(texts), ENDPOINT_BATCH) for v in endpoint_vectors(post(texts[a : a + ENDPOINT_BATCH]), len(texts[a : a + ENDPOINT_BATCH]))]
        return checked(found, len(texts))

    return embed


_WORD = re.compile(r"[^\W_]+")


def hashing(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder without a model: signed hashes of words. A text without words is the first axis."""

    def one(text: str) -> list[float]:
        v = np.zeros(width)
        for w in _WORD.findall(text.lower()):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            v[h % width] += 1 if h >> 63 else -1
        if not v.any():
            v[0] = 1.0
        return v.tolist()

    return lambda texts: checked([one(t) for t in texts], len(texts), width)


@dataclass
class Loaded:
    """Models of this worker, each loaded once; a load that failed is tried again."""

    models: dict[str, Callable[[list[str]], list[list[float]]]] = field(default_factory=dict)
    events: list[dict[str, object]] = field(default_factory=list)

    def get(self, key: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[list[str]], list[list[float]]]:
        if key not in self.models:
            start, status = time.monotonic(), "failed"
            try:
                self.models[key] = load()
                status = "slow" if time.monotonic() - start > SLOW_LOAD else "ok"
            finally:
                self.events.append({"type": "embedder_load", "model": key, "status": status, "took_ms": int(1000 * (time.monotonic() - start))})
        return self.models[key]


LOADED = Loaded()


def embed(entries: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], key: str, spec: Spec | None = None, query: bool = False) -> DataFrame:
    """(id, vec) of entries (id, text). The model is loaded once a worker; texts go to it in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LOADED.get(key, load)
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            if spec is not None:
                texts = [spec.for_query(t) if query else spec.for_doc(t) for t in texts]
            found = [v for a in range(0, len(texts), LOCAL_BATCH) for v in model(texts[a : a + LOCAL_BATCH])]
            yield pd.DataFrame({"id": frame["id"], "vec": checked(found, len(texts))})

    return entries.select("id", "text").mapInPandas(run, f"id {dict(entries.dtypes)['id']}, vec array<float>")


def load_events(spark: SparkSession, models: dict[str, Callable[[], Callable[[list[str]], list[list[float]]]]], workers: int = 1) -> DataFrame:
    """(model, type, status, took_ms) of loading each model on so many workers: ok, slow or failed. A failure is a row, no error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in frames:
            seen = Loaded()
            for key, load in models.items():
                with contextlib.suppress(Exception):
                    seen.get(key, load)
            yield pd.DataFrame(seen.events)[["model", "type", "status", "took_ms"]]

    return spark.range(0, workers, 1, workers).mapInPandas(run, "model string, type string, status string, took_ms long")
