"""Embedding artifacts: a checked binary file of vectors, and the same as tables."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format.
MAGIC, FORMAT, KINDS = b"RAT1", 1, ("tool", "skill", "fact")
_HEAD = struct.Struct("<4sIQ32s")
#: The version of our own projection of entries to text.
PROJECTION_VERSION = 1

ROWS = "kind string, id string, projection_hash binary, vec array<float>, dim int, model string, projection_version long"


class ArtifactError(ValueError):
    pass


def _text(s: str) -> bytes:
    b = s.encode()
    return struct.pack("<I", len(b)) + b


def encode(entries: Iterable[tuple[str, str, bytes, Iterable[float]]], dim: int, model: str, projection_version: int = PROJECTION_VERSION) -> bytes:
    """(kind, id, hash, vector) entries as one file; vectors must have the width, be finite, and of unit length."""
    parts, n = [], 0
    for kind, entry, digest, vec in entries:
        v = np.asarray(list(vec), "<f4")
        if kind not in KINDS or len(digest) != 32:
            raise ArtifactError(f"entry {entry!r}: kind or hash")
        if len(v) != dim or not np.isfinite(v).all() or abs(float((v.astype(float) ** 2).sum()) - 1) > 1e-4:
            raise ArtifactError(f"entry {entry!r}: width, a number, or length")
        parts.append(bytes([KINDS.index(kind)]) + _text(entry) + digest + v.tobytes())
        n += 1
    payload = struct.pack("<II", projection_version, dim) + _text(model) + struct.pack("<I", n) + b"".join(parts)
    return _HEAD.pack(MAGIC, FORMAT, len(payload), hashlib.sha256(payload).digest()) + payload


def decode(data: bytes) -> tuple[int, int, str, list[tuple[str, str, bytes, list[float]]]]:
    """(projection version, width, model, entries) of a file that is whole and sound."""
    if len(data) < _HEAD.size:
        raise ArtifactError("too short")
    magic, version, size, digest = _HEAD.unpack_from(data)
    payload = data[_HEAD.size :]
    if magic != MAGIC:
        raise ArtifactError("magic")
    if version != FORMAT:
        raise ArtifactError("format version")
    if len(payload) != size:
        raise ArtifactError("length" if len(payload) < size else "trailing bytes")
    if hashlib.sha256(payload).digest() != digest:
        raise ArtifactError("checksum")
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(payload):
            raise ArtifactError("payload ends early")
        at += n
        return payload[at - n : at]

    def number() -> int:
        return struct.unpack("<I", take(4))[0]

    def text() -> str:
        try:
            return take(number()).decode()
        except UnicodeDecodeError:
            raise ArtifactError("text") from None

    projection, dim, model, n = number(), number(), text(), number()
    if n and not dim:
        raise ArtifactError("width 0")
    entries, seen = [], set()
    for _ in range(n):
        kind, entry = take(1)[0], text()
        if kind >= len(KINDS) or (kind, entry) in seen:
            raise ArtifactError(f"entry {entry!r}: kind, or there twice")
        seen.add((kind, entry))
        entries.append((KINDS[kind], entry, take(32), np.frombuffer(take(4 * dim), "<f4").tolist()))
    if at != len(payload):
        raise ArtifactError("trailing bytes")
    return projection, dim, model, entries


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all artifacts under a path, on any file system that Spark reads."""

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                projection, dim, model, entries = decode(bytes(content))
                if entries:
                    yield pd.DataFrame([[*e, dim, model, projection] for e in entries], columns=[c.split()[0] for c in ROWS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ROWS)


def projection_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def warm(entries: DataFrame, artifact: DataFrame) -> DataFrame:
    """entries (kind, id, text) with the vector of the artifact (kind, id, hash, vec) whose hash is that of the text, else null: those are to be embedded."""
    hashed = entries.withColumn("hash", projection_hash(F.col("text")))
    return hashed.join(artifact.select("kind", "id", "hash", "vec"), ["kind", "id", "hash"], "left")


def merge(parts: list[DataFrame]) -> DataFrame:
    """One artifact of several with the same projection, model and width; an entry that is in two is an error. Empty parts don't count."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    if whole.select("projection_version", "model", "dim").distinct().limit(2).count() > 1:
        raise ArtifactError("parts differ in projection, model or width")
    if not conflicts(whole).isEmpty():
        raise ArtifactError("an entry is in two parts")
    return whole


def conflicts(whole: DataFrame) -> DataFrame:
    return whole.groupBy("kind", "id").agg(F.count("*").alias("n")).where("n > 1")
