"""Dense search over unit vectors, and the checks of a vector cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import vectors as V
from tidewright.operators.held import BLOCK, Held
from tidewright.operators.ranking import top
from tidewright.workers import files, reach, settled

#: Queries that are sent to every task at once, about; more are searched group by group. Rows that one product takes, and queries from which rows are dealt to all cores.
GROUP, ROWS, MANY = 65536, 2048, 1024


class EmbeddingsNotBuilt(ValueError):
    pass


class ModelMismatch(ValueError):
    pass


def guard(vectors: DataFrame, queries: DataFrame, model: str | None = None, built_with: str | None = None) -> None:
    """Refuse a search by another model, or another width, than the vectors were built with. One vector tells their width: that all have one is checked when they are built (validate(), rebuild())."""
    if model is not None and built_with is not None and model != built_with:
        raise ModelMismatch(f"vectors are of model {built_with}, the query of {model}")
    ours = [r[0] for r in vectors.select(F.size("vec").alias("n")).where("n > 0").limit(1).collect()]
    theirs = [r[0] for r in queries.select(F.size("qvec").alias("n")).where("n > 0").distinct().limit(2).collect()]
    if ours and theirs and ours != theirs:
        raise ModelMismatch(f"vectors are of {ours} dimensions, queries of {theirs}")


def model_events(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """(id, type, stored_model, stored_dim) of vectors (id, vec, model) that a model of this name and width can't be compared with: embedder_model_mismatch events."""
    other = ~F.col("model").eqNullSafe(F.lit(model)) | (F.size("vec") != dim)
    return vectors.where(other).select("id", F.lit("embedder_model_mismatch").alias("type"), F.col("model").alias("stored_model"), F.size("vec").alias("stored_dim"))


def search(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, kind, id, score, rank): the k best of each query and kind by dot product over the shorter width. The whole corpus is ranked, then cut.

    vectors (id, vec[, kind]), queries (query_id, qvec). Each group of about GROUP queries is sent to every task, which
    returns its k best a query and kind; if there are several, both tables are made once."""
    spark = vectors.sparkSession
    reach(spark)
    if "kind" not in vectors.columns:
        vectors = vectors.withColumn("kind", F.lit("entry"))
    kinds = {**dict(queries.dtypes), **dict(vectors.dtypes)}
    out = f"query_id {kinds['query_id']}, kind string, id {kinds['id']}, score double"
    total = queries.count()
    if total == 0 or k <= 0:
        return spark.createDataFrame([], out + ", rank int")
    groups = -(-total // GROUP)
    asked, held = queries.where(F.col("qvec").isNotNull()).select("query_id", "qvec"), vectors.where("vec is not null").select("kind", "id", "vec")
    if total > MANY:  # what is made of a few files would keep a few cores at work
        held = held.repartition(2 * spark.sparkContext.defaultParallelism)
    if groups > 1:
        asked, held = settled(asked, "asked"), settled(held, "vectors")
    found = None
    for g in range(groups):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g).toArrow().combine_chunks()
        if not some.num_rows:
            continue
        names, rows = some.column("query_id").combine_chunks(), some.column("qvec").combine_chunks()
        width = rows.value_lengths().to_numpy()
        by_width = {int(n): (at := np.flatnonzero(width == n), _matrix(rows.take(pa.array(at)), int(n))) for n in np.unique(width)}
        part = held.mapInArrow(_searcher(names, by_width, k, digits), out)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], out + ", rank int") if found is None else top(found, ["query_id", "kind"], k)


def _matrix(rows: pa.Array, n: int) -> np.ndarray:
    """Lists of n numbers each; null is no number."""
    return rows.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), n)


def _searcher(names: pa.Array, by_width: dict[int, tuple[np.ndarray, np.ndarray]], k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], Held] = {}
        id_type = None

        def offer(kind: str, ids: np.ndarray, block: np.ndarray) -> None:
            order = np.argsort(ids, kind="stable")
            ids, block = ids[order], block[order]
            for n, (at, asked) in by_width.items():
                m = min(n, block.shape[1])
                for c in range(0, len(at), BLOCK):
                    some = asked[c : c + BLOCK, :m]
                    if (kind, n, c) not in held:
                        held[kind, n, c] = Held(len(some), k, digits)
                    held[kind, n, c].offer(some @ block[:, :m].T, ids)

        for batch in batches:
            id_type = batch.schema.field("id").type
            width = np.array(batch.column("vec").value_lengths())
            kind = np.array(batch.column("kind").to_pylist(), str)
            ids = np.array(batch.column("id").to_pylist())
            for name in np.unique(kind):
                for n in np.unique(width[kind == name]):
                    at = np.flatnonzero((kind == name) & (width == n))
                    for a in range(0, len(at), ROWS):
                        rows = at[a : a + ROWS]
                        offer(str(name), ids[rows], _matrix(batch.column("vec").take(pa.array(rows)), int(n)))
        for (name, n, c), best in held.items():
            if len(best.q):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(by_width[n][0][c + best.q])), pa.array([name] * len(best.q), pa.string()), pa.array(best.ids.tolist(), id_type), pa.array(best.s)], names=["query_id", "kind", "id", "score"])

    return run


def missing(corpus: DataFrame, vectors: DataFrame) -> DataFrame:
    """Entries without a vector: what extend() must embed, and empty if the cache is built."""
    return corpus.join(vectors.select("id"), "id", "left_anti")


def require_built(corpus: DataFrame, vectors: DataFrame) -> None:
    if not missing(corpus, vectors).isEmpty():
        raise EmbeddingsNotBuilt("some entries have no vector")


def validate(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: vectors, widths, those that are empty, not finite, not of unit length."""
    v = F.col(vec)
    sound = V.finite(v)
    return vectors.agg(
        F.count("*").alias("n"), F.countDistinct(F.size(v)).alias("widths"), F.sum((F.size(v) <= 0).cast("long")).alias("n_empty"),
        F.sum((~sound).cast("long")).alias("n_not_finite"), F.sum((sound & ~V.is_unit(v)).cast("long")).alias("n_not_unit"),
    )


def extend(corpus: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """vectors and those of entries that lack one; embed turns (id, text) into (id, vec)."""
    return vectors.unionByName(embed(missing(corpus, vectors)).select(*vectors.columns))


def _current(spark: SparkSession, root: str) -> str | None:
    folder, system = files(spark, f"{root}/versions")
    made = sorted(str(f.getPath()) for f in system.listStatus(folder)) if system.exists(folder) else []
    sound = [v for v in made if system.exists(files(spark, f"{v}/_SUCCESS")[0])]
    return sound[-1] if sound else None


def stored(spark: SparkSession, root: str) -> DataFrame | None:
    """The vectors (id, vec, model) of the last whole version under a folder, if there is one."""
    path = _current(spark, root)
    return None if path is None else spark.read.parquet(path)


def rebuild(corpus: DataFrame, root: str, embed: Callable[[DataFrame], DataFrame], model: str) -> DataFrame:
    """Embed all of corpus (id, text) anew and make that the version that is read.

    A version is written beside those that are there and counts once Spark has finished it, so readers see the old
    or the new one, whole; an embedder that leaves entries out or gives vectors of several widths leaves the old
    one. An empty corpus makes an empty version."""
    spark = corpus.sparkSession
    folder, system = files(spark, f"{root}/versions/{time.time_ns():020d}")
    hidden, _ = files(spark, f"{root}/making-{time.time_ns():020d}")
    embed(corpus).select("id", "vec", F.lit(model).alias("model")).write.parquet(str(hidden))
    made = spark.read.parquet(str(hidden))
    found = validate(made).first()
    if not missing(corpus, made).isEmpty() or found["n"] != corpus.count() or found["widths"] > 1 or (found["n_empty"] or 0) + (found["n_not_finite"] or 0):
        system.delete(hidden, True)
        raise EmbeddingsNotBuilt("the embedder left entries out, or gave vectors that don't fit each other")
    system.mkdirs(folder.getParent())
    system.rename(hidden, folder)
    return spark.read.parquet(str(folder))


def rebuild_centroids(members: DataFrame, vectors: DataFrame, digits: int = 9) -> DataFrame:
    """(cluster, centroid): mean of the members' vectors, normalised. members: (cluster, id)."""
    parts = members.join(vectors, "id").select("cluster", F.posexplode("vec").alias("i", "x"))
    mean = parts.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = mean.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("p")).select("cluster", F.transform("p", lambda p: p["m"]).alias("c"))
    return whole.select("cluster", F.transform(V.scaled(F.col("c")), lambda x: F.round(x, digits)).alias("centroid"))
