"""Exact top-k inner products by columnar branch and bound.

Vectors become integers, floor(256 * x), and are laid out dimension by dimension.
Scores of a block of candidates are accumulated over one block of dimensions after
another, those with the largest share of the mass first. After each, a candidate's
score can grow by no more than the product of the norms of what remains of it and
of the query; those that can't reach the query's k-th best score so far are
dropped and the survivors compacted before the next block.

Bounds are reckoned in doubles with room for their rounding; where a product isn't sure
to be exact in them, the scores of the survivors are worked out in whole numbers.

Queries are the vectors whose id is divisible by `every`; they meet all vectors. They
are taken in groups of at most about GROUP, one after another, so what the driver holds
and broadcasts has a fixed bound; for each group every task reads its candidates once,
in blocks of candidates by QUERIES queries, and returns its k best a query, and the best
of those are ranked and, if there are more groups, written to the shared folder.

Edge cases: vectors that are null, empty, or hold a null or a component that isn't
finite take no part, nor do rows without id; only vectors of one length meet; ties go
to the smaller id; repeated rows are candidates of their own (a query's own row is
known by its id, so rows that share a query's id are not its candidates, and a
repeated query is answered once); with fewer than k candidates all are returned;
a score that a long can't hold is given as the long next to it; vectors with components
beyond a double when scaled take no part; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.shared import Task, bound_batches, cut, frugal

#: Queries that are sent to every task at once, about.
GROUP = 16_384
#: Candidates in a block, queries that it meets at once, and dimensions in a block.
ROWS, QUERIES, DIMS = 4096, 256, 16
SCALE = 256
#: Sums of products below these are exact in doubles and in longs.
EXACT, LONG = 2.0**52, 2.0**62
#: Rounding of a double, with room to spare.
ROUNDING = 2.0**-50
LEAST = np.iinfo(np.int64).min


def _whole(vectors: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rows by length of vector, and their integer components; rows that take no part are left out."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    length = np.array(vectors.value_lengths().fill_null(0))
    found = {}
    for n in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == n)
        flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
        x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), n)  # null becomes nan
        fine = np.isfinite(x).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * x[fine])
        wide = np.isfinite(x).all(axis=1)
        found[int(n)] = (rows[fine][wide], x[wide])
    return length, found


class _Best:
    """The k best scores of each query so far, and the candidates' ids."""

    def __init__(self, queries: int, k: int) -> None:
        self.score = np.full((queries, k), LEAST, np.int64)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max, np.int64)
        self.count = np.zeros(queries, np.int64)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        if len(score) > 4 * k:  # all that tie with the k-th stay
            least = np.partition(score, len(score) - k)[len(score) - k]
            ids, score = ids[score >= least], score[score >= least]
        had = self.count[q]
        score, ids = np.concatenate((self.score[q, :had], score)), np.concatenate((self.ids[q, :had], ids))
        best = np.lexsort((ids, ~score))[:k]  # ~ turns the order of longs
        self.count[q] = len(best)
        self.score[q, : len(best)], self.ids[q, : len(best)] = score[best], ids[best]


def _products(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Whole-number inner products of a query and columns of candidates."""
    if float(np.abs(query).max(initial=0)) * float(np.abs(columns).max(initial=0)) * max(1, len(query)) < LONG:
        return query.astype(np.int64) @ columns.astype(np.int64)
    q = [int(x) for x in query]
    found = [sum(a * int(b) for a, b in zip(q, column, strict=True)) for column in columns.T]
    return np.array([max(LEAST, min(np.iinfo(np.int64).max, x)) for x in found], np.int64)


@np.errstate(over="ignore", invalid="ignore")
def _block(best: _Best, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
    """Branch and bound of one block of candidates for all queries."""
    order = np.argsort(-(rows**2).sum(axis=0), kind="stable")
    columns = np.ascontiguousarray(rows[:, order].T)  # dimension by dimension
    cuts = [*range(0, len(order), DIMS), len(order)]
    rest_rows = [np.sqrt((columns[c:] ** 2).sum(axis=0)) for c in cuts[:-1]]
    exact = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * len(order) < EXACT
    for first in range(0, len(queries), QUERIES):
        asked = queries[first : first + QUERIES][:, order]
        rest_asked = [np.sqrt((asked[:, c:] ** 2).sum(axis=1)) for c in cuts[:-1]]
        partial = asked[:, : cuts[1]] @ columns[: cuts[1]]
        for i, q in enumerate(range(first, first + len(asked))):
            full = best.count[q] == best.score.shape[1]
            least = float(best.score[q, -1])
            room = 1 + ROUNDING * ((len(order) + 8) * rest_asked[0][i] * rest_rows[0] + abs(least))
            score, alive = partial[i], np.arange(len(ids))
            for step in range(1, len(cuts)):
                if step > 1:
                    score = score + asked[i, cuts[step - 1] : cuts[step]] @ columns[cuts[step - 1] : cuts[step], alive]
                if full:
                    bound = score + (rest_asked[step][i] * rest_rows[step][alive] if step < len(cuts) - 1 else 0.0) + room[alive]
                    stays = np.flatnonzero(~(bound < least))  # what isn't a number stays
                    if len(stays) < 0.7 * len(alive) or step in (1, len(cuts) - 1) and len(stays) < len(alive):
                        alive, score = alive[stays], score[stays]
                if not len(alive):
                    break
            other = ids[alive] != query_ids[q]
            alive, score = alive[other], score[other]
            if len(alive):
                best.add(q, score.astype(np.int64) if exact else _products(asked[i], columns[:, alive]), ids[alive])


def _search(sent: Broadcast, k: int) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = {n: _Best(len(ids), k) for n, (ids, _) in asked.items()}
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for n, (rows, x) in _whole(batch.column(1))[1].items():
                if n in asked:
                    for a in range(0, len(rows), ROWS):
                        _block(best[n], asked[n][1], asked[n][0], x[a : a + ROWS], all_ids[rows[a : a + ROWS]].astype(np.int64))
        for n, (ids, _) in asked.items():
            full = np.arange(k) < best[n].count[:, None]
            q, _ = np.nonzero(full)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best[n].ids[full]), pa.array(best[n].score[full])], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, rank from 1."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where("vec_id is not null and embedding is not null")
    queries = rows.where(F.col("vec_id") % every == 0)
    groups = max(1, -(-queries.count() * 5 // (4 * GROUP)))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = None
    for g in range(groups):
        some = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).toArrow()  # about GROUP vectors
        ids = some.column(0).to_numpy()
        asked = {}
        for n, (at, x) in _whole(some.column(1))[1].items():
            first = np.unique(ids[at], return_index=True)[1]
            asked[n] = (ids[at][first], x[first])
        sent = spark.sparkContext.broadcast(asked)
        part = rows.mapInArrow(frugal(_search(sent, k)), "query_id long, vec_id long, score long")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if groups > 1:
            part = cut(part, "group")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found
