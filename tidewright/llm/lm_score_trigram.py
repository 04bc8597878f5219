"""Stupid backoff over trigrams, relationally, from counts of the whole corpus.

S(w | u v) = C'(u v w) / C(u v) if C'(u v w) > 0, else ALPHA * S(w | v), which is that of
lm_score: C'(v w) / C(v) if C'(v w) > 0, else ALPHA * C(w) / N. C(u v) counts the pair as
the begin of a trigram, C(v) the word as the begin of a pair; C' leaves out what the
scored document itself holds. A first word scores C(w) / N, a second word S(w | v). A
document's score is the sum of the natural logarithms.

Words are 64-bit hashes of runs without white space, A-Z taken as a-z. Distinct trigrams
and pairs of each document are joined with their counts by key. The tables aren't packed,
so the shuffle is many times the input (README).

Edge cases: those of lm_score; documents of one or two words have no trigram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.lm_score import ALPHA
from tidewright.llm.shared import bound_batches, text_chunks, word_hashes


def _grams(order: int, heads: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, text) to (row, g0 .. g<order - 1>, n): the distinct n-grams of each document; heads: only each document's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, raw, offsets in text_chunks(batch.column(1)):
                h, row = word_hashes(raw, offsets)
                w, size = h.view(np.int64), len(h) - order + 1
                if size <= 0:
                    continue
                whole = row[:size] == row[order - 1 :]
                if heads:
                    whole &= np.concatenate(([True], row[1:] != row[:-1]))[:size]
                at = np.flatnonzero(whole)
                if not len(at):
                    continue
                keys = [row[at], *(w[at + i] for i in range(order))]
                sort = np.lexsort(keys[::-1])
                keys = [k[sort] for k in keys]
                new = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))))
                n = np.diff(np.concatenate((new, [len(at)])))
                rows = int(ids[first]) + keys[0][new].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(k[new]) for k in keys[1:]), pa.array(n.astype(np.int64))], names=["row", *(f"g{i}" for i in range(order)), "n"])

    return run


def score(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_seen (trigrams that another document has), log_score, mean_log_score."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def grams(names: str, heads: bool = False) -> DataFrame:
        some = rows.select("row", "text").mapInArrow(_grams(len(names), heads), f"row long, {', '.join(f'g{i} long' for i in range(len(names)))}, n long")
        return some.toDF("row", *names, "n")

    three, two, one = grams("uvw"), grams("vw"), grams("w")
    of_words = one.groupBy("w").agg(F.sum("n").alias("c1"))
    total = F.broadcast(one.agg(F.sum("n").alias("total")))
    of_three = three.groupBy("u", "v", "w").agg(F.sum("n").alias("c"))
    tri = three.join(of_three, ["u", "v", "w"]).join(three.groupBy("u", "v").agg(F.sum("n").alias("h")), ["u", "v"])
    seen3 = tri.where("c > n").select("row", F.col("n").alias("seen"), (F.col("n") * F.ln((F.col("c") - F.col("n")) / F.col("h"))).alias("s"))
    # What is asked of the pairs: m times after a trigram that no other document has (at ALPHA), and of each document's second word.
    after = tri.where("c = n").groupBy("row", "v", "w").agg(F.sum("n").alias("m"), (F.sum("n") * F.ln(F.lit(ALPHA))).alias("s"))
    second = grams("vw", True).select("row", "v", "w", F.col("n").alias("m"), F.lit(0.0).alias("s"))
    asked = after.unionByName(second).groupBy("row", "v", "w").agg(F.sum("m").alias("m"), F.sum("s").alias("s"))
    pairs = two.join(two.groupBy("v", "w").agg(F.sum("n").alias("c")), ["v", "w"]).join(two.groupBy("v").agg(F.sum("n").alias("h")), "v")
    two_of = asked.join(pairs, ["row", "v", "w"])
    zero = F.lit(0).cast("long").alias("seen")
    seen2 = two_of.where("c > n").select("row", zero, (F.col("s") + F.col("m") * F.ln((F.col("c") - F.col("n")) / F.col("h"))).alias("s"))
    last = two_of.where("c = n").select("row", "w", "m", (F.col("s") + F.col("m") * F.ln(F.lit(ALPHA))).alias("s"))
    head = grams("w", True).select("row", "w", F.col("n").alias("m"), F.lit(0.0).alias("s"))
    words = last.unionByName(head).join(of_words, "w").crossJoin(total).select("row", zero, (F.col("s") + F.col("m") * F.ln(F.col("c1") / F.col("total"))).alias("s"))
    sums = seen3.unionByName(seen2).unionByName(words).groupBy("row").agg(F.sum("seen").alias("n_seen"), F.sum("s").alias("log_score"))
    sizes = one.groupBy("row").agg(F.sum("n").alias("n_words"))
    per = rows.select("row", "doc_id").join(sizes, "row", "left").join(sums, "row", "left").fillna(0, ["n_words", "n_seen", "log_score"])
    return per.select("doc_id", "n_words", "n_seen", F.round("log_score", 6).alias("log_score"), F.round(F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(F.lit(0.0)), 6).alias("mean_log_score"))
