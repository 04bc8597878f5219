"""Quality classifier by importance resampling over hashed n-grams.

Every document is a set of hashed n-grams: its words and pairs of neighbouring words, the
first 4 and 6 and the last 3 bytes of each word (as they are written), and whether a word
comes RUN times in a row. Each counts once a document.
Two generative models are counted over hash buckets, in TABLES tables of BUCKETS: of
the target text (labelled good and not toxic) and of raw text (all documents). A
document's log weight is the sum of the log ratios of its n-grams. A ratio counts only
as far as all tables agree, beyond a dead zone and what chance makes of counts, and
only if the labelled documents alone bear it out too, so that text which is merely
unlabelled is not held to be bad.

Documents are then resampled without replacement: to each log weight standard Gumbel
noise, a function of seed and id, is added, and the k largest are selected. k is the
number of documents whose log weight reaches the threshold, unless it is given; the
threshold is the one that best keeps labelled good and rejects labelled bad documents.

Bounds: at most LABELLED labelled documents (those whose ids hash lowest) fit the
target model; they are broadcast. The models have TABLES * BUCKETS values. Raw counts and
scores cover all documents. The k-th key is found by counting keys in ever finer bins, and
only rows of its last bin, 2**-42 wide, are ordered; never by a global sort.

Edge cases: null and wordless texts have weight 0 and are kept like neutral ones; no
labels, or none of one kind, leaves all ratios 0 and selects everything; a document
with several labels counts as bad if any says so; null labels are no labels; repeated
rows have equal keys and are taken in turn; a null doc_id is never labelled; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.mixture import uniform
from tidewright.llm.shared import bound_batches, cut, frugal, lowered, mix, sized, span_hashes, text_chunks, word_bounds

#: Hash tables, their buckets, and the buckets of a row of counts.
TABLES, BUCKETS, BLOCK = 3, 1 << 18, 1 << 12
LABELLED = 100_000
#: Times in a row that a word doesn't come in prose.
RUN = 5
#: Counts that pull a ratio towards 1, and log ratios that say nothing.
PRIOR, DEAD = 1.0, 1.0
#: Standard deviations by which a count must miss what the raw model expects.
SURE = 3.0
#: Log weights count so many times against the noise of resampling.
SHARP = 8.0
#: Log weights are told apart up to this far from 0 when the threshold is set.
REACH, STEP = 64.0, 0.25
#: How much keeping good counts against rejecting bad, what makes thresholds equal, and the log weight below which they stay.
GOOD_COUNTS, SLACK, LEAST_EVIDENCE = 3.0, 0.001, 1.0


def _features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-grams, once a row, and their rows."""
    starts, ends = word_bounds(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Sentence marks at a word's end belong to no word.
    marks = np.isin(raw, np.frombuffer(b".,;:?", np.uint8))
    trimmed = np.where(marks[ends - 1] & (ends - starts > 1), ends - 1, ends)
    low = lowered(raw)

    def part(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        return mix(span_hashes(low, a, b) + np.uint64(kind << 32))

    row = np.searchsorted(offsets, starts, side="right") - 1
    word = part(starts, trimmed, 1)
    long4, long6 = trimmed - starts >= 4, trimmed - starts >= 6
    again = np.zeros(len(word), bool)
    if len(word) >= RUN:
        same = np.concatenate(([0], np.cumsum((word[1:] == word[:-1]) & (row[1:] == row[:-1]))))
        again[RUN - 1 :] = same[RUN - 1 :] - same[: len(word) - RUN + 1] == RUN - 1
    beside = np.flatnonzero(row[1:] == row[:-1])
    pair = mix(word[beside] * np.uint64(0x9E3779B97F4A7C15) + word[beside + 1] + np.uint64(6 << 32))
    hashes = np.concatenate((word, pair, part(starts[long4], starts[long4] + 4, 2), part(starts[long6], starts[long6] + 6, 3), part(np.maximum(ends - 3, starts), ends, 4), np.full(again.sum(), mix(np.array([5 << 32], np.uint64))[0])))
    of = np.concatenate((row, row[beside], row[long4], row[long6], row, row[again]))
    once = np.unique(mix(hashes ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
    return hashes[once], of[once]


def _buckets(hashes: np.ndarray, table: int) -> np.ndarray:
    return (mix(hashes + np.uint64(0xD1B54A32D192ED03 * (table + 1) % 2**64)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, counts): raw, good and bad counts of a task's documents, a row for each BLOCK buckets; label 1 is good and 0 bad."""
    counts = np.zeros((3, TABLES, BUCKETS), np.int32)
    for batch in batches:
        label = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
        for a, _, raw, offsets in text_chunks(batch.column(0)):
            hashes, row = _features(raw, offsets)
            of = label[a + row]
            for t in range(TABLES):
                bucket = _buckets(hashes, t)
                for i, at in enumerate((bucket, bucket[of == 1], bucket[of == 0])):
                    counts[i, t] += np.bincount(at, minlength=BUCKETS).astype(np.int32)
    yield from _rows(counts.reshape(3, -1, BLOCK))


def _rows(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    blocks = counts.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array([counts[:, b].astype("<i8").tobytes() for b in range(blocks)], pa.binary())], names=["block", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[b] = total.get(b, 0) + np.frombuffer(data, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def log_ratios(raw: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log ratio of target and raw model for each bucket, and 0 where it is small, could be chance, or labels don't bear it out."""
    if not raw.sum() or not good.sum() or not bad.sum():
        return np.zeros(len(raw))

    def against(base: np.ndarray) -> np.ndarray:
        expected = base * (good.sum() / base.sum())
        ratio = np.log((good + PRIOR) / (expected + PRIOR))
        # The usual n-gram of good text is neutral.
        at = np.argsort(ratio)
        heavy = np.searchsorted(np.cumsum(good[at]), good.sum() / 2)
        ratio = ratio - ratio[at[min(heavy, len(at) - 1)]]
        return np.where((np.abs(ratio) >= DEAD) & (np.abs(expected - good) >= SURE * np.sqrt(np.maximum(expected, 1.0))), ratio, 0.0)

    a, b = against(raw.astype(float)), against((good + bad).astype(float))
    return np.where(np.sign(a) == np.sign(b), np.sign(a) * np.minimum(np.abs(a), np.abs(b)), 0.0)


def _score(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = sent.value
        for batch in batches:
            weights = []
            for a, b, raw, offsets in text_chunks(batch.column(3)):
                hashes, row = _features(raw, offsets)
                ratio = ratios[0][_buckets(hashes, 0)]
                for t in range(1, TABLES):  # what another n-gram in one bucket says doesn't count
                    other = ratios[t][_buckets(hashes, t)]
                    ratio = np.where(np.sign(ratio) == np.sign(other), np.sign(ratio) * np.minimum(np.abs(ratio), np.abs(other)), 0.0)
                weights.append(np.bincount(row, ratio, minlength=b - a))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.round(np.concatenate(weights), 6) if weights else np.zeros(0))], names=["doc_id", "label", "u", "log_weight"])

    return run


def good_labels(labels: DataFrame, doc: str = "doc_id", most: int = LABELLED) -> DataFrame:
    """(doc_id, label) of at most `most` documents: 1 if good and not toxic, else 0."""
    good = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise((F.coalesce("quality", F.lit(1)) > 0) & (F.coalesce("toxic", F.lit(0)) == 0))
    one = labels.select(F.col(doc).alias("__tw_id"), good.cast("int").alias("label")).where("__tw_id is not null and label is not null").groupBy("__tw_id").agg(F.min("label").alias("label"))
    return one.orderBy(F.xxhash64("__tw_id"), "__tw_id").limit(most)


#: Keys are told apart by bins, first of this width, then of parts of the one bin that matters.
WIDTH, PARTS, LEVELS = 1 / 64, 4096, 4


def _edge(scored: DataFrame, k: int) -> tuple[Column, Column, int]:
    """For the k largest keys: which rows are surely among them, which share the least bin with the k-th key, and how many of these are.

    Each level counts the keys of one bin in PARTS finer ones, so no level sorts keys and what is left is that of few
    distinct keys; equal keys stay together."""
    sure, open_, low, width, left = F.lit(False), F.lit(True), None, WIDTH, k
    for level in range(LEVELS):
        place = F.floor(-F.col("key") / width).cast("long") if low is None else F.least(F.lit(PARTS - 1).cast("long"), F.floor((-F.col("key") - low) / width).cast("long"))
        bins = scored.where(open_).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = bins.select("bin", "n", before.alias("before")).where((F.col("before") < left) & (F.col("before") + F.col("n") >= left)).first()  # one row a bin
        if found is None:  # all rows, or none
            return F.lit(k > 0), F.lit(False), 0
        sure, open_ = sure | (open_ & (place < found["bin"])), open_ & (place == found["bin"])
        left -= found["before"]
        low, width = (found["bin"] * width if low is None else low + found["bin"] * width), width / PARTS
        if found["n"] == left:
            return sure | open_, F.lit(False), 0
    return sure, open_, left


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, text: str = "text", doc: str = "doc_id", seed: str = "gumbel-1") -> DataFrame:
    """One row per row of docs: doc_id, log_weight, key, selected."""
    spark = docs.sparkSession
    bound_batches(spark)
    known = F.broadcast(cut(good_labels(labels), "labels"))
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(known, F.col("doc_id") == F.col("__tw_id"), "left").select("doc_id", "label", "text")
    # Rows without an id are told apart by their text.
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5("text")))
    counted = rows.select("text", "label").mapInArrow(frugal(_count), "block int, counts binary").repartition("block").mapInArrow(frugal(_add), "block int, counts binary").toArrow()  # TABLES * BUCKETS / BLOCK rows
    table = np.zeros((3, TABLES * BUCKETS // BLOCK, BLOCK), np.int64)
    for block, data in zip(*(c.to_pylist() for c in counted.columns), strict=True):
        table[:, block] = np.frombuffer(data, "<i8").reshape(3, BLOCK)
    sent = spark.sparkContext.broadcast([log_ratios(*t) for t in table.reshape(3, TABLES, BUCKETS).transpose(1, 0, 2)])
    scored = rows.select("doc_id", "label", uniform(named, seed).alias("u"), "text").mapInArrow(frugal(_score(sent)), "doc_id long, label int, u double, log_weight double")
    scored = cut(scored.select("doc_id", "label", "log_weight", (SHARP * F.col("log_weight") - F.log(-F.log("u"))).alias("key")), "scored")

    if k is None:
        step = F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("log_weight"))) / STEP).cast("int")
        seen = {r[0]: (r[1] or 0, r[2] or 0, r[3]) for r in scored.groupBy(step.alias("s")).agg(F.sum((F.col("label") == 1).cast("long")), F.sum((F.col("label") == 0).cast("long")), F.count("*")).collect()}  # few hundred bins
        goods, bads = sum(x[0] for x in seen.values()), sum(x[1] for x in seen.values())
        k = sum(x[2] for x in seen.values())
        if goods and bads:
            # What each threshold keeps of good and rejects of bad labelled documents; of nearly equal ones the lowest.
            kept, gone, value = goods, 0, {}
            for s in range(int(-REACH / STEP), int(-LEAST_EVIDENCE / STEP) + 1):
                value[s] = (GOOD_COUNTS * kept / goods + gone / bads) / (GOOD_COUNTS + 1)
                good, bad, _ = seen.get(s, (0, 0, 0))
                kept, gone = kept - good, gone + bad
            at = min(s for s, v in value.items() if v >= max(value.values()) - SLACK)
            k = sum(x[2] for s, x in seen.items() if s >= at)
    sure, open_, left = _edge(scored, k)
    if not left:
        return scored.select("doc_id", "log_weight", "key", sure.alias("selected"))
    rank = F.row_number().over(Window.orderBy(F.col("key").desc(), "doc_id", "log_weight"))
    inside = scored.where(open_).withColumn("selected", rank <= left)
    outside = scored.where(~open_).withColumn("selected", sure)
    return outside.unionByName(inside).select("doc_id", "log_weight", "key", "selected")


def keep_selected(docs: DataFrame, labels: DataFrame, k: int | None = None, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """The rows of docs that resample() selects. Rows that repeat an id go if any of them is rejected."""
    found = resample(docs, labels, k, text, doc).where(~F.col("selected"))
    rejected = sized(found.select(F.col("doc_id").alias("__tw_id")).distinct(), "rejected")
    return docs.join(rejected, docs[doc].eqNullSafe(F.col("__tw_id")), "left_anti")
