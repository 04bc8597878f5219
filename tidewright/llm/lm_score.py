"""Language-model scores by stupid backoff over bigrams, from counts of the whole corpus.

S(w | v) = C'(v w) / C(v) if C'(v w) > 0, else ALPHA * C(w) / N. C(v) counts v as the
first word of a pair; C' leaves out the pairs of the document that is scored, so a
document is not its own model. A first word scores C(w) / N. A document's score is the
sum of the natural logarithms.

Counts are tables partitioned by hash. Documents' distinct pairs travel to the part of
their first word in blocks of packed columns (a few bytes a pair: words are listed once
a block); there they are joined by sorting: counts of pairs and of contexts are sums
over equal keys, and each document's share of the score is added up. Pairs that no other
document has go on, as requests for the count of their second word, to the part of that
word, where the unigram counts of the same hash are. Frequent words, of more than
1 / HOT of all, are at most HOT many: their counts are broadcast, their pairs are dealt
by the second word or by both, and requests for them are answered on the spot, so no word makes a part
large. Parts are numbered by words, about PART_WORDS each.

Words are 64-bit hashes of runs without white space, A-Z taken as a-z. A document's id
travels with its number of words, from the one scan that numbers the rows. What the
parts return are sums per document in blocks of GROUP rows; they are sorted by group, so
a task holds the sums of one group at a time.

Edge cases: null, empty and wordless texts have 0 words and a score of 0; one word is a
first word; repeated rows and ids are documents of their own (and each other's model);
a null id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import Task, bound_batches, cut, frugal, mix, shuffle_partitions, text_chunks, word_hashes

ALPHA = 0.4
#: Words with more than this part of all words are hot; so there are at most HOT of them.
HOT = 4096
#: Distinct words that a task counts before it passes the counts on.
HELD = 400_000
#: Rows whose sums travel in one block, and requests in a block.
GROUP, MOST_ITEMS = 1024, 100_000
#: Words of the corpus to a part.
PART_WORDS = 4_000_000
#: Words whose pairs make blocks together, about; of a longer document it is all.
CHUNK_WORDS = 1_200_000


def _totals(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    some, at = np.unique(keys, return_inverse=True)
    return some, *(np.bincount(at, w, minlength=len(some)).astype(np.int64) for w in weights)


def _ends(row: np.ndarray) -> np.ndarray:
    """Which words end a row."""
    return np.concatenate((row[1:] != row[:-1], [True])) if len(row) else np.zeros(0, bool)


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, ends): counts of a task, and those at the end of a document; passed on whenever HELD words are known."""
    held, size = [], 0

    def summed() -> list[np.ndarray]:
        return list(_totals(*map(np.concatenate, zip(*held, strict=True))))

    def made(words: np.ndarray, n: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n), pa.array(ends)], names=["word", "n", "ends"])

    for batch in batches:
        for _, _, raw, offsets in text_chunks(batch.column(0)):
            w, row = word_hashes(raw, offsets)
            held.append(list(_totals(w, np.ones(len(w)), _ends(row))))
            size += len(held[-1][0])
            if size > 2 * HELD:
                held = [summed()]
                size = len(held[0][0])
                if size > HELD:
                    yield made(*held[0])
                    held, size = [], 0
    if held:
        yield made(*summed())


def _part(words: np.ndarray, parts: int) -> np.ndarray:
    """In the order of the hashes."""
    return ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    """Integers from 0 in as many bytes as the largest takes, bytes of one place together; the first byte is their number."""
    x = x.astype("<u8")
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    full = np.zeros((flat.shape[1], 8), np.uint8)
    full[:, : data[0]] = flat.T
    return full.view("<u8").reshape(-1)


def _steps(some: np.ndarray) -> bytes:
    """Sorted distinct values, by what each is more than the one before."""
    return _packed(np.diff(some, prepend=np.uint64(0)))


def _listed(values: np.ndarray) -> tuple[bytes, bytes]:
    """Values, each once, and the place of each in that list."""
    some, at = np.unique(values, return_inverse=True)
    return _steps(some), _packed(at)


def _cells(values: bytes, places: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(values), dtype=np.uint64)[_unpacked(places).astype(np.int64)]


def _runs(values: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted values, each once, and how often."""
    some, n = np.unique(values, return_counts=True)
    return _steps(some), _packed(n)


def _repeated(values: bytes, times: bytes) -> np.ndarray:
    return np.repeat(np.cumsum(_unpacked(values), dtype=np.uint64), _unpacked(times).astype(np.int64))


#: What travels to a part. PAIRS: rows, first words (each with its number of pairs) and second words, times. ASKED: rows, words
#: (each with its number of requests), times. COUNTS: words and their counts.
#: To a group of rows go SUMS: rows, pairs that others have, scores; and DOCUMENTS: rows, words, ids, which of them are null.
PAIRS, ASKED, COUNTS, SUMS, DOCUMENTS = range(5)
_BLOCK = "part int, chunk long, kind int, rows binary, a binary, a_at binary, b binary, b_at binary, n binary"
_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]


def _block(part: int, chunk: int, kind: int, rows: bytes = b"", a: bytes = b"", a_at: bytes = b"", b: bytes = b"", b_at: bytes = b"", n: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), *(pa.array([c], pa.binary()) for c in (rows, a, a_at, b, b_at, n))], names=_NAMES)


def _cut(part: np.ndarray, parts: int, most: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(part, first, end) of the runs of sorted parts, each of at most so many."""
    cuts = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        for a in range(int(cuts[p]), int(cuts[p + 1]), most or len(part)):
            yield p, a, min(a + (most or len(part)), int(cuts[p + 1]))


def _asked(row: np.ndarray, word: np.ndarray, n: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Requests by the part of their word."""
    order = np.lexsort((row, word))
    row, word, n = row[order], word[order], n[order]
    for p, a, b in _cut(_part(word, parts), parts, MOST_ITEMS):
        first = int(row[a:b].min())
        words, times = _runs(word[a:b])
        yield _block(p, first, ASKED, _packed(row[a:b] - first), words, times, n=_packed(n[a:b]))


def _dealt(parts: int, hot: np.ndarray, row: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Words of some rows, in order, to blocks of their pairs and of first words."""
    begins = np.concatenate(([True], row[1:] != row[:-1]))
    yield from _asked(row[begins], w[begins], np.ones(int(begins.sum()), np.int64), parts)
    a, b, r = w[:-1][~begins[1:]], w[1:][~begins[1:]], row[1:][~begins[1:]]
    if not len(a):
        return
    # Pairs of a frequent first word go by their second word, and by both if that is frequent, too.
    part = _part(a, parts)
    frequent = np.isin(a, hot)
    part[frequent] = _part(b[frequent], parts)
    frequent &= np.isin(b, hot)
    part[frequent] = _part(mix(a[frequent] ^ mix(b[frequent])), parts)
    order = np.lexsort((r, b, a, part))
    a, b, r, part = a[order], b[order], r[order], part[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (r[1:] != r[:-1]))))
    n = np.diff(np.concatenate((new, [len(a)])))
    a, b, r, part = a[new], b[new], r[new], part[new]
    chunk = int(row[0])
    for p, x, y in _cut(part, parts):
        (firsts, times), (seconds, places) = _runs(a[x:y]), _listed(b[x:y])
        yield _block(p, chunk, PAIRS, _packed(r[x:y] - chunk), firsts, times, seconds, places, _packed(n[x:y]))


def _pairs(parts: int, hot: Broadcast) -> Task:
    """(row, doc_id, text) to blocks of pairs, of first words as requests, and of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            known = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(1).fill_null(0).to_numpy()
            for first, end, raw, offsets in text_chunks(batch.column(2)):
                w, row = word_hashes(raw, offsets)
                words = np.bincount(row, minlength=end - first)
                rows = ids[first:end]
                for here in np.split(np.arange(end - first), np.flatnonzero(np.diff(rows // GROUP)) + 1):
                    yield _block(0, int(rows[here[0]] // GROUP), DOCUMENTS, _packed(rows[here] % GROUP), doc_ids[first + here].astype("<i8").tobytes(), known[first + here].astype(np.uint8).tobytes(), n=_packed(words[here]))
                if len(w):
                    held.append((rows[row], w))
                    size += len(w)
                if size >= CHUNK_WORDS:
                    yield from _dealt(parts, hot.value[0], *map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield from _dealt(parts, hot.value[0], *map(np.concatenate, zip(*held, strict=True)))

    return run


def _summed(row: np.ndarray, score: np.ndarray, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of a part's sums, a block for each GROUP rows."""
    if not len(row):
        return
    some, at = np.unique(row, return_inverse=True)
    total, known = np.bincount(at, score, minlength=len(some)), np.bincount(at, seen, minlength=len(some)).astype(np.int64)
    group = some // GROUP
    cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), [len(some)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield _block(0, int(group[a]), SUMS, _packed(some[a:b] % GROUP), _packed(known[a:b]), n=total[a:b].astype("<f8").tobytes())


def _places(words: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word that is asked for, a place in the sorted words, and whether it is there."""
    if not len(words):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    place = np.minimum(np.searchsorted(words, asked), len(words) - 1)
    return place, words[place] == asked


def _score(parts: int, hot: Broadcast) -> Task:
    """Blocks of a part: pairs are joined with the counts that they make; what no other document has goes on as requests. Other blocks pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count, context, total = hot.value
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            kinds = batch.column(2).to_pylist()
            pass_by = pa.array([k != PAIRS for k in kinds])
            if pass_by.true_count:
                yield batch.filter(pass_by)
            for i, kind in enumerate(kinds):
                if kind == PAIRS:
                    chunk, rows, a, a_at, b, b_at, n = (batch.column(c)[i].as_py() for c in (1, 3, 4, 5, 6, 7, 8))
                    held.append((chunk + _unpacked(rows).astype(np.int64), _repeated(a, a_at), _cells(b, b_at), _unpacked(n).astype(np.int32)))
        if not held:
            return
        row, a, b, n = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        order = np.lexsort((b, a))
        row, a, b, n = row[order], a[order], b[order], n[order]
        new_a = np.concatenate(([True], a[1:] != a[:-1]))
        new = new_a | np.concatenate(([True], b[1:] != b[:-1]))
        others = np.add.reduceat(n, np.flatnonzero(new), dtype=np.int64)[np.cumsum(new) - 1] - n
        firsts = np.add.reduceat(n, np.flatnonzero(new_a), dtype=np.int64)[np.cumsum(new_a) - 1]
        place, frequent = _places(words, a)
        firsts[frequent] = context[place[frequent]]
        seen = others > 0
        score = np.zeros(len(n))
        score[seen] = n[seen] * (np.log(others[seen]) - np.log(firsts[seen]))
        del a, others, firsts
        place, known = _places(words, b)
        known &= ~seen
        score[known] = n[known] * np.log(ALPHA * count[place[known]] / total)
        asked = np.flatnonzero(~seen & ~known)
        score[asked] = n[asked] * np.log(ALPHA)
        yield from _summed(row, score, np.where(seen, n, 0))
        yield from _asked(row[asked], b[asked], n[asked], parts)

    return run


def _answer(total: int) -> Task:
    """Requests for words, and the unigram counts of the same part, to scores. Other blocks pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, counted = [], []
        for batch in batches:
            kinds = batch.column(1).to_pylist()
            pass_by = pa.array([k not in (ASKED, COUNTS) for k in kinds])
            if pass_by.true_count:
                others = batch.filter(pass_by)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(others), np.int32)), *others.columns], names=_NAMES)
            for i, kind in enumerate(kinds):
                if pass_by[i].as_py():
                    continue
                chunk, rows, a, a_at, n = (batch.column(c)[i].as_py() for c in (0, 2, 3, 4, 7))
                if kind == COUNTS:
                    counted.append((_unpacked(a), _unpacked(n)))
                else:
                    asked.append((chunk + _unpacked(rows).astype(np.int64), _repeated(a, a_at), _unpacked(n).astype(np.int32)))
        if not asked:
            return
        words, counts = map(np.concatenate, zip(*counted, strict=True))
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        row, word, n = map(np.concatenate, zip(*asked, strict=True))
        asked.clear()
        # In one order whatever the order of arrival, for sums of the same rounding.
        order = np.lexsort((word, row))
        row, word, n = row[order], word[order], n[order]
        yield from _summed(row, n * (np.log(counts[np.searchsorted(words, word)]) - np.log(total)), np.zeros(len(n)))

    return run


def _counts(parts: int) -> Task:
    """(word, n) to blocks of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            order = np.argsort(words)
            words, n = words[order], n[order]
            for p, a, b in _cut(_part(words, parts), parts):
                yield _block(p, 0, COUNTS, a=_packed(words[a:b]), n=_packed(n[a:b]))

    return run


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sums and documents, those of a group one after another, to a row per document."""

    def made(documents: list[tuple], sums: list[tuple]) -> pa.RecordBatch:
        total, seen = np.zeros(GROUP), np.zeros(GROUP, np.int64)
        # In one order whatever the order of arrival, for sums of the same rounding.
        for rows, known, score in sorted(sums):
            at = _unpacked(rows).astype(np.int64)
            total[at] += np.frombuffer(score, "<f8")
            seen[at] += _unpacked(known).astype(np.int64)
        at = np.concatenate([_unpacked(d[0]) for d in documents]).astype(np.int64)
        ids, null, words = (np.concatenate(x) for x in zip(*((np.frombuffer(d[1], "<i8"), np.frombuffer(d[2], bool), _unpacked(d[3]).astype(np.int64)) for d in documents), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(words), pa.array(seen[at]), pa.array(total[at])], names=["doc_id", "n_words", "n_seen", "log_score"])

    here, documents, sums = None, [], []
    for batch in batches:
        for group, kind, rows, a, a_at, n in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 7)), strict=True):
            if group != here and documents:
                yield made(documents, sums)
                documents, sums = [], []
            here = group
            if kind == DOCUMENTS:
                documents.append((rows, a, a_at, n))
            else:
                sums.append((rows, a, n))
    if documents:
        yield made(documents, sums)


def score(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_seen (pairs that another document has), log_score, mean_log_score."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    words = cut(texts.select("text").mapInArrow(frugal(_unigrams), "word long, n long, ends long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")), "unigrams")
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_partitions(spark), total // PART_WORDS)
    often = words.where(F.col("n") * HOT > total).toArrow()  # HOT rows at most
    hot_words, n, ends = (often.column(c).to_numpy() for c in range(3))
    order = np.argsort(hot_words.view(np.uint64))
    hot = spark.sparkContext.broadcast((hot_words.view(np.uint64)[order], n[order], (n - ends)[order], total))
    sent = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(frugal(_pairs(parts, hot)), _BLOCK)
    scored = sent.repartitionById(parts, "part").mapInArrow(frugal(_score(parts, hot)), _BLOCK)
    counts = words.select("word", "n").mapInArrow(frugal(_counts(parts)), _BLOCK)
    # Sums and documents pass by what answers the requests, in parts of their own.
    dealt = scored.withColumn("part", F.when(F.col("kind") == ASKED, F.col("part")).otherwise(F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int")))
    answered = dealt.unionByName(counts).repartitionById(parts, "part").drop("part").mapInArrow(frugal(_answer(total)), _BLOCK)
    sums = answered.drop("part").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(frugal(_collect), "doc_id long, n_words long, n_seen long, log_score double")
    return sums.select("doc_id", "n_words", "n_seen", F.round("log_score", 6).alias("log_score"), F.round(F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(F.lit(0.0)), 6).alias("mean_log_score"))
