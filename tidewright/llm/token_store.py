"""Token ids as bit-packed binary blocks.

Documents are encoded with a public tokenizer, and an end id follows each. For a
byte-level BPE the words between spaces are encoded by the library once a worker and
looked up from then on, which gives the ids that whole texts give: the tokenizer
splits a text there before it merges. A word is looked up by its hash, and all bytes
found are compared with the text. Texts in which that isn't sure (several blanks in a
row, other white space, special tokens, words of one hash), and other tokenizers,
encode whole texts.

Format. The store is a folder of shards in ascending order of doc_id; a row of a
shard is a block: an image of bytes with a header (magic, bits an id, documents, ids),
the offset of each document's first id, and the ids, each in the least number of bits
that holds the vocabulary, least significant bit first. Blocks hold whole documents,
about BLOCK ids. Numpy unpacks a block at once; document i of a block is bits
offset[i] * bits to offset[i+1] * bits, so any document is read without the others.
The container is Parquet, so blocks are written, committed and read by Spark on any
file system it knows.

Order: shards are ranges of doc_id cut at quantiles of the ids; a heavy id can't grow
a shard beyond the rows of that id. Starts of shards are sums of one row a shard.

Edge cases: a null or empty text has the end id alone; a null doc_id comes after all
others; repeated ids keep their rows, ordered by their ids' checksum; an empty table
gives an empty store; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.shared import KEPT, Task, bound_batches, first_bytes, frugal, scratch_path, shuffle_partitions, span_hashes, text_chunks, word_bounds

MAGIC = b"TWB1"
HEADER = struct.Struct("<4sIIQ")
#: Ids in a block, unless one document has more.
BLOCK = 1 << 16
#: Words whose ids a worker remembers, and their bytes (about 50 MB in all); beyond that it begins anew.
REMEMBERED, REMEMBERED_BYTES = 500_000, 16 << 20
#: Marks at the end of a word that are looked through; words with more are encoded as they are.
MOST_MARKS = 16
#: Ranges that the ids are first cut into are found to within this share of all rows.
QUANTILE_ERROR = 0.002
END_ID = 2


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


#: Bytes that are white space other than space and line feed, and first bytes of such characters with their second bytes.
_STRANGE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])
_PAIRS = ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)))


#: Marks: what is printed in ASCII and is no letter or digit.
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def plain(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows have no white space but single spaces and line feeds between words, by their bytes."""
    blank = (raw == 32) | (raw == 10)
    bad = _STRANGE[raw]
    bad[1:] |= blank[1:] & blank[:-1]
    for first, seconds in _PAIRS:  # of E2 80 and E3 80 only some are white space; rows with others are encoded whole, too
        at = np.flatnonzero(raw[:-1] == first)
        bad[at[np.isin(raw[at + 1], seconds)]] = True
    some = np.flatnonzero(np.diff(offsets) > 0)
    edge = blank[offsets[:-1][some]] | blank[offsets[1:][some] - 1]
    total = np.concatenate(([0], np.cumsum(bad)))
    found = total[offsets[1:]] == total[offsets[:-1]]
    found[some] &= ~edge
    return found


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1 == 1, axis=None, bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, start: int, count: int) -> np.ndarray:
    """Ids start to start + count of packed data, as 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    first, last = start * bits // 8, -(-(start + count) * bits // 8)
    flat = np.unpackbits(np.frombuffer(data, np.uint8, last - first, first), bitorder="little")
    at = start * bits - first * 8
    return (flat[at : at + count * bits].reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def image(docs: list[np.ndarray], bits: int) -> bytes:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in docs]))).astype("<u8")
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    return HEADER.pack(MAGIC, bits, len(docs), len(ids)) + offsets.tobytes() + pack(ids, bits)


def document(block: bytes, i: int) -> np.ndarray:
    """The ids of document i of a block."""
    magic, bits, docs, _ = HEADER.unpack_from(block)
    if magic != MAGIC or not 0 <= i < docs:
        raise ValueError("not a block, or no such document in it")
    a, b = np.frombuffer(block, "<u8", 2, HEADER.size + 8 * i)
    return unpack(memoryview(block)[HEADER.size + 8 * (docs + 1) :], bits, int(a), int(b - a))


def _put(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """array, or one twice as long, with more from place `used` on."""
    if used + len(more) > len(array):
        array = np.concatenate((array[:used], np.zeros(max(len(array), len(more)), array.dtype)))
    array[used : used + len(more)] = more
    return array


class _Known:
    """Words and their ids. A table of hashes leads to places; bytes of place i are text[text_at[i]:text_at[i + 1]], ids likewise."""

    def __init__(self) -> None:
        self.keys, self.place, self.count = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32), 0
        self.text, self.text_at = np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, np.int64)
        self.ids, self.ids_at = np.zeros(1 << 17, np.uint32), np.zeros(1 << 16, np.int64)
        self.head = np.zeros(1 << 16, np.uint64)  # the first eight bytes of each word

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 of those that aren't known."""
        found, todo = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        mask = np.uint64(len(self.keys) - 1)
        at = (hashes & mask).astype(np.int64)
        while len(todo):
            key = self.keys[at]
            same = key == hashes[todo]
            found[todo[same]] = self.place[at[same]]
            on = ~same & (key != 0)
            todo, at = todo[on], (at[on] + 1) & int(mask)
        return found

    def _enter(self, hashes: np.ndarray, places: np.ndarray) -> None:
        mask, todo = len(self.keys) - 1, np.arange(len(hashes))
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[todo[free]]  # of several, one stays
            mine = self.keys[at] == hashes[todo]
            self.place[at[mine]] = places[todo[mine]]
            todo, at = todo[~mine], (at[~mine] + 1) & mask

    def add(self, hashes: np.ndarray, words: list[bytes], ids: list[list[int]]) -> None:
        """Distinct hashes that aren't known, their words and ids."""
        n, more = self.count, len(words)
        if 2 * (n + more) > len(self.keys):
            kept = np.flatnonzero(self.keys)
            keys, places = self.keys[kept], self.place[kept]
            size = 1 << (2 * (n + more)).bit_length()
            self.keys, self.place = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._enter(keys, places)
        lengths, sizes = (np.fromiter(map(len, cells), np.int64, more) for cells in (words, ids))
        text = np.frombuffer(b"".join(words), np.uint8)
        self.text = _put(self.text, int(self.text_at[n]), text)
        self.head = _put(self.head, n, first_bytes(text, np.cumsum(lengths) - lengths, lengths))
        self.ids = _put(self.ids, int(self.ids_at[n]), np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))
        self.text_at = _put(self.text_at, n + 1, self.text_at[n] + np.cumsum(lengths))
        self.ids_at = _put(self.ids_at, n + 1, self.ids_at[n] + np.cumsum(sizes))
        self._enter(hashes, np.arange(n, n + more, dtype=np.int32))
        self.count += more

    def are(self, place: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which spans of a text are the words at these places, byte for byte: the first eight at once, the rest of longer ones one after another."""
        size = ends - starts
        same = (self.text_at[place + 1] - self.text_at[place] == size) & (self.head[place] == first_bytes(raw, starts, size))
        long = np.flatnonzero(same & (size > 8))
        if len(long):
            more = size[long] - 8
            total = np.concatenate(([0], np.cumsum(more)))
            here = np.arange(total[-1])
            mine = raw[np.repeat(starts[long] + 8 - total[:-1], more) + here]
            equal = mine == self.text[np.repeat(self.text_at[place[long]] + 8 - total[:-1], more) + here]
            same[long] = np.logical_and.reduceat(equal, total[:-1])
        return same

    def ids_of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of places one after another, and where each begins."""
        size = self.ids_at[place + 1] - self.ids_at[place]
        total = np.concatenate(([0], np.cumsum(size)))
        return self.ids[np.repeat(self.ids_at[place] - total[:-1], size) + np.arange(total[-1])], total


#: Up to here what Python and the tokenizer hold to be letters doesn't depend on the version of Unicode.
_LAST_LATIN = "\u024f"
#: The character by which a byte-level BPE writes each byte: itself if it is printed, else the next free one.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = {b: b for b in _PRINTED} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}


class Encoder:
    """Texts to ids. Of a byte-level BPE the ids of words are remembered.

    Where white space is single spaces and line feeds, the tokenizer's own split has a boundary
    before every space and on both sides of every line feed, so the text between them can be
    encoded alone; elsewhere a run of white space may be one piece."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        feed = self.whole("\n")
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer") and (made.get("model") or {}).get("type") == "BPE" and len(feed) == 1
        self.feed = feed[0] if len(feed) else 0
        #: Added tokens are found before the split; a text with one is encoded whole.
        self.added = [t["content"].encode() for t in made.get("added_tokens", [])]
        self.known = _Known()

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Encode words, with the space or line feed before them, if any. Letters alone are one piece to the tokenizer, and its model merges them at once; other words are encoded as texts with a line feed, which is one id, between them."""
        merge, ids, others, space = self.tokenizer.model.tokenize, [], [], chr(_WRITTEN[32])
        for i, w in enumerate(words):
            lead = w[0]
            bare = w[1:] if lead == 32 or lead == 10 else w
            if bare.isalpha():  # of bytes: ASCII letters, which are written as they are
                piece = bare.decode()
            elif (text := bare.decode()).isalpha() and max(text) <= _LAST_LATIN:
                piece = bare.decode("latin-1").translate(_WRITTEN)
            else:
                others.append(i)
                ids.append([])
                continue
            found = [t.id for t in merge(space + piece if lead == 32 else piece)]
            ids.append([self.feed, *found] if lead == 10 else found)
        for at in range(0, len(others), 512):
            some = others[at : at + 512]
            flat = self.whole(b"".join([words[i].removeprefix(b"\n") + b"\n" for i in some]).decode())
            ends = np.flatnonzero(flat == self.feed)
            if len(ends) != len(some):
                raise ValueError("a line feed is not an id of its own")
            for i, a, b in zip(some, [0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True):
                ids[i] = [self.feed] * (words[i][:1] == b"\n") + flat[a:b].tolist()
        self.known.add(hashes, words, ids)

    def _by_word(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray | None]:
        """Ids of plain rows, none of them empty; None of rows with a word that shares its hash with another."""
        starts, ends = word_bounds(raw, offsets)
        row = np.searchsorted(offsets, starts, side="right") - 1
        led = starts > offsets[row]  # has a space or line feed before it
        # Marks after a letter are a piece of their own at the end of a word.
        body = ends.copy()  # where the marks at the end begin
        on = np.flatnonzero(_MARK[raw[ends - 1]])
        for _ in range(MOST_MARKS):
            body[on] -= 1
            on = on[body[on] > starts[on]]
            on = on[_MARK[raw[body[on] - 1]]]
        body[on] = ends[on]
        last, before = raw[np.maximum(body - 1, 0)], raw[np.maximum(body - 2, 0)]
        accented = (body - starts > 1) & (before >= 0xC3) & (before <= 0xC9) & (last >= 0x80) & ~((before == 0xC3) & ((last == 0x97) | (last == 0xB7)))
        tail = np.flatnonzero((body < ends) & (body > starts) & (_LETTER[last] | accented))
        marks, stops = body[tail], ends[tail]
        ends[tail] = marks
        starts, ends, row, led = np.insert(starts, tail + 1, marks), np.insert(ends, tail + 1, stops), np.insert(row, tail + 1, row[tail]), np.insert(led, tail + 1, False)
        begin = starts - led
        h = np.maximum(span_hashes(raw, begin, ends), np.uint64(1))
        place = self.known.find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            some, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            first, data, known = new[first], raw.tobytes(), self.known.count
            self._learn(some, [data[a:b] for a, b in zip(begin[first].tolist(), ends[first].tolist(), strict=True)])
            place[new] = known + back
        ids, total = self.known.ids_of(place)
        cuts = total[np.searchsorted(row, np.arange(len(offsets)))]
        found: list[np.ndarray | None] = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for r in row[~self.known.are(place, raw, begin, ends)].tolist():
            found[r] = None
        if self.known.count > REMEMBERED or self.known.text_at[self.known.count] > REMEMBERED_BYTES:
            self.known = _Known()
        return found

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of text."""
        rows = len(offsets) - 1
        data = raw.tobytes()
        sure = plain(raw, offsets) & (np.diff(offsets) > 0) if self.by_word else np.zeros(rows, bool)
        if any(t in data for t in self.added):
            sure &= np.array([not any(t in data[offsets[i] : offsets[i + 1]] for t in self.added) for i in range(rows)])
        found: list[np.ndarray | None] = [None] * rows
        if sure.any():
            size = np.diff(offsets)
            part = raw if sure.all() else raw[np.repeat(sure, size)]
            for i, ids in zip(np.flatnonzero(sure).tolist(), self._by_word(part, np.concatenate(([0], np.cumsum(size[sure])))), strict=True):
                found[i] = ids
        return [x if x is not None else self.whole(data[offsets[i] : offsets[i + 1]].decode()) for i, x in enumerate(found)]


#: Encoders of this Python worker, by path: a worker serves many tasks.
_ENCODERS: dict[str, Encoder] = {}


def _width(bits: int) -> str:
    """How ids travel to their shard, where they are packed."""
    return "<u2" if bits <= 16 else "<u4"


def _encode(path: str, end: int, bits: int) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        KEPT["tokens"] = _ENCODERS.clear
        encoder, last, kind = _ENCODERS[path], np.array([end], np.uint32), np.dtype(_width(bits))
        for batch in batches:
            for a, b, raw, offsets in text_chunks(batch.column(2)):
                some = batch.slice(a, b - a)
                docs = encoder.encode(raw, offsets)
                flat = np.concatenate([x for d in docs for x in (d, last)]).astype(kind)
                size = np.array([len(d) + 1 for d in docs], np.int64)
                at = np.concatenate(([0], np.cumsum(size * kind.itemsize)))
                ids = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(size), ids.cast(pa.binary())], names=["part", "doc_id", "n", "ids"])

    return run


def _blocks(bits: int) -> Task:
    """Rows of one shard in order to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first, held, doc_ids, size = 0, 0, 0, [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([image(held, bits)], pa.binary())],
                names=["shard", "block", "first", "n_ids", "doc_ids", "image"],
            )

        for batch in batches:
            for part, doc, n, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if held and (part != shard or size + n > BLOCK):
                    yield made()
                    block, first, held, doc_ids, size = (block + 1, first + size, [], [], 0) if part == shard else (0, 0, [], [], 0)
                shard = part
                held.append(np.frombuffer(ids.as_buffer(), _width(bits)))
                doc_ids.append(doc)
                size += n
        if held:
            yield made()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END_ID, text: str = "text", doc: str = "doc_id") -> None:
    """Encode docs and write the store."""
    spark = docs.sparkSession
    bound_batches(spark)
    bits = bits_for(max(Encoder(tokenizer).vocabulary, end + 1))
    shards = shuffle_partitions(spark)
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Cuts of the range of ids, from the ids alone: encoding happens once, below.
    edges = sorted(set(rows.approxQuantile("doc_id", [i / shards for i in range(1, shards)], QUANTILE_ERROR))) if shards > 1 else []
    part = F.when(F.col("doc_id").isNull(), F.lit(shards - 1)).otherwise(F.size(F.filter(F.array(*(F.lit(int(e)) for e in edges)), lambda e: e < F.col("doc_id"))) if edges else F.lit(0))
    encoded = rows.select(part.cast("int").alias("part"), "doc_id", "text").mapInArrow(frugal(_encode(tokenizer, end, bits), "tokens"), "part int, doc_id long, n long, ids binary")
    placed = encoded.repartitionById(shards, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "ids")
    placed.mapInArrow(frugal(_blocks(bits), "tokens"), "shard int, block long, first long, n_ids long, doc_ids array<bigint>, image binary").write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            base, ids, block = batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].as_py()
            _, bits, docs, n = HEADER.unpack_from(block)
            offsets = np.frombuffer(block, "<u8", docs + 1, HEADER.size).astype(np.int64)
            tokens = unpack(memoryview(block)[HEADER.size + 8 * (docs + 1) :], bits, 0, n).astype("<u4")
            crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(base + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the store: doc_id, start, n_tokens, ids_crc32 of its ids as 32-bit little-endian integers."""
    bound_batches(spark)
    blocks = spark.read.parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a shard, and as many shards as a shuffle has partitions
    placed = blocks.join(F.broadcast(base), "shard").select((F.col("base") + F.col("first")).alias("at"), "doc_ids", "image")
    return placed.mapInArrow(frugal(_read, "tokens"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int = END_ID) -> DataFrame:
    """docs written to a store in the shared folder, and what is read back from it."""
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end)
    return read(docs.sparkSession, path)
