"""Exact Jaccard self-join of n-gram sets by vertical partitioning, and its linked classes.

A document's set holds the hashes of its distinct n-grams. Hash order is the global
n-gram order, and it is cut into fragments: a document becomes one segment in each.

1. Which documents can have a partner. Two sets that link differ in at most
   k = floor(s * (1 - t) / t) n-grams, s being the smaller size, so if the order is
   cut into k + 1 + e fragments, at least 1 + e of their segments are equal. Sizes fall
   in classes a factor 1/t wide; a document signs its segments as cut for its own class
   and for the class of its smallest partner. It is live if its signatures that meet
   one of a different set and its empty segments make 1 + e; a passage that many
   documents share makes few whole segments. Documents that are not live have no link.
   Equal sets count as one. Signatures travel in blocks of a few bytes each.
2. Of live documents, each fragment counts in how many an n-gram is. Ordered by that
   count, a document's first n-grams (those by which every partner must be met) are
   listed; n-grams that are in no other document move the list's start, so documents
   with too many of their own drop out.
3. In each list the document that lacks least is paired with all others; partial
   overlaps are counted fragment by fragment and summed per pair; pairs that link
   are joined into classes. Then members of different classes in one list are paired
   in the same way. A pair inside a class already found is never made, so a group of
   copies costs about one pair a member, and no link between classes is lost.

Scale: everything is hash-partitioned; nothing is collected but counts. Signatures are
combined within each chunk of rows, so a group that holds a third of all documents
sends a row a chunk and signature; parts of signatures are numbered by their bytes. Lineage is cut by tables in the shared folder.

Edge cases: a text without words has an empty set and links with nothing, one with
fewer words than n is one n-gram; null is no text; repeated rows, and repeated or null
ids, are documents of their own (a class is named by its smallest id that is not null);
an empty table gives an empty result; other columns are ignored. Equality of n-grams is
equality of 64-bit hashes, of sets equality of 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import bound_batches, cut, drop, frugal, gram_hashes, mix, shuffle_partitions, sized, text_chunks, word_hashes

#: Spare fragments of the smallest classes; larger ones have a quarter of what pairs may differ in besides.
SPARE = 2
#: Fragments in which overlaps are counted.
FRAGMENTS = 16
#: Sets whose copies within one task are recognised before the memory of them is begun anew.
REMEMBERED = 200_000
#: Signatures that one task sorts, about; more documents make more parts.
PART_SIGNATURES = 1_000_000

#: Live sets whose ids are broadcast to find their texts (about 50 MB); with more, texts are shuffled to them.
BROADCAST_ROWS = 500_000



def _sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes in order, row after row, and the offsets of the rows."""
    rows = len(offsets) - 1
    h, row = word_hashes(raw, offsets)
    g, grow = gram_hashes(h, row, n)
    words = np.bincount(row, minlength=rows)
    if (few := np.flatnonzero((words > 0) & (words < n))).size:
        first = np.concatenate(([0], np.cumsum(words)))[few]
        short = np.array([(sum(int(h[a + j]) * (2 * j + 3) for j in range(int(words[r]))) + 7 * int(words[r])) % 2**64 for r, a in zip(few, first, strict=True)], np.uint64)
        short = mix(short)
        at = np.searchsorted(grow, few)
        g, grow = np.insert(g, at, short), np.insert(grow, at, few)
    bounds = np.searchsorted(grow, np.arange(rows + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        g[a:b].sort()
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (grow[1:] != grow[:-1])
    return g[fresh], np.concatenate(([0], np.cumsum(np.bincount(grow[fresh], minlength=rows)))).astype(np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _fingerprints(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each set."""
    size = (bounds[1:] - bounds[:-1]).astype(np.uint64)
    return np.stack((mix(_sums(g, bounds) + size), mix(_sums(mix(g ^ np.uint64(0xA5A5)), bounds) ^ size)), axis=1)


def _class_starts(num: int, den: int, most: int) -> np.ndarray:
    """First size of each class."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, starts[-1] * den // num + 1))
    return np.array(starts, np.int64)


def _spare(differ: np.ndarray) -> np.ndarray:
    """Fragments beyond those that a pair may differ in: so many segments more than one are equal in any pair that links."""
    return differ // 4 + SPARE


def _signed(g: np.ndarray, bounds: np.ndarray, kind: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of segments that aren't empty, their rows, and each row's number of empty segments. kind: each row's size class, below 0 for none."""
    row = np.repeat(np.arange(len(kind)), bounds[1:] - bounds[:-1])
    used = kind[row] >= 0
    row, h = row[used], g[used]
    pieces = np.where(kind >= 0, differ[np.maximum(kind, 0)] + 1 + _spare(differ)[np.maximum(kind, 0)], 0)
    if not len(h):
        return h, row, pieces
    piece = ((h >> np.uint64(32)) * pieces[row].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
    starts = np.flatnonzero(new)
    content = _sums(mix(h + np.uint64(0x51)), np.concatenate((starts, [len(h)])))
    sig = mix(content ^ mix(piece[starts] * np.uint64(0x10001) + kind[row[starts]].astype(np.uint64) * np.uint64(0x1000000000001)))
    return sig, row[starts], pieces - np.bincount(row[starts], minlength=len(kind))


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * 16).tobytes()), pa.py_buffer(rows.tobytes())])


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind or pa.int64()))


def _named(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) to (doc_id, n_shingles, fp, fa); an empty set has no fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in text_chunks(batch.column(1)):
                g, bounds = _sets(raw, offsets, n)
                prints, size = _fingerprints(g, bounds), pa.array(np.diff(bounds))
                empty = pa.compute.equal(size, 0)
                columns = [batch.column(0).slice(a, b - a), size, pa.compute.if_else(empty, None, _binary(prints)), pa.array(prints[:, 0].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "fp", "fa"])

    return run


def _runs(sig: np.ndarray, fa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted signatures: where each run begins, and for each row whether its run has more than one set."""
    runs = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    mixed = np.minimum.reduceat(fa, runs) != np.maximum.reduceat(fa, runs)
    return runs, np.repeat(mixed, np.diff(np.concatenate((runs, [len(sig)]))))


def _sign(n: int, num: int, den: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to blocks of signatures, one a chunk of rows and part, and one more with what is known of the chunk's sets.

    A block: 32 bits of each signature, the place of its set in the block's list, and the list: fa and size class.
    With the part that makes more than 32 bits; equal bits of different signatures only let a document through.
    Of a signature that several sets of the chunk have, all are counted here and one is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        starts = _class_starts(num, den, 1 << 12)
        chunk = 0
        for batch in batches:
            for _, _, raw, offsets in text_chunks(batch.column(0), 1 << 19):
                g, bounds = _sets(raw, offsets, n)
                size = np.diff(bounds)
                if len(size) and size.max() >= starts[-1]:
                    starts = _class_starts(num, den, int(size.max()) * 2)
                differ = (starts[1:] - 1) * (den - num) // num
                fa = _fingerprints(g, bounds)[:, 0].view(np.int64)
                if len(seen) > REMEMBERED:
                    seen = set()
                first = np.zeros(len(size), bool)
                for i, x in enumerate(fa.tolist()):
                    if x not in seen:
                        seen.add(x)
                        first[i] = True
                own = np.searchsorted(starts, size, side="right") - 1
                low = np.searchsorted(starts, -(-size * num // den), side="right") - 1
                sigs, rows, kinds, base = [], [], [], []
                for part, kind in enumerate((own, np.where(low != own, low, -1))):
                    usable = first & (size > 0) & (kind >= 0)
                    usable &= differ[np.maximum(kind, 0)] > 0
                    kind = np.where(usable, kind, -1)
                    s, r, empty = _signed(g, bounds, kind, differ)
                    sigs.append(s)
                    rows.append(r + part * len(size))
                    kinds.append(kind)
                    base.append(empty - 1 - _spare(differ)[np.maximum(kind, 0)])
                sig, row = np.concatenate(sigs), np.concatenate(rows)
                kind, base, both = np.concatenate(kinds), np.concatenate(base), np.concatenate((fa, fa))
                here = np.zeros(len(both), np.int64)
                if len(sig):
                    order = np.argsort(sig, kind="stable")
                    sig, row = sig[order], row[order]
                    runs, mixed = _runs(sig, both[row])
                    here = np.bincount(row[mixed], minlength=len(both))
                    sig, row = sig[runs], row[runs]
                used = np.flatnonzero(kind >= 0)
                if len(used):
                    yield _block(chunk % parts, None, None, both[used], kind[used], np.stack((base[used], here[used])))
                part = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order = np.lexsort((row, part))
                sig, row, part = sig[order].astype(np.uint32), row[order], part[order]
                cuts = np.searchsorted(part, np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    of, place = np.unique(row[cuts[p] : cuts[p + 1]], return_inverse=True)
                    yield _block(p, sig[cuts[p] : cuts[p + 1]], place.astype(np.uint32), both[of], kind[of], None)
                chunk += 1

    return run


_BLOCK = "part int, sig binary, place binary, fa binary, kind binary, known binary"


def _block(part: int, sig: np.ndarray | None, place: np.ndarray | None, fa: np.ndarray, kind: np.ndarray, known: np.ndarray | None) -> pa.RecordBatch:
    data = [x if x is None else x.tobytes() for x in (sig, place, fa, kind.astype(np.int32), known)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["part", "sig", "place", "fa", "kind", "known"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one part to (fa, kind, base, met): how many of a set's signatures meet those of other sets, and what that lacks of the least number."""
    sigs, fas, kinds = [], [], []
    names = ["fa", "kind", "base", "met"]
    for batch in batches:
        for sig, place, fa, kind, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fa, kind = np.frombuffer(fa, np.int64), np.frombuffer(kind, np.int32)
            if known is not None:
                base, here = np.frombuffer(known, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(fa), pa.array(kind), pa.array(base), pa.array(here)], names=names)
            else:
                at = np.frombuffer(place, np.uint32)
                sigs.append(np.frombuffer(sig, np.uint32))
                fas.append(fa[at])
                kinds.append(kind[at])
    if not sigs:
        return
    sig, fa, kind = np.concatenate(sigs), np.concatenate(fas), np.concatenate(kinds)
    del sigs, fas, kinds
    order = np.lexsort((fa, sig))
    sig, fa, kind = sig[order], fa[order], kind[order]
    once = np.concatenate(([True], (sig[1:] != sig[:-1]) | (fa[1:] != fa[:-1])))
    sig, fa, kind = sig[once], fa[once], kind[once]
    mixed = _runs(sig, fa)[1]
    fa, kind = fa[mixed], kind[mixed]
    order = np.lexsort((kind, fa))
    fa, kind = fa[order], kind[order]
    runs = np.flatnonzero(np.concatenate(([True], (fa[1:] != fa[:-1]) | (kind[1:] != kind[:-1])))) if len(fa) else np.zeros(0, np.int64)
    met = np.diff(np.concatenate((runs, [len(fa)])))
    for a in range(0, len(runs), 50_000):
        at = runs[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(fa[at]), pa.array(kind[at]), pa.nulls(len(at), pa.int64()), pa.array(met[a : a + 50_000])], names=names)


def _segments(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (wanted fp, text) to (fp, n, segments), for rows whose set is the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.uint64(64 - FRAGMENTS.bit_length() + 1)
        for batch in batches:
            for a, b, raw, offsets in text_chunks(batch.column(1)):
                g, bounds = _sets(raw, offsets, n)
                prints = _fingerprints(g, bounds)
                asked = batch.column(0).slice(a, b - a)
                same = np.array([x.as_py() == y.tobytes() for x, y in zip(asked, prints, strict=True)], bool)
                row = np.repeat(np.arange(b - a), bounds[1:] - bounds[:-1])
                ends = np.cumsum(np.bincount(row * FRAGMENTS + (g >> width).astype(np.int64), minlength=(b - a) * FRAGMENTS))
                inner = _lists(g.view(np.int64), np.concatenate(([0], ends)))
                outer = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * FRAGMENTS), inner)
                whole = pa.RecordBatch.from_arrays([_binary(prints), pa.array(bounds[1:] - bounds[:-1]), outer], names=["fp", "n", "segs"])
                yield whole.filter(pa.array(same))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (x, y): root is the smallest node of the connected component.

    Each round joins every node to its least neighbour and contracts; rounds go as the logarithm of the
    diameter. Sums are combined before the shuffle, so a node may have any number of edges."""
    cur = cut(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x < y").distinct(), "edges")
    found = None
    while not cur.isEmpty():
        both = cur.union(cur.select("y", "x"))
        up = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("root")), "up")
        step = cur.join(up.select(F.col("node").alias("x"), F.col("root").alias("px")), "x").join(up.select(F.col("node").alias("y"), F.col("root").alias("py")), "y")
        after = cut(step.select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).where("x < y").distinct(), "edges")
        if found is None:
            found = up
            drop(cur)
        else:
            better = cut(found.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
            drop(cur, up, found)
            found = better
        cur = after
    drop(cur)
    if found is None:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).limit(0)
    return found


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y, nx, ny) that link: overlaps counted in each fragment, summed per pair."""
    parts = sets.select("fp", F.posexplode_outer("segs").alias("frag", "seg")).where(F.size("seg") > 0)
    left = pairs.join(parts.select(F.col("fp").alias("x"), "frag", F.col("seg").alias("sx")), "x")
    both = left.join(parts.select(F.col("fp").alias("y"), "frag", F.col("seg").alias("sy")), ["y", "frag"])
    partial = both.select("x", "y", "nx", "ny", F.size(F.array_intersect("sx", "sy")).cast("long").alias("part"))
    total = partial.groupBy("x", "y", "nx", "ny").agg(F.sum("part").alias("common"))
    return total.where(F.col("common") * den >= (F.col("nx") + F.col("ny") - F.col("common")) * num).select("x", "y")


def _could(num: int, den: int, a: str, b: str) -> Column:
    """Whether two listed documents can reach the overlap that linking takes, by their sizes and places."""
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    rest = F.least(na - F.col(f"p{a}"), nb - F.col(f"p{b}"))
    return (F.greatest(na, nb) * num <= F.least(na, nb) * den) & (rest * (num + den) >= (na + nb) * num)


def link(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, fp (the set's fingerprint), class (smallest fp reachable), component_id.

    Documents link when den * |intersection| >= num * |union| of their n-gram sets."""
    spark = docs.sparkSession
    bound_batches(spark)
    named = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = cut(named.mapInArrow(frugal(_named(n)), "doc_id long, n_shingles long, fp binary, fa long"), "sets")

    whole = rows.agg(F.sum("n_shingles"), F.count("fp")).first()
    signatures = 2.5 * (whole[0] or 0) * (den - num) / num + 2 * (SPARE + 1) * whole[1]  # at most, about: of two classes, with a quarter to spare
    parts = max(shuffle_partitions(spark), int(signatures // PART_SIGNATURES))
    met = named.select("text").mapInArrow(frugal(_sign(n, num, den, parts)), _BLOCK).repartitionById(parts, "part").drop("part").mapInArrow(frugal(_meet), "fa long, kind int, base long, met long")
    live = met.groupBy("fa", "kind").agg(F.max("base").alias("base"), F.sum("met").alias("met")).where("base + met >= 0").select("fa").distinct()
    classes = rows.where("fp is not null").groupBy("fp", "fa").agg(F.min("doc_id").alias("rep"))
    chosen = cut(classes.join(live, "fa", "left_semi").select("fp", "rep"), "live")

    few = chosen.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(doc).cast("long").alias("__tw_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen) if few else chosen, F.col("__tw_id").eqNullSafe(F.col("rep")))
    sets = cut(texts.select("fp", "text").mapInArrow(frugal(_segments(n)), "fp binary, n long, segs array<array<bigint>>"), "segments")
    if not sets.groupBy("fp").count().where("count > 1").isEmpty():  # rows repeated with their ids
        repeated, sets = sets, cut(sets.dropDuplicates(["fp"]), "segments")
        drop(repeated)

    # In how many live documents each n-gram is; those of one document only count towards `own`.
    grams = sets.select("fp", "n", F.explode_outer(F.flatten("segs")).alias("g"))
    spread = grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    order = grams.join(spread, "g").groupBy("fp", "n").agg(F.collect_list(F.struct("df", "g")).alias("z")).withColumn("own", F.col("n") - F.size("z"))
    room = (F.col("n") - F.ceil(F.col("n") * num / den) + 1 - F.col("own")).cast("int")
    heads = order.where(room > 0).select("fp", "n", "own", F.slice(F.sort_array("z"), F.lit(1), room).alias("z"))
    lists = heads.select("fp", "n", "own", F.posexplode_outer("z").alias("i", "z")).where("z is not null")
    lists = cut(lists.select(F.col("z.g").alias("g"), "fp", "n", "own", (F.col("own") + F.col("i")).alias("p")), "lists")

    # The document that lacks least leads each list.
    lead = lists.groupBy("g").agg(F.min(F.struct("own", "fp", "n", "p")).alias("l"), F.count("*").alias("m")).where("m > 1").select("g", F.col("l.fp").alias("fc"), F.col("l.n").alias("nc"), F.col("l.p").alias("pc"))
    member = lists.select("g", F.col("fp").alias("fm"), F.col("n").alias("nm"), F.col("p").alias("pm"))
    star = member.join(lead, "g").where((F.col("fm") != F.col("fc")) & _could(num, den, "m", "c"))

    def ordered(pairs: DataFrame, name: str) -> DataFrame:
        swap = F.col("fm") > F.col("fc")
        pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
        return cut(pairs.select(pick("fm", "fc").alias("x"), pick("fc", "fm").alias("y"), pick("nm", "nc").alias("nx"), pick("nc", "nm").alias("ny")).distinct(), name)

    tried = ordered(star, "star")
    first = components(_linked(tried, sets, num, den))

    # Members of different classes: those outside the leader's class against all.
    labelled = member.join(first.select(F.col("node").alias("fm"), "root"), "fm", "left").withColumn("cm", F.coalesce("root", "fm")).drop("root")
    several = labelled.groupBy("g").agg(F.min("cm").alias("a"), F.max("cm").alias("b")).where("a < b").select("g")
    open_ = cut(labelled.join(several, "g", "left_semi"), "open")
    led = lead.select("g", "fc").join(first.select(F.col("node").alias("fc"), "root"), "fc", "left").select("g", F.coalesce("root", "fc").alias("lc"))
    aside = open_.join(led, "g").where("cm <> lc").drop("lc")
    other = open_.select("g", F.col("fm").alias("fc"), F.col("nm").alias("nc"), F.col("pm").alias("pc"), F.col("cm").alias("cc"))
    across_ = ordered(aside.join(other, "g").where((F.col("cm") != F.col("cc")) & _could(num, den, "m", "c")), "across")
    across = across_.join(tried.select("x", "y"), ["x", "y"], "left_anti")
    more = _linked(across, sets, num, den)
    for side in ("x", "y"):
        more = more.join(first.select(F.col("node").alias(side), F.col("root").alias("_r")), side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
    second = components(more)
    whole = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("class"))
    # Classes that were single documents in the first pass.
    alone = second.join(first.select("node"), "node", "left_anti").select("node", F.col("root").alias("class"))
    label = cut(whole.unionByName(alone), "labels")

    named = rows.select("doc_id", "n_shingles", "fp").join(label.select(F.col("node").alias("fp"), "class"), "fp", "left").select("doc_id", "n_shingles", "fp", F.coalesce("class", "fp").alias("class"))
    named = cut(named, "named")
    drop(rows, chosen, sets, lists, tried, open_, across_, first, second, label)
    least = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    return named.join(least, "class", "left").select("doc_id", "n_shingles", "fp", "class", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """docs without all but one document of each class: the one with the smallest id stays (of repeated ids, one row; of classes without ids, all)."""
    found = cut(link(docs, n, num, den, text, doc).select("doc_id", "component_id", "n_shingles"), "found")
    stays = sized(found.where("doc_id = component_id").select(F.col("doc_id").alias("__tw_id")).distinct(), "stays")
    kept = docs.join(stays, docs[doc] == F.col("__tw_id"), "left_semi")
    if not found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([doc, text])
    if not found.where("doc_id is null").isEmpty():
        kept = kept.unionByName(docs.where(F.col(doc).isNull()))
    return kept
