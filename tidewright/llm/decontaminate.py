"""Benchmark decontamination by winnowing. DataFrame functions only.

Both sides are cut into words. Of every `window - k + 1` neighbouring k-gram hashes the
least is kept as a fingerprint, so any span of `window` words that a document and an item
share keeps a common fingerprint (k words) on both sides. Fingerprints are joined; a
document with a common one is a candidate. In a candidate every fingerprint of an item
that it holds gives a place in both, and so a diagonal, on which the item's words lie
against the document's. Hits are extended along it: the two are compared word for word,
and runs of equal words of at least a window are spans. A span counts once, however many
items have it.

An item shorter than a window is one window of its own length; for each such
length that occurs, the documents' runs of that many words join the fingerprints.

Scale: documents are scanned without a shuffle of text; texts of candidates are written
once and shuffled to their diagonals. The fingerprints of the items are broadcast if they
are at most BROADCAST_ROWS, else joined by shuffle, where a fingerprint that a third of
all documents share is split by adaptive execution. A window of an item that no document
holds costs nothing, one that many hold costs a row for each.

Edge cases: null, empty and wordless texts have no words, no hits and no items;
repeated rows and ids get one result row each; items with the same text all
count; an item without an id hits, but isn't listed or counted; empty tables give zeros
or no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.shared import cut, sized

# What separates words, and the letters that are lowered.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOW = 10
#: Words of a fingerprint's gram.
K = 5
#: Fingerprints of items that are sent to every executor at most (about 16 MB).
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def _grams(hashes: Column, n: int) -> Column:
    """Hash of each run of n words; empty if there are fewer."""
    last = F.size(hashes) - n
    run = lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(n)))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), run)).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: Column, span: int) -> Column:
    """The least of every `span` neighbouring hashes; with fewer, none."""
    last = F.size(grams) - span
    least = lambda i: F.least(*(F.get(grams, i + j) for j in range(span)))
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), least))).otherwise(F.array().cast("array<bigint>"))


def _prints(hashed: DataFrame, k: int, spans: int, short: list[int]) -> DataFrame:
    """hashed with its column _h, word hashes, replaced by _f, fingerprints. A step a column: one inside another would be worked out anew for each element."""
    rest = [c for c in hashed.columns if c != "_h"]
    grams = hashed.select(*rest, _grams(F.col("_h"), k).alias("_g"), F.concat(F.array().cast("array<bigint>"), *(_grams(F.col("_h"), n) for n in short)).alias("_s"))
    return grams.select(*rest, F.concat(_winnowed(F.col("_g"), spans), "_s").alias("_f"))


def item_prints(known: DataFrame, window: int, k: int) -> DataFrame:
    """(f, key, at, size): fingerprints of items (key, _w) with their place, and the item's number of words."""
    hashed = known.select("key", F.size("_w").alias("size"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    grams = hashed.where(F.col("size") >= window).select("key", "size", _grams(F.col("_h"), k).alias("_g"))
    span = window - k + 1
    placed = lambda i: F.array_min(F.transform(F.sequence(i, i + (span - 1)), lambda j: F.struct(F.get("_g", j).alias("f"), j.alias("at"))))
    least = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_g") - span), placed))
    # explode_outer, here and below: for explode the optimizer adds a filter on the array and works the array out twice.
    long = grams.select("key", "size", F.explode_outer(least).alias("p")).select("p.f", "key", "p.at", "size")
    whole = F.xxhash64(*(F.get("_h", F.lit(j)) for j in range(window - 1)))
    for n in range(window - 1, 0, -1):
        whole = F.when(F.col("size") == n, F.xxhash64(*(F.get("_h", F.lit(j)) for j in range(n)))).otherwise(whole)
    return long.unionByName(hashed.where(F.col("size") < window).select(whole.alias("f"), "key", F.lit(0).alias("at"), "size"))


def _spans(a: Column, b: Column, first: Column, least: Column) -> Column:
    """(start, stop) of the runs of equal words of two arrays of one size, of at least so many, counted from `first`."""
    size = F.size(a)
    unequal = F.filter(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p, i: F.when(p["x"] != p["y"], i)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(-1)), unequal, F.array(size))
    runs = F.transform(F.slice(edges, 2, F.size(edges) - 1), lambda e, i: F.struct((first + F.get(edges, i) + 1).alias("start"), (first + e).alias("stop")))
    return F.filter(runs, lambda r: r["stop"] - r["start"] >= least)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, text: str = "text", doc: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row per row of docs: doc_id, same (a hash of the text), n_words, n_hit, item_ids (sorted as strings)."""
    spans = window - k + 1
    known = cut(items.select(F.monotonically_increasing_id().alias("key"), F.col(item).cast("string").alias("item_id"), words(F.col(text)).alias("_w")).where(F.size("_w") > 0), "items")
    short = sorted(r[0] for r in known.where(F.size("_w") < window).select(F.size("_w")).distinct().collect())  # below `window` values
    prints = cut(item_prints(known.select("key", "_w"), window, k), "prints")
    few = prints.count() <= BROADCAST_ROWS
    met = prints.select("f").distinct().withColumn("hit", F.lit(1))
    hashed = F.transform("_w", lambda w: F.xxhash64(w))

    taken = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc_id"), F.xxhash64(text).alias("same"), words(F.col(text)).alias("_w"))
    counted = taken.select("row", "doc_id", "same", F.size("_w").cast("long").alias("n_words"), hashed.alias("_h"))
    rows = _prints(counted, k, spans, short).select("row", "doc_id", "same", "n_words", F.explode_outer("_f").alias("f"))
    marked = cut(rows.join(F.broadcast(met) if few else met, "f", "left").groupBy("row", "doc_id", "same", "n_words").agg(F.max("hit").alias("hit")), "marked")

    chosen = marked.where("hit = 1").select(F.col("doc_id").alias("__tw_id"), F.col("same").alias("__tw_same")).distinct()
    again = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("same"), F.col(text).alias("_t"))
    again = cut(again.join(sized(chosen, "chosen"), F.col("doc_id").eqNullSafe(F.col("__tw_id")) & (F.col("same") == F.col("__tw_same")), "left_semi").dropDuplicates(["doc_id", "same"]), "candidates")
    split = again.select("doc_id", "same", words(F.col("_t")).alias("_w"))

    # Where a candidate holds fingerprints of items, and so the diagonals.
    near = split.select("doc_id", "same", F.size("_w").alias("n"), hashed.alias("_h"))
    places = None
    for n in [*short, k]:
        part = near.select("doc_id", "same", "n", F.posexplode_outer(_grams(F.col("_h"), n)).alias("place", "f")).where("f is not null")
        places = part if places is None else places.union(part)
    on = places.join(F.broadcast(prints) if few else prints, "f").select("doc_id", "same", "n", "key", "size", (F.col("place") - F.col("at")).alias("shift")).distinct()
    begin, end = F.greatest("shift", F.lit(0)), F.least(F.col("shift") + F.col("size"), "n")
    least = F.least("size", F.lit(window))
    lines = on.where(end - begin >= least).groupBy("doc_id", "same").agg(F.collect_list(F.struct("key", "shift", begin.alias("begin"), (end - begin).alias("length"), least.alias("least"))).alias("lines"))
    lines = lines.select(F.col("doc_id").alias("__tw_id"), F.col("same").alias("__tw_same"), "lines")
    held = split.join(lines, F.col("doc_id").eqNullSafe(F.col("__tw_id")) & (F.col("same") == F.col("__tw_same"))).select("doc_id", "same", "_w", F.explode_outer("lines").alias("d"))
    held = held.select("doc_id", "same", "d.*", F.slice("_w", F.col("d.begin") + 1, F.col("d.length")).alias("mine"))
    stored = known.select("key", "item_id", F.col("_w").alias("whole"))
    both = held.join(F.broadcast(stored) if few else stored, "key")
    theirs = F.slice("whole", F.col("begin") - F.col("shift") + 1, F.col("length"))
    hits = cut(both.select("doc_id", "same", "item_id", F.explode_outer(_spans(F.col("mine"), theirs, F.col("begin"), F.col("least"))).alias("s")).where("s is not null").select("doc_id", "same", "item_id", "s.start", "s.stop"), "hits")

    order = Window.partitionBy("doc_id", "same").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    once = hits.select("doc_id", "same", "start", "stop").distinct().withColumn("from", F.greatest("start", F.coalesce(reach, F.lit(0))))
    covered = once.groupBy("doc_id", "same").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.col("from"))).cast("long").alias("n_hit"))
    listed = hits.select("doc_id", "same", "item_id").distinct().groupBy(F.col("doc_id").alias("_d"), F.col("same").alias("_s")).agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    found = covered.join(listed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("same") == F.col("_s"))).select(F.col("doc_id").alias("__tw_id"), F.col("same").alias("__tw_same"), "n_hit", "item_ids")
    return marked.join(found, F.col("doc_id").eqNullSafe(F.col("__tw_id")) & (F.col("same") == F.col("__tw_same")) & (F.col("hit") == 1), "left").select(
        "doc_id", "same", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what decontaminate() returns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_share: float = 0.0, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """The rows of docs of whose words at most `most_share` are inside benchmark windows. Columns stay."""
    found = decontaminate(docs, items, window, text=text, doc=doc)
    bad = sized(found.where((F.col("n_hit") > 0) & (F.col("n_hit") > most_share * F.col("n_words"))).select(F.col("doc_id").alias("__tw_id"), F.col("same").alias("__tw_same")).distinct(), "contaminated")
    return docs.join(bad, docs[doc].eqNullSafe(F.col("__tw_id")) & (F.xxhash64(docs[text]) == F.col("__tw_same")), "left_anti")
