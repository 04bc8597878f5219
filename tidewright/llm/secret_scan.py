"""Secret scan: base patterns, then multipart credential linking. DataFrame functions only.

Every text is searched as a whole. A pattern's matches are fenced with a control
character, the fenced text is split at it, and the lengths of the pieces give the
places of the matches in code points, so nothing leaves the JVM.

Linking. Three classes of parts: identifiers (access keys), secrets (assigned
values, and bare 40-character tokens, which are weak) and endpoints (hosts and
URLs, weak). A token that overlaps a base span is that span's and no part of its own.
A weak part is reported only when the parts that complete it lie within `scope` code
points of it in the same document: a bare token needs an identifier, an endpoint needs
an identifier and a secret, which is an assigned value or a token that is reported. The interval join is
made by looking, in order of position, for the nearest complement before and
after, so a document with many parts costs n log n and never n squared.

Edge cases: a null or empty text has no spans; control character 01 in a text is
read as 02 (neither is in a pattern); repeated rows are scanned one by one; a
null doc_id stays null; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FENCE, STAND_IN = "\x01", "\x02"

# The base patterns, the least lengths, and the order of the kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9/+=]+"
BARE = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"  # a run of 40 without =
ENDPOINT = r"(?:https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org|io|cloud|internal)\b(?::[0-9]{2,5})?)"
LEAST_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "linked_secret", "linked_endpoint")

#: Code points within which complementary parts count as one credential.
SCOPE = 200


def _pieces(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, pattern, f"{FENCE}$0{FENCE}"), FENCE)


def _parts(pieces: Column, order: int, value: Column | None = None) -> Column:
    """(kind order, piece number, code points, length of the value) of each piece."""
    return F.transform(
        pieces,
        lambda x, i: F.struct(
            F.lit(order).alias("kind"),
            i.alias("piece"),
            F.length(x).alias("size"),
            (F.when(i % 2 == 1, F.length(F.regexp_extract(x, ASSIGN, 2))) if order == 0 else F.lit(0)).alias("value"),
        ),
    )


def find_parts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(row, *keep, kind, start, end): base and weak parts of every row, and one row of null kind for a row without any."""
    t = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(FENCE), F.lit(STAND_IN))
    base = df.select(F.monotonically_increasing_id().alias("row"), *keep, t.alias("_t"))
    found = base.select("row", *keep, "_t", _pieces(F.col("_t"), ASSIGN).alias("_a"), _pieces(F.col("_t"), ACCESS).alias("_k"), _pieces(F.col("_t"), HEX).alias("_h"))
    identified = F.size("_k") > 1
    none = F.array(F.lit(""))
    some = lambda c: F.when(F.size(c) > 1, F.col(c)).otherwise(F.array().cast("array<string>"))
    parts = found.select(
        "row", *keep, "_a", "_k", "_h",
        F.when(identified, _pieces(F.col("_t"), BARE)).otherwise(none).alias("_b"),
        F.when(identified, _pieces(F.col("_t"), ENDPOINT)).otherwise(none).alias("_e"),
    )
    flat = parts.select("row", *keep, F.explode_outer(F.concat(*(_parts(some(c), i) for i, c in enumerate(("_a", "_k", "_h", "_b", "_e"))))).alias("p"))
    before = Window.partitionBy("row", "p.kind").orderBy("p.piece")
    placed = flat.withColumn("end", F.sum(F.col("p.size").cast("long")).over(before))
    real = F.col("p.kind").isNull() | ((F.col("p.piece") % 2 == 1) & ((F.col("p.kind") != 0) | (F.col("p.value") >= LEAST_ASSIGNED)))
    return placed.where(real).select("row", *keep, F.col("p.kind").alias("kind"), (F.col("end") - F.col("p.size")).alias("start"), "end")


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Drop the tokens that are parts of base spans, and the weak parts that nothing completes within the scope."""
    by = Window.partitionBy("row").orderBy("start", "end", "kind")
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    kind = F.col("kind")

    def gaps(is_part: Column) -> tuple[Column, Column]:
        """Code points since the last such part before, and to the next one; negative if they overlap."""
        return F.col("start") - F.max(F.when(is_part, F.col("end"))).over(back), F.min(F.when(is_part, F.col("start"))).over(ahead) - F.col("end")

    def within(is_part: Column, most: int) -> Column:
        return F.coalesce(F.least(*gaps(is_part)) <= most, F.lit(False))

    bare = parts.withColumn("_id", within(kind == 1, scope)).withColumn("_part", within(kind <= 2, -1))
    tokens = bare.where(kind.isNull() | (kind != 3) | (F.col("_id") & ~F.col("_part")))
    flagged = tokens.withColumn("_secret", within(kind.isin(0, 3), scope))
    keep = kind.isNull() | (kind <= 3) | (F.col("_id") & F.col("_secret"))
    return flagged.where(keep).drop("_id", "_part", "_secret")


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), scope: int = SCOPE) -> DataFrame:
    """One row per row of df: keep, and `spans`, an array of (start, kind, end) by start, then kind as listed."""
    parts = link_parts(find_parts(df, text, keep), scope)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    return parts.groupBy("row", *keep).agg(F.sort_array(F.collect_list(span)).alias("spans")).drop("row")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from what scan() returns."""
    name = F.array(*map(F.lit, KINDS))
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] <= 2)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(write(base), 256).alias("base_sha256"), write(F.col("spans")).alias("spans"))
