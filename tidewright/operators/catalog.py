"""Corpus maintenance: upsert, replacement, overrides, hashes, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of definition overrides, in bytes, and the form of a fact's id.
MOST_ID, MOST_TEXT = 512, 16_384
FACT_ID = r"^[A-Za-z0-9._:-]+$"
KINDS, PINS = ("tool", "skill", "fact"), ("always", "retrieved")


def upsert(arrivals: DataFrame, entry: str = "id", seq: str = "seq") -> DataFrame:
    """The last arrival of each id, at the place of its first: one aggregation, the rows combined before the shuffle."""
    rest = [c for c in arrivals.columns if c not in (entry, seq)]
    latest = arrivals.groupBy(entry).agg(F.min(seq).alias(seq), F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return latest.select(entry, seq, *(F.col(f"_r.{c}").alias(c) for c in rest))


def replace_all(old: DataFrame, new: DataFrame, compared: list[str], entry: str = "id") -> DataFrame:
    """(id, status) of a whole replacement: added, removed, updated, unchanged. In new, the last of repeated ids (by seq) counts."""
    kept = upsert(new) if "seq" in new.columns else new
    a = old.select(F.col(entry).alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in compared))
    b = kept.select(F.col(entry).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in compared))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(entry), status.alias("status"))


def churn(diff: DataFrame) -> DataFrame:
    """(status, n) of what changed; what is unchanged makes no event."""
    return diff.where("status <> 'unchanged'").groupBy("status").agg(F.count("*").alias("n"))


def override_problem(kind: Column, entry: Column, text: Column) -> Column:
    """Why an override is refused, or null."""
    return (
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "kind")
        .when(F.coalesce(F.octet_length(entry), F.lit(0)) == 0, "id")
        .when(F.octet_length(entry) > MOST_ID, "id length")
        .when(F.octet_length(text) > MOST_TEXT, "text length")
    )


def apply_overrides(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """entries (kind, id, description, …) with shown description; all overrides apply or, if any is refused, none does."""
    checked = overrides.withColumn("problem", override_problem(F.col("kind"), F.col("id"), F.col("override")))
    refused = checked.agg(F.coalesce(F.max(F.col("problem").isNotNull()), F.lit(False)).alias("refused"))
    usable = checked.crossJoin(F.broadcast(refused)).where("not refused").select("kind", "id", "override")
    return entries.join(usable, ["kind", "id"], "left").withColumn("shown", F.coalesce("override", "description")).withColumn("changed", ~F.col("shown").eqNullSafe(F.col("description")))


def definition_changes(versions: DataFrame, content: Column, entry: str = "id", version: str = "version") -> DataFrame:
    """(id, version, hash) where the content hash differs from that of the version registered before, or there is none. A version without a hash makes no event; as it is what is registered then, the next one that has a hash makes one, changed or not."""
    by = Window.partitionBy(entry).orderBy(version)
    hashed = versions.withColumn("hash", F.sha2(content, 256)).withColumn("_before", F.lag("hash").over(by))
    return hashed.where(F.col("hash").isNotNull() & (F.col("_before").isNull() | (F.col("hash") != F.col("_before")))).select(entry, version, "hash")


def definition(kind: Column, entry: Column, name: Column, description: Column, tags: Column, input_schema: Column, output_schema: Column, override: Column) -> Column:
    """Canonical JSON of a definition: nine fields, keys in order. The schemas come as canonical JSON or "null"; if one is a null column (not sound, or with an integer beyond doubles) there is no definition."""
    fields = (("description", json_string(description)), ("id", json_string(entry)), ("input_schema", input_schema), ("kind", json_string(kind)), ("name", json_string(name)), ("output_schema", output_schema), ("searchable_description", json_string(F.coalesce(override, description))), ("searchable_description_overridden", F.when(override.isNull(), "false").otherwise("true")), ("tags", json_strings(tags)))
    return F.concat(F.lit("{"), *(x for i, (k, v) in enumerate(fields) for x in (F.lit(f'{"," if i else ""}"{k}":'), v)), F.lit("}"))


#: The fields of a skill on the wire, and what no field's name may hold.
WIRE_FIELDS = ("id", "name", "description", "tags", "tools", "metadata", "body")
FORBIDDEN = ("token", "secret", "password", "apikey", "api_key", "credential", "bearer", "authorization", "privatekey", "private_key")


def wire_problems(payload: Column) -> Column:
    """What is wrong with a skill's JSON object on the wire: "missing x" for fields that it lacks, "forbidden x" for names that hold a forbidden word in any case, "unknown x" for all others that it shouldn't have. Null if it is no object."""
    keys = F.json_object_keys(payload)
    known = F.array(*map(F.lit, WIRE_FIELDS))
    missing = F.transform(F.array_except(known, keys), lambda k: F.concat(F.lit("missing "), k))
    bad = lambda k: F.exists(F.array(*map(F.lit, FORBIDDEN)), lambda f: F.lower(k).contains(f))
    others = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.when(bad(k), "forbidden ").otherwise("unknown "), k))
    return F.when(keys.isNotNull(), F.concat(missing, others))


def wire(skills: DataFrame) -> DataFrame:
    """The columns of skills that go on the wire, in their order."""
    return skills.select(*WIRE_FIELDS)


def pinned(facts: DataFrame) -> DataFrame:
    """Facts that are always shown, in order of registration."""
    return facts.where(F.col("pin") == "always").orderBy("seq")


def fact_problem(entry: Column, pin: Column) -> Column:
    return F.when(~F.coalesce(entry.rlike(FACT_ID), F.lit(False)), "id").when(~F.coalesce(pin, F.lit("retrieved")).isin(*PINS), "pin")


def snapshot(entries: DataFrame, columns: list[str]) -> DataFrame:
    """Definitions without executors, by id."""
    return entries.select(*columns).orderBy("id")


def resolve_scope(layers: DataFrame, subject: str | None = None) -> DataFrame:
    """The published set of a scope: the global layer, overlaid by the subject's; the subject wins on equal names, and an unknown subject has the global set.

    layers: (layer, subject, name, id, …)."""
    mine = F.col("layer") == "global"
    if subject is not None:
        mine = mine | (F.col("layer").eqNullSafe(F.lit("subject")) & F.col("subject").eqNullSafe(F.lit(subject)))
    own = layers.where(mine)
    rest = [c for c in own.columns if c != "name"]
    best = own.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct((F.col("layer") != "global").cast("int"), F.col("id"))).alias("_r"))
    return best.select("name", *(F.col(f"_r.{c}").alias(c) for c in rest)).orderBy("id")


def json_string(s: Column) -> Column:
    """A JSON string with the fewest escapes."""
    quoted = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        quoted = F.replace(quoted, F.lit(c), F.lit(e))
    for i in [*range(8), 11, *range(14, 32)]:
        quoted = F.replace(quoted, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def json_strings(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, json_string), ","), F.lit("]"))


def canonical_skill(entry: Column, name: Column, description: Column, override: Column, tags: Column, tools: Column, metadata: Column, body: Column) -> Column:
    """Canonical JSON of a skill: eight keys in fixed order, metadata keys by bytes, arrays as they are."""
    pairs = F.array_sort(F.map_entries(metadata))
    meta = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(json_string(p["key"]), F.lit(":"), json_strings(p["value"]))), ","), F.lit("}"))
    fields = (("id", json_string(entry)), ("name", json_string(name)), ("description", json_string(description)), ("searchableDescription", F.coalesce(json_string(override), F.lit("null"))), ("tags", json_strings(tags)), ("tools", json_strings(tools)), ("metadata", meta), ("body", json_string(body)))
    written = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *written), F.lit("}"))


def etag(skills: DataFrame, canonical: Column, by: list[str] | None = None) -> DataFrame:
    """The entity tag of a resolved set (of each group): SHA-256 of the canonical skills in order of id. A set is one group by its meaning."""
    rows = skills.select(*(by or []), F.struct("id", canonical.alias("c")).alias("s"))
    grouped = rows.groupBy(*(by or [])).agg(F.sort_array(F.collect_list("s")).alias("s"))
    text = F.concat(F.lit("["), F.array_join(F.transform("s", lambda s: s["c"]), ","), F.lit("]"))
    return grouped.select(*(by or []), F.size("s").cast("long").alias("n"), F.sha2(text, 256).alias("etag"))


def opaque(tag: Column) -> Column:
    """A tag without the weak mark and its quotes."""
    bare = F.trim(tag)
    bare = F.when(bare.startswith("W/"), F.trim(F.substr(bare, F.lit(3)))).otherwise(bare)
    quoted = (F.length(bare) >= 2) & bare.startswith('"') & bare.endswith('"')
    return F.when(quoted, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


def not_modified(header: Column, current: Column) -> Column:
    """Whether If-None-Match holds: weak comparison, comma list, star."""
    some = F.exists(F.split(header, ","), lambda t: (F.length(opaque(t)) > 0) & (opaque(t) == opaque(current)))
    return F.when(header.isNull(), F.lit(False)).when(F.trim(header) == "*", F.lit(True)).otherwise(some)
