"""Tool lists of upstream servers: pages of JSON to catalog entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: pages of one list.
MOST_PAGES = 64
PAGE = "tools array<struct<name:string, description:string, inputSchema:string, outputSchema:string>>, nextCursor string"


def pages(fetch: Callable[[str | None], dict]) -> list[dict]:
    """All pages of a list: an absent cursor ends it, an empty one doesn't, and one that comes again is an error."""
    found, cursor, seen = [], None, set()
    while len(found) < MOST_PAGES:
        page = fetch(cursor)
        found.append(page)
        cursor = page.get("nextCursor")
        if cursor is None:
            return found
        if cursor in seen:
            raise ValueError(f"cursor {cursor!r} comes again")
        seen.add(cursor)
    raise ValueError(f"more than {MOST_PAGES} pages")


def entries(raw: DataFrame) -> DataFrame:
    """(id, server, name, description, input_schema, output_schema) of raw pages (server, page, json). Schemas stay as written."""
    listed = raw.select("server", "page", F.from_json("json", PAGE).alias("p")).select("server", "page", F.posexplode("p.tools").alias("pos", "t"))
    return listed.select(
        F.concat("server", F.lit("__"), F.col("t.name")).alias("id"), "server", F.col("t.name").alias("name"), F.col("t.description").alias("description"),
        F.col("t.inputSchema").alias("input_schema"), F.col("t.outputSchema").alias("output_schema"), (F.col("page") * 1_000_000 + F.col("pos")).alias("seq"),
    )
