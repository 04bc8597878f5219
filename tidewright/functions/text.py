"""Text projections and tokenisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed-class words that carry no intent.
STOPWORDS = (
    "a an and are as at be but by did do does for from how i if in is it my of on or that the this to was "
    "what when where which why with you your"
).split()

#: Bounds of a shortened description: whole length, and the least place of a space to cut at.
MAX_DESCRIPTION, LEAST_HEAD = 160, 80


def split_identifier(s: Column) -> Column:
    """snake_case and camelCase as words: a space before an upper-case letter that follows a lower-case one, and for each underscore."""
    return F.replace(F.regexp_replace(s, r"(?<=\p{Ll})(?=\p{Lu})", " "), F.lit("_"), F.lit(" "))


def push_identifier(s: Column) -> Column:
    """The identifier, followed by its split form if that differs."""
    words = split_identifier(s)
    return F.when(words == s, s).otherwise(F.concat_ws(" ", s, words))


def described(override: Column, description: Column) -> Column:
    """An override replaces the description even if it is empty; only null doesn't."""
    return F.coalesce(override, description)


def entry_projection(name: Column, description: Column, tags: Column, override: Column | None = None) -> Column:
    """Searchable text of a skill or fact: name, description or override, and tags that aren't empty."""
    shown = description if override is None else described(override, description)
    return F.concat_ws(" ", push_identifier(name), shown, F.array_join(F.transform(F.filter(tags, lambda t: t != ""), push_identifier), " "))


def tool_projection(name: Column, description: Column, input_schema: Column, output_schema: Column, override: Column | None = None) -> Column:
    """Searchable text of a tool: name, description or override, and what its input and its output schema (JSON) say."""
    from tidewright.functions.schema_walk import schema_text

    shown = description if override is None else described(override, description)
    said = lambda schema: F.when(F.coalesce(F.length(schema), F.lit(0)) > 0, schema)
    return F.concat_ws(" ", push_identifier(name), shown, said(schema_text(input_schema)), said(schema_text(output_schema)))


def usage_tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs without stop words, in order, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda t: ~t.isin(*STOPWORDS))


def usage_token_set(text: Column) -> Column:
    return F.array_distinct(usage_tokens(text))


def compact_description(s: Column) -> Column:
    """White space collapsed; a text of more than 160 characters is cut at the last space past the 80th, and ends in an ellipsis."""
    flat = F.trim(F.regexp_replace(s, r"\s+", " "))
    cut = F.substring(flat, 1, MAX_DESCRIPTION - 1)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    head = F.when((F.instr(cut, " ") > 0) & (last > LEAST_HEAD), F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(flat) <= MAX_DESCRIPTION, flat).otherwise(F.concat(F.rtrim(head), F.lit("…")))


def server_of(tool_id: Column) -> Column:
    """What stands before the first double underscore, unless that is nothing; else the whole id."""
    return F.when(F.instr(tool_id, "__") > 1, F.substring_index(tool_id, "__", 1)).otherwise(tool_id)


def auth_server_of(tool_id: Column) -> Column:
    """As server_of, but null for an id without a server."""
    return F.when(F.instr(tool_id, "__") > 1, F.substring_index(tool_id, "__", 1))


def upstream_line(name: Column, description: Column, tool_count: Column, needs_auth: Column) -> Column:
    """A list line for an upstream server."""
    return F.concat(
        F.lit("- "), name,
        F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(" — "), compact_description(description))).otherwise(F.lit("")),
        F.when(tool_count.isNotNull(), F.concat(F.lit(" ("), tool_count.cast("string"), F.lit(" tools)"))).otherwise(F.lit("")),
        F.when(F.coalesce(needs_auth, F.lit(False)), F.lit(" (auth required)")).otherwise(F.lit("")),
    )
