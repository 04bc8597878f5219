"""Published events within bounds: texts, lists and maps are cut, then what matters least goes until an event fits.

An event is JSON. It is made in steps, each smaller than the one before, and the first that fits is published:
texts of 4 KiB and lists and maps of 100; a definition without its larger schema, then without both; without
fields that tell nothing of the product, one by one; and at last only the fields every event has, with as many
others, cut to 512 bytes and maps of 32, as fit in their order, those that identify a definition first."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tidewright.sources.tracelog import MOST_ITEMS, MOST_PAYLOAD, MOST_STRING

# Fields of every event, those of a definition and of a schema, and what else tells of the product.
ENVELOPE = ("v", "event_id", "ts", "session_id", "source_id", "type")
CRITICAL, SCHEMAS = ("kind", "id", "name", "content_hash"), ("input_schema", "output_schema")
PRODUCT = frozenset((*CRITICAL, *SCHEMAS, *"description tags searchable_description searchable_description_overridden query target origin top_k hits outcome error error_class transport role cold agreement reason label score attributed rank turn action".split()))
ENDINGS = ("_id", "_ids", "_ms", "_count", "_score", "_scores")
SHORT_STRING, SHORT_ITEMS = 512, 32
CUT = "payload_truncated"


def size_of(value: Any) -> int:
    return len(json.dumps(value, separators=(",", ":")).encode())


def fits(value: Any) -> tuple[bool, str | None]:
    """Whether a value's JSON is within bounds, and its text if that is at hand. What has more characters than bytes are allowed isn't written out."""
    if _characters(value) > MOST_PAYLOAD:
        return False, None
    text = _written(value)
    if text.isascii() and "\x7f" not in text:  # nothing that is longer when it is escaped
        return len(text) <= MOST_PAYLOAD, text
    return size_of(value) <= MOST_PAYLOAD, text


def _characters(value: Any) -> int:
    """Of all texts in value."""
    match value:
        case str():
            return len(value)
        case list():
            return sum(_characters(x) for x in value)
        case dict():
            return sum(_characters(x) for x in value.values())
    return 0


def _written(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def shortened(value: Any, chars: int, items: int) -> Any:
    """value with texts of so many bytes, whole characters only, lists of MOST_ITEMS and maps of so many entries."""
    match value:
        case str():
            if value.isascii():
                return value if len(value) <= chars else value[:chars]
            raw = value.encode("utf-8", "surrogatepass")
            return value if len(raw) <= chars else raw[:chars].decode("utf-8", "ignore")
        case list():
            return [shortened(x, chars, items) for x in value[:MOST_ITEMS]]
        case dict():
            return {k: shortened(value[k], chars, items) for k in list(value)[:items]}
    return value


def of_product(name: str) -> bool:
    return name in PRODUCT or name.endswith(ENDINGS)


def _without(event: dict[str, Any], name: str) -> dict[str, Any]:
    return {k: v for k, v in event.items() if k != name} | {CUT: True}


def _steps(event: dict[str, Any]) -> Iterator[dict[str, Any]]:
    now = shortened(event, MOST_STRING, MOST_ITEMS)
    yield now
    defines = now.get("type") == "catalog_definition"
    if defines:
        for name in sorted((n for n in SCHEMAS if n in now), key=lambda n: -size_of({n: now[n]})):
            now = _without(now, name)
            yield now
    for name in [n for n in now if n not in ENVELOPE and not of_product(n) and n != CUT]:
        now = _without(now, name)
        yield now
    least = {n: now[n] for n in now if n in ENVELOPE} | {CUT: True}
    rest = [n for n in now if n not in ENVELOPE and of_product(n)]
    for name in sorted(rest, key=lambda n: CRITICAL.index(n) if defines and n in CRITICAL else len(CRITICAL)):
        more = least | {name: shortened(now[name], SHORT_STRING, SHORT_ITEMS)}
        if size_of(more) <= MOST_PAYLOAD:
            least = more
    yield least


def _first(event: dict[str, Any]) -> tuple[dict[str, Any], str | None]:
    made, text = {}, None
    for made in _steps(event):
        sound, text = fits(made)
        if sound:
            break
    return made, text


def sanitise(event: dict[str, Any]) -> dict[str, Any]:
    """The first step that fits, or the last."""
    return _first(event)[0]


def _column(raw: str | None) -> str | None:
    try:
        event = json.loads(raw) if raw is not None else None
    except ValueError:
        return None
    if not isinstance(event, dict):
        return None
    made, text = _first(event)
    return _written(made) if text is None else text


@pandas_udf(StringType())
def sanitised(raw: pd.Series) -> pd.Series:
    """JSON events within bounds; null for what is no JSON object."""
    return raw.map(_column, na_action=None)
