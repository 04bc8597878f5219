"""The searchable text of a JSON schema, and canonical JSON: order and escapes matter, so the raw string is walked."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

SAFE_INTEGER = 2**53 - 1


def _identifier(name: str) -> list[str]:
    words = "".join((" " + c if i and c.isupper() and name[i - 1].islower() else c) for i, c in enumerate(name)).replace("_", " ")
    return [name] if words == name else [name, words]


def walk(schema: object) -> list[str]:
    """Property names, descriptions and string enum values, in the author's order; properties and items are followed."""
    said: list[str] = []
    todo: list[object] = [schema]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            said.append(at)
        elif isinstance(at, dict):
            properties, later = at.get("properties"), []
            if isinstance(properties, dict):
                for name, inner in properties.items():
                    later += _identifier(name)
                    if isinstance(inner, dict):
                        if isinstance(inner.get("description"), str):
                            later.append(inner["description"])
                        if isinstance(inner.get("enum"), list):
                            later += [x for x in inner["enum"] if isinstance(x, str)]
                        later.append(inner)
            if isinstance(at.get("items"), dict):
                later.append(at["items"])
            todo += reversed(later)
    return said


def _schema_text(raw: str | None) -> str:
    try:
        return " ".join(walk(json.loads(raw))) if raw else ""
    except ValueError:
        return ""


def _unsafe(x: object) -> bool:
    if isinstance(x, dict):
        return any(map(_unsafe, x.values()))
    if isinstance(x, list):
        return any(map(_unsafe, x))
    return isinstance(x, int) and not isinstance(x, bool) and abs(x) > SAFE_INTEGER


def canonical(raw: str | None) -> str | None:
    """JSON with keys by UTF-16 order and no white space; null for what isn't JSON or holds an integer that doubles can't."""
    if raw is None:
        return None
    try:
        value = json.loads(raw)
    except ValueError:
        return None
    return None if _unsafe(value) else write_canonical(value)


def write_canonical(x: object) -> str:
    if isinstance(x, dict):
        return "{" + ",".join(f"{write_canonical(k)}:{write_canonical(v)}" for k, v in sorted(x.items(), key=lambda kv: kv[0].encode("utf-16-be"))) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(write_canonical, x)) + "]"
    if isinstance(x, float):
        if x == int(x) and abs(x) < 1e21:
            return str(int(x))
        mantissa, _, exponent = repr(x).partition("e")
        return mantissa if not exponent else f"{mantissa.removesuffix('.0')}e{int(exponent):+d}"
    return json.dumps(x, ensure_ascii=False)


@pandas_udf(StringType())
def schema_text(raw: pd.Series) -> pd.Series:
    return raw.map(_schema_text, na_action=None)


@pandas_udf(StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    return raw.map(canonical, na_action=None)
