"""JSON Schema validation: errors of an instance in a fixed order, for records that no table schema can check."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"object": dict, "array": list, "string": str, "null": type(None), "boolean": bool}


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or float(value).is_integer())
    return isinstance(value, _TYPES[kind])


def _same(a: object, b: object) -> bool:
    """Equality of JSON values: true is not 1."""
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def _resolved(schema: dict, roots: dict[str, dict], root: str) -> tuple[dict, str]:
    """A reference followed: ``#/...`` within the same document, or the id of another one with a pointer."""
    name, _, pointer = schema["$ref"].partition("#")
    name = name or root
    found: object = roots[name]
    for part in pointer.strip("/").split("/") if pointer.strip("/") else []:
        found = found[part.replace("~1", "/").replace("~0", "~")]
    return found, name


def _broken(value: object, schema: dict) -> Iterator[str]:
    """Keywords of a schema that concern the value itself and that it breaks."""
    kinds = schema.get("type", [])
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield "type"
    if "enum" in schema and not any(_same(value, e) for e in schema["enum"]):
        yield "enum"
    if "const" in schema and not _same(value, schema["const"]):
        yield "const"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            yield "length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield "pattern"
    if _is(value, "number") and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        yield "range"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            yield "items"
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            yield "unique"
    if isinstance(value, dict):
        yield from (f"required {k}" for k in schema.get("required", []) if k not in value)
        if schema.get("additionalProperties") is False:
            known = schema.get("properties", {})
            extra = [k for k in value if k not in known and not any(re.search(p, k) for p in schema.get("patternProperties", {}))]
            yield from (f"unknown {k}" for k in extra)


def errors(value: object, schema: dict | bool, roots: dict[str, dict] | None = None, root: str = "", at: tuple = ()) -> Iterator[tuple[tuple, str]]:
    """(path, keyword) of each rule that an instance breaks. Handles types, enumerations, lengths, patterns, ranges,
    items, properties, required and unknown keys, combinations, conditions and references."""
    roots = {"": schema} if roots is None else roots
    if schema is False:
        yield at, "never"
    if isinstance(schema, bool):
        return
    inner = lambda s, v=value, p=at: list(errors(v, s, roots, root, p))
    if "$ref" in schema:
        target, name = _resolved(schema, roots, root)
        yield from errors(value, target, roots, name, at)
    yield from ((at, k) for k in _broken(value, schema))
    for s in schema.get("allOf", []):
        yield from inner(s)
    if "anyOf" in schema and all(map(inner, schema["anyOf"])):
        yield at, "anyOf"
    if "oneOf" in schema and sum(not inner(s) for s in schema["oneOf"]) != 1:
        yield at, "oneOf"
    if "not" in schema and not inner(schema["not"]):
        yield at, "not"
    if "if" in schema:
        branch = "else" if inner(schema["if"]) else "then"
        yield from inner(schema.get(branch, True))
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            yield from errors(v, schema["items"], roots, root, (*at, k))
    if isinstance(value, dict):
        rest = schema.get("additionalProperties", True)
        for k, v in value.items():
            own = [schema["properties"][k]] if k in schema.get("properties", {}) else []
            own += [s for p, s in schema.get("patternProperties", {}).items() if re.search(p, k)]
            for s in own or [rest if isinstance(rest, dict) else True]:
                yield from errors(v, s, roots, root, (*at, k))


def messages(text: str | None, schema: dict, roots: dict[str, dict] | None = None) -> list[str]:
    """Errors of a JSON text as ``path: keyword``, by path; a text that is no JSON has one error."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return ["(root): not JSON"]
    found = sorted(errors(value, schema, roots), key=lambda e: ([str(p) for p in e[0]], e[1]))
    return ["/".join(map(str, at)) + ": " + what if at else "(root): " + what for at, what in found]


def schema_errors(schema: dict, roots: dict[str, dict] | None = None):
    """``messages`` as a function of a column of JSON texts."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: messages(t, schema, roots))

    return run
