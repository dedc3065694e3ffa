"""Leaves of JSON objects: every path to a scalar, an array or an empty object, with its text.

One pass of a parser over each text, in Arrow batches: opening objects level by level with variant expressions gives the
same map, and took fifteen times as long.
"""

from __future__ import annotations

import json
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Raw(float):
    """A number that remembers how it was written."""

    raw: str


def _number(text: str) -> float:
    out = _Raw(text)
    out.raw = text
    return out


def _whole_number(text: str) -> int | float:
    return int(text) if len(text) < 4000 else _number(text)


def _refused(text: str) -> None:
    raise ValueError(text)


def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    return value.raw if isinstance(value, _Raw) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def flatten(doc: str | None, depth: int = 8, whole: tuple[str, ...] = ()) -> dict[str, str] | None:
    """The leaves of one text under their dotted paths, in the order of the text; None if it is no JSON object."""
    try:
        top = json.loads(doc, parse_float=_number, parse_int=_whole_number, parse_constant=_refused) if doc else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, dict):
        return None
    out: dict[str, str] = {}

    def walk(value: object, path: tuple[str, ...]) -> None:
        if isinstance(value, dict) and value and len(path) < depth and not (len(path) == 1 and path[0] in whole):
            for key, inner in value.items():
                walk(inner, (*path, key))
        else:
            name = ".".join(path)
            out[json.dumps(path, separators=(",", ":"), ensure_ascii=False) if name in out else name] = _text(value)

    for key, value in top.items():
        walk(value, (key,))
    if "\\u" in doc:  # half a surrogate pair is no text
        return {k.encode("utf-16", "surrogatepass").decode("utf-16", "replace"): v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for k, v in out.items()}
    return out


def paths(doc: str | None) -> list[str] | None:
    """The distinct paths of non-null scalars, ``a.b`` and ``a[*].b``, that an extract can be made of; None if the text is no JSON."""
    try:
        top = json.loads(doc, parse_constant=_refused) if doc else None
    except (ValueError, RecursionError):
        return None
    out: dict[str, None] = {}
    open_: list[tuple[object, str]] = [(top, "")]
    while open_:
        value, path = open_.pop()
        if isinstance(value, dict):
            open_ += [(v, f"{path}.{k}" if path else k) for k, v in reversed(value.items()) if k and not set(k) & set(".[]'?*")]
        elif isinstance(value, list):
            open_ += [(v, path + "[*]") for v in reversed(value)]
        elif value is not None and path:
            out[path] = None
    return [p.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for p in out]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _paths(docs: pa.Array) -> pa.Array:
    return pa.array([paths(d) for d in docs.to_pylist()], pa.list_(pa.string()))


def leaf_paths(doc: Column) -> Column:
    return _paths(doc)


_MAP = pa.map_(pa.string(), pa.string())


@cache
def _flattener(depth: int, whole: tuple[str, ...]):
    @F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
    def run(docs: pa.Array) -> pa.Array:
        return pa.array([None if m is None else list(m.items()) for m in (flatten(d, depth, whole) for d in docs.to_pylist())], _MAP)

    return run


def flat_map(doc: Column, depth: int = 8, whole: tuple[str, ...] = ()) -> Column:
    """The leaves of a JSON object as a map from dotted paths to texts; null for a text that is no JSON object.

    Arrays and empty objects are leaves and keep their JSON; so does what lies under ``depth`` keys, and the top-level
    keys in ``whole``. Strings are unquoted, null is the empty text, numbers stay as written. The last of equal keys of an
    object counts. Of two leaves with one dotted path (``a.b`` beside ``a`` with ``b``) the second is named by its JSON path.
    """
    return _flattener(depth, tuple(whole))(doc)
