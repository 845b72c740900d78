"""Structural difference of two JSON documents as a set of key paths: the one vectorized helper of the library."""

import json
import re
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NESTING = 64
_SKIP = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.S)
_COMMA = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', re.S)


def _bad_constant(name: str):
    raise ValueError(name)


def _depth(text: str) -> int:
    level = most = 0
    for mark in re.findall(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', text, re.S):
        if mark in "[{":
            level += 1
            most = max(most, level)
        elif mark in "]}":
            level -= 1
    return most


def parse(text: str):
    """A document; ValueError where it is none. Comments and trailing commas are taken out if it needs that."""
    read = json.JSONDecoder(parse_float=Decimal, parse_int=Decimal, parse_constant=_bad_constant).decode
    if _depth(text) > MAX_NESTING:
        raise ValueError("nested too deep")
    try:
        return read(text)
    except ValueError:
        keep = lambda m: m.group(1) or " "
        return read(_COMMA.sub(lambda m: m.group(1) or "", _SKIP.sub(keep, text)).strip())


def _below(path: str, key: str) -> str:
    return f"{path}.{key}" if path else key


def _kind(x):
    return bool if isinstance(x, bool) else type(x)


def _same(x, y) -> bool:
    """Equality of values; true and 1 differ, 1 and 1.0 don't."""
    if _kind(x) is not _kind(y):
        return False
    if isinstance(x, dict):
        return x.keys() == y.keys() and all(_same(v, y[k]) for k, v in x.items())
    if isinstance(x, list):
        return len(x) == len(y) and all(map(_same, x, y))
    return x == y


def changed_paths(before, after, depth: int = 3) -> set[str]:
    """Paths of what differs: keys joined by dots, [] for any element, $ for the whole. At most `depth` keys deep;
    what differs further down counts for its ancestor. Array elements are compared in place and take no depth."""
    found: set[str] = set()
    # pairs still to compare; a missing side means that all the leaf paths of the other count
    missing = object()
    todo = [(before, after, "", 0)]
    while todo:
        x, y, path, level = todo.pop()
        one = y if x is missing else x
        lone = x is missing or y is missing
        if not lone and _same(x, y):
            continue
        inner = level < depth and (lone or _kind(x) is _kind(y))
        if inner and isinstance(one, dict):
            if lone:
                todo += [(v, missing, _below(path, k), level + 1) for k, v in one.items()]
            else:
                found |= {_below(path, k) for k in x.keys() ^ y.keys()}
                todo += [(x[k], y[k], _below(path, k), level + 1) for k in x.keys() & y.keys()]
        elif inner and isinstance(one, list):
            if lone:
                todo += [(v, missing, path + "[]", level) for v in one]
            else:
                n = min(len(x), len(y))
                todo += [(v, w, path + "[]", level) for v, w in zip(x, y)]
                todo += [(v, missing, path + "[]", level) for v in (x[n:] or y[n:])]
        else:
            found.add(path or "$")
    return found


def diff(before: str | None, after: str | None, depth: int = 3, max_facets: int = 64) -> list[str] | None:
    """Sorted changed paths; None where a side is missing or no JSON, or more than max_facets changed."""
    if before is None or after is None:
        return None
    try:
        found = changed_paths(parse(before), parse(after), depth)
    except (ValueError, ArithmeticError, RecursionError):
        return None
    return sorted(found) if len(found) <= max_facets else None


def json_changed_facets(before, after, depth: int = 3, max_facets: int = 64) -> Column:
    """array<string> column of changed paths, null where the change can't be tracked. Row-local, Arrow-batched."""

    @F.arrow_udf("array<string>")
    def facets(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([diff(x.as_py(), y.as_py(), depth, max_facets) for x, y in zip(a, b)], pa.list_(pa.string()))

    return facets(before, after)
