"""Values in length-prefixed serialized form, as metadata tables of content systems hold them, to JSON and VARIANT."""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nesting beyond which a value counts as broken.
DEEPEST = 100
_SCALAR = re.compile(rb"(?:N|b:([01])|i:([+-]?\d+)|d:([^;{}]{1,40}));")
_SIZED = re.compile(rb"([sa]):(\d{1,10}):")


class Broken(ValueError):
    """What can't be read as a whole."""


def _read(data: bytes, at: int, depth: int) -> tuple[object, int]:
    """The value at a place, and where it ends. Lengths are bytes; a text may hold quotes and semicolons."""
    if m := _SCALAR.match(data, at):
        if m[1] is not None:
            return m[1] == b"1", m.end()
        if m[2] is not None:
            return int(m[2]), m.end()
        if m[3] is not None:
            try:
                number = float(m[3])
            except ValueError as e:
                raise Broken from e
            return (number if math.isfinite(number) else None), m.end()
        return None, m.end()
    m = _SIZED.match(data, at)
    if not m or depth > DEEPEST:
        raise Broken
    size, at = int(m[2]), m.end()
    if m[1] == b"s":
        end = at + 1 + size
        if data[at : at + 1] != b'"' or data[end : end + 2] != b'";':
            raise Broken
        return data[at + 1 : end].decode("utf-8", "replace"), end + 2
    # No entry takes fewer than six bytes, so a false size ends here, not in memory.
    if data[at : at + 1] != b"{" or size > len(data) // 6 + 1:
        raise Broken
    at, entries = at + 1, {}
    for _ in range(size):
        key, at = _read(data, at, depth + 1)
        if not isinstance(key, int | str) or isinstance(key, bool):
            raise Broken
        entries[key], at = _read(data, at, depth + 1)
    if data[at : at + 1] != b"}":
        raise Broken
    return (list(entries.values()) if list(entries) == list(range(size)) else {str(k): v for k, v in entries.items()}), at + 1


def to_json(text: str | None) -> str | None:
    """JSON of a serialized value: arrays with keys 0, 1, 2 ... are lists, others objects; null for objects of classes, references, and what is broken or has anything behind it."""
    try:
        data = (text or "").strip().encode("utf-8", "surrogatepass")
        value, end = _read(data, 0, 0)
        return json.dumps(value, ensure_ascii=False) if end == len(data) else None
    except (Broken, ValueError, RecursionError):
        return None


def unserialized(text: Column) -> Column:
    """A variant of serialized text, null where it is none."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([to_json(t) for t in column.to_pylist()], pa.string())

    # Only what starts like a serialized value goes to Python.
    return F.try_parse_json(run(F.when(text.rlike(r"^\s*(?:[sa]:\d+:|[bid]:|N;)"), text)))
