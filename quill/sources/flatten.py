"""JSON documents as rows of (path, value)."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.functions.batches import exploded

#: What marks a number among strings; no text has it by chance.
MARK = uuid.uuid4().hex
_MARKED = re.compile(f'"{MARK}([^"]*)"')


class Digits(str):
    """A number as it was written, behind the mark."""


def _number(digits: str) -> Digits:
    return Digits(MARK + digits)


def _written(value) -> str:
    """JSON text with numbers as they were written: dumped as marked strings, then bared."""
    return _MARKED.sub(r"\1", json.dumps(value, ensure_ascii=False))


def leaves(text: str) -> list[tuple[str, str | None]]:
    """Members of objects by dotted paths, elements of arrays of objects by index, other arrays as JSON text.

    Keys that are no identifiers stand in brackets; a root without a path of its own is `value`.
    """
    found: list[tuple[str, str | None]] = []
    open_ = [("", json.loads(text, parse_float=_number, parse_int=_number))]
    while open_:
        path, value = open_.pop()
        inner: list[tuple[str, object]] = []
        if isinstance(value, dict):
            for key, x in value.items():
                inner.append((f"{path}.{key}" if path else key, x) if key.isidentifier() else (f"{path}[{json.dumps(key, ensure_ascii=False)}]", x))
        elif isinstance(value, list) and all(isinstance(x, dict) for x in value):
            inner = [(f"{path or 'value'}[{i}]", x) for i, x in enumerate(value)]
        if inner:
            open_.extend(reversed(inner))
        else:
            found.append((path or "value", value if value is None or type(value) is str else _written(value)))
    return found


def flattened(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, value of every leaf; numbers keep their digits. Malformed JSON gives no rows."""

    def parsed(text: str | None) -> list[tuple[str, str | None]]:
        try:
            return [] if text is None else leaves(text)
        except ValueError:
            return []

    return exploded(df, [key], F.col(column), parsed, "path string, value string")
