"""JSON in free text: a strict value, or the first object with a wanted key, in time linear in the text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT, RECOVERED, UNPARSEABLE = "strict_json", "recovered_object", "unparseable"
_TOKEN = re.compile(
    r"""[ \t\n\r]*+(?:(?P<mark>[{}\[\],:])
    |(?P<string>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")
    |(?P<plain>-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?|true|false|null))""",
    re.VERBOSE,
)
_SPACE = re.compile(r"[ \t\n\r]*+")


def _value(text: str, at: int, wanted: str, seen: dict[int, tuple[int, bool]]) -> int:
    """End of the JSON value at ``at``, -1 if there is none.

    ``seen`` takes every object met: its start, its end and whether it has the key. Objects still open
    at a fault cannot be read from their own start either, so they are kept with the end -1.
    """
    open_: list[list] = []  # [start, or -1 of an array; has the key]
    after = "value"
    while True:
        token = _TOKEN.match(text, at)
        if token is None:
            break
        at, mark = token.end(), token["mark"]
        if after == "colon":
            if mark != ":":
                break
            after = "value"
            continue
        if after in ("key", "key or end"):
            string = token["string"]
            if string is not None:
                if string[1:-1] == wanted or "\\" in string and json.loads(string) == wanted:
                    open_[-1][1] = True
                after = "colon"
                continue
            if mark != "}" or after == "key":
                break
        elif after == "comma or end":
            if mark == ",":
                after = "key" if open_[-1][0] >= 0 else "value"
                continue
            if mark != ("}" if open_[-1][0] >= 0 else "]"):
                break
        elif mark == "{":
            open_.append([at - 1, False])
            after = "key or end"
            continue
        elif mark == "[":
            open_.append([-1, False])
            after = "value or end"
            continue
        elif mark is not None and (mark != "]" or after != "value or end"):
            break
        if mark is not None:
            start, has = open_.pop()
            if start >= 0:
                seen[start] = at, has
        if not open_:
            return at
        after = "comma or end"
    for start, _ in open_:
        if start >= 0:
            seen[start] = -1, False
    return -1


def find(text: str | None, wanted: str) -> tuple[str, str | None]:
    """A status and the JSON: the whole text, or its first object that has the key ``wanted``.

    An object's start is read again only where an earlier reading took it for part of a string. Two
    readings that are alive at one place differ in what they take for strings, so a place is read at
    most twice, whatever the text.
    """
    if text is None:
        return UNPARSEABLE, None
    seen: dict[int, tuple[int, bool]] = {}
    end = _value(text, 0, wanted, seen)
    if end >= 0 and _SPACE.match(text, end).end() == len(text):
        return STRICT, text
    at = text.find("{")
    while at >= 0:
        if at not in seen:
            _value(text, at, wanted, seen)
        end, has = seen.pop(at)
        if has:
            return RECOVERED, text[at:end]
        at = text.find("{", at + 1)
    return UNPARSEABLE, None


def recovered(text: Column, wanted: str) -> Column:
    """struct(status, json) of each text; see ``find``.

    Null, empty and blank texts are unparseable. Numbers without a finite value (NaN, Infinity) are no
    JSON; depth and length have no limit; of equal keys one is enough.
    """

    @F.pandas_udf("status string, json string")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([find(t, wanted) for t in texts], columns=["status", "json"])

    return read(text)
