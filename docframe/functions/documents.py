"""Whole JSON documents: canonical form of any nesting, and edits by pointer that leave other bytes alone.

Both need a walk through nested text that no expression offers; each is a small
function over Arrow batches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DECODER = json.JSONDecoder()
_SPACE = re.compile(r"[ \t\r\n]*")


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("DuplicateField")
    return out


def _refuse(word: str):
    raise ValueError(word)


def canonical_double(x: float) -> str:
    """The shortest text of a double as ECMAScript writes it."""
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("UnsupportedValue")
    if x == 0:
        return "0"
    digits, _, exponent = repr(abs(x)).partition("e")
    whole, _, fraction = digits.partition(".")
    fraction = "" if fraction == "0" else fraction
    point = len(whole) + int(exponent or 0)
    digits = (whole + fraction).lstrip("0")
    point -= len(whole + fraction) - len(digits)
    digits = digits.rstrip("0") or "0"
    n = len(digits)
    if n <= point <= 21:
        text = digits + "0" * (point - n)
    elif 0 < point <= 21:
        text = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        e = point - 1
        text = digits[0] + ("." + digits[1:] if n > 1 else "") + "e" + ("+" if e > 0 else "-") + str(abs(e))
    return ("-" if x < 0 else "") + text


def _write(v) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(_write(k) + ":" + _write(v[k]) for k in sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_write, v)) + "]"
    if isinstance(v, bool) or v is None:
        return json.dumps(v)
    if isinstance(v, (int, float)):
        return canonical_double(float(v))
    v.encode()  # a lone surrogate has no form
    return json.dumps(v, ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """A JSON text in canonical form; null for texts that have none (invalid, repeated members, lone surrogates)."""

    def one(text: str) -> str | None:
        try:
            return _write(json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse))
        except (ValueError, RecursionError, OverflowError):
            return None

    return texts.map(one, na_action="ignore")


def pointer_steps(pointer: str) -> list[str]:
    """The steps of a JSON Pointer; ValueError if it is none."""
    if pointer and (not pointer.startswith("/") or re.search("~(?![01])", pointer)):
        raise ValueError("InvalidPointer")
    return [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]


def _parts(text: str, at: int) -> list[tuple[str | int, int, int, int]]:
    """Step, start of the entry, start and end of its value, for each child of the container at ``at``."""
    close = {"{": "}", "[": "]"}[text[at]]
    out, named, at = [], text[at] == "{", _SPACE.match(text, at + 1).end()
    while text[at] != close:
        entry = at
        step: str | int = len(out)
        if named:
            step, at = _DECODER.raw_decode(text, at)
            at = _SPACE.match(text, _SPACE.match(text, at).end() + 1).end()
        _, end = _DECODER.raw_decode(text, at)
        out.append((step, entry, at, end))
        at = _SPACE.match(text, end).end()
        if text[at] == ",":
            at = _SPACE.match(text, at + 1).end()
    return out


def edit(text: str, action: str, pointer: str, value: str | None) -> str:
    """``text`` with a value set, inserted or removed at a pointer; ValueError or KeyError if that cannot be."""
    json.loads(text)
    steps = pointer_steps(pointer)
    start = _SPACE.match(text).end()
    if not steps:
        if action != "set":
            raise KeyError(pointer)
        return text[:start] + value + text[_DECODER.raw_decode(text, start)[1] :]
    for step in steps[:-1]:
        start = next((v for s, _, v, _ in _children(text, start) if str(s) == step), None)
        if start is None:
            raise KeyError(pointer)
    children, last = _children(text, start), steps[-1]
    named = text[start] == "{"
    here = next((i for i, c in enumerate(children) if str(c[0]) == last), None)
    if action == "remove":
        if here is None:
            raise KeyError(pointer)
        if here + 1 < len(children):
            out = text[: children[here][1]] + text[children[here + 1][1] :]
        elif here:
            out = text[: children[here - 1][3]] + text[children[here][3] :]
        else:
            out = text[: children[0][1]] + text[children[0][3] :]
    elif action == "set" and here is not None:
        out = text[: children[here][2]] + value + text[children[here][3] :]
    else:
        made = (json.dumps(last, ensure_ascii=False) + ":" if named else "") + value
        if named and here is not None or not named and (last != "-" and (action == "set" or here is None and last != str(len(children)))):
            raise KeyError(pointer)
        if not named and here is not None:
            out = text[: children[here][1]] + made + "," + text[children[here][1] :]
        elif children:
            out = text[: children[-1][3]] + "," + made + text[children[-1][3] :]
        else:
            out = text[: start + 1] + made + text[start + 1 :]
    json.loads(out)
    return out


def _children(text: str, at: int) -> list:
    return _parts(text, at) if text[at] in "{[" else []


def edit_json(document: Column, action: str, pointer: str, value: Column | None = None) -> Column:
    """A JSON text edited at a pointer (set, insert, remove); null where the edit cannot be made.

    Bytes outside the edit stay as they are.
    """

    @F.pandas_udf(StringType())
    def run(texts: pd.Series, values: pd.Series) -> pd.Series:
        def one(text, v):
            try:
                return None if text is None else edit(text, action, pointer, v)
            except (ValueError, KeyError, IndexError, TypeError):
                return None

        return pd.Series([one(t, v) for t, v in zip(texts, values, strict=True)], dtype=object)

    return run(document, F.lit("null") if value is None else value)
