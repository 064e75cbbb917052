"""Literals, patterns and times, as the two query surfaces read them."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's float() accepts, but for inf and nan.
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
#: Time formats tried after ISO, in this order; a fraction has one to six digits. Fixed values.
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy/MM/dd HH:mm:ss.SSSSSS",
    "yyyy/MM/dd'T'HH:mm:ss.SSSSSS",
)


def sql_literal(token: str) -> Any:
    """A literal of the SQL dialect: null, booleans, integers, plain decimals, quoted strings; all else is a string."""
    token = token.strip()
    if len(token) >= 2 and token[0] == token[-1] and token[0] in "'\"":
        return token[1:-1]
    if token.lower() in ("null", "none"):
        return None
    if token.lower() in ("true", "false"):
        return token.lower() == "true"
    if re.fullmatch(r"-?\d+", token):
        return int(token)
    if re.fullmatch(r"-?\d*\.\d+", token):
        return float(token)
    return token


def selection_literal(value: Any) -> Any:
    """A literal of an attribute selection: also ``5.`` is a number."""
    if not isinstance(value, str):
        return value
    text = value.strip()
    if text.lower() in ("null", "none"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text and set(text) <= set("-0123456789."):
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                continue
    return text


def number(value: Column) -> Column:
    """The value as a double where Python's float() would take it; else null (``5d`` is no number)."""
    text = value.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def wildcard(pattern: str) -> str:
    """An anchored regular expression for a glob: * or % for any run, ? or _ for one character, \\ escapes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.sub(r"([^A-Za-z0-9])", r"\\\1", pattern[i]) if pattern[i].isascii() else pattern[i])
        elif c in "*%":
            out.append(".*")
        elif c in "?_":
            out.append(".")
        else:
            out.append(re.sub(r"([^A-Za-z0-9])", r"\\\1", c) if c.isascii() else c)
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def split_outside(text: str, sign: str = ",") -> list[str]:
    """Split at ``sign`` outside quotes and parentheses."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == sign and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return [*parts, text[start:].strip()]


def epoch_seconds(value: Column) -> Column:
    """Seconds since 1970: numbers (milliseconds above 1e11), numeric text, ISO times (naive ones in UTC), eight formats."""
    text = F.trim(value.cast("string"))
    n = number(text)
    iso = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(text))
    parsed = F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])
    return F.when(n.isNotNull(), F.when(F.abs(n) > 1e11, n / 1000).otherwise(n)).otherwise(F.unix_micros(parsed) / 1e6)


def parse_point(value: Any) -> tuple[float, float] | None:
    """(x, y) of {x|lng|lon|longitude, y|lat|latitude} or [x, y]; null where it is neither."""
    try:
        if isinstance(value, dict):
            x = next(value[k] for k in ("x", "lng", "lon", "longitude") if k in value)
            y = next(value[k] for k in ("y", "lat", "latitude") if k in value)
            return float(x), float(y)
        return float(value[0]), float(value[1])
    except (StopIteration, TypeError, ValueError, IndexError, KeyError):
        return None
