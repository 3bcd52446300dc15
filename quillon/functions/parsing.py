"""Argument parsers: score and time bounds, sizes, names, and index arithmetic."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

I64_MIN, I64_MAX = -(1 << 63), (1 << 63) - 1
UNITS = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}


def score_bound(text: str | float, strict: bool = True) -> tuple[float, bool]:
    """(value, exclusive) of ``5``, ``(5``, ``-inf``, ``+inf``. Strictly, other text is an
    error and ``(`` excludes the bound; otherwise it is infinite on the caller's side (nan
    here) and ``(`` is dropped."""
    if isinstance(text, (int, float)):
        return float(text), False
    body = text.removeprefix("(")
    try:
        value = float(body)
    except ValueError:
        if strict:
            raise ValueError(f"no score: {text}") from None
        value = math.nan
    return value, strict and body != text


def timestamp(text: str | int, now_ms: int | None = None) -> int:
    """Milliseconds of an integer, ``*`` (now_ms), ``-`` (least) or ``+`` (greatest)."""
    if text == "*":
        if now_ms is None:
            raise ValueError("* needs the present time")
        return now_ms
    if text in ("-", "+"):
        return I64_MIN if text == "-" else I64_MAX
    return int(text)


def memory_size(text: str) -> int:
    """Bytes of ``256MB``, ``1GB``, ``1024KB``, ``1024``."""
    m = re.fullmatch(r"\s*(\d+)\s*([KMG]?B)?\s*", text.upper())
    if not m:
        raise ValueError(f"no size: {text}")
    return int(m[1]) * UNITS[m[2] or "B"]


def format_size(n: int) -> str:
    """``1.50 MB``: two digits in the largest unit that fits."""
    for unit in ("GB", "MB", "KB"):
        if n >= UNITS[unit]:
            return f"{n / UNITS[unit]:.2f} {unit}"
    return f"{n} B"


def namespace_name(name: str) -> str:
    """The name, if it is 1 to 64 letters, digits, ``_`` or ``-``."""
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", name):
        raise ValueError(f"no namespace name: {name!r}")
    return name


def glob_filter(key: Column, pattern: str) -> Column:
    """``*``; one ``*`` as prefix, suffix or both; else equality."""
    if pattern == "*":
        return F.lit(True)
    if pattern.count("*") == 1:
        head, tail = pattern.split("*")
        return key.startswith(head) & key.endswith(tail) & (F.octet_length(key) >= len((head + tail).encode()))
    return key == pattern


def strict_int(text: Column) -> Column:
    """A 64-bit integer without blanks around it, else null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def list_bounds(n: Column, start: int, stop: int) -> tuple[Column, Column]:
    """Inclusive bounds of a list slice; empty where the first is beyond the second."""
    low = F.greatest(F.lit(0), n + start) if start < 0 else F.lit(start)
    high = n + stop if stop < 0 else F.least(n - 1, F.lit(stop))
    return low.cast("bigint"), high.cast("bigint")


def rank_bounds(n: Column, start: int, stop: int) -> tuple[Column, Column]:
    """Inclusive bounds of a rank slice."""
    low = F.greatest(F.lit(0), n + start) if start < 0 else F.least(F.lit(start), n)
    high = F.greatest(F.lit(-1), n + stop) if stop < 0 else F.least(F.lit(stop), n - 1)
    return low.cast("bigint"), high.cast("bigint")
