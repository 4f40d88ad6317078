"""Casts that exclude what is not plainly a value, where Spark's are laxer."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INSTANT = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def to_number(value: Column) -> Column:
    """Double, or null for anything but a decimal number."""
    return F.when(value.rlike(_NUMBER), value.try_cast("double"))


def to_instant(value: Column) -> Column:
    """Timestamp, or null for anything but a date or a date with a clock."""
    return F.when(value.rlike(_INSTANT), value.try_cast("timestamp"))


def number(text: str) -> float | None:
    return float(text) if re.match(_NUMBER, text) else None


def instant(text: str, zone: str = "") -> str | None:
    """A complete instant as a literal, with ``zone`` where it has none."""
    m = re.fullmatch(r"(\d{4}-\d{1,2}-\d{1,2})(?:[ T]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)(Z|[+-]\d{2}:?\d{2})?)?", text.strip())
    if not m:
        return None
    clock = m[2] or "00:00:00"
    return f"{m[1]} {clock if clock.count(':') == 2 else clock + ':00'}{m[3] or zone}"
