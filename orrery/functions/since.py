"""The grammar of points in time in questions: a commit, a relative time or a date."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

# Lengths of units in milliseconds; a month has 30 days, a year 365.
UNITS = {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_592_000_000, "year": 31_536_000_000}
SHORT = {"m": "minute", "min": "minute", "h": "hour", "hr": "hour", "d": "day", "w": "week", "mo": "month", "y": "year", "yr": "year"}


class Since(NamedTuple):
    """``kind``: commit, relative or date; ``commit`` a hash prefix, or ``cutoff`` in milliseconds of the epoch."""

    kind: str
    commit: str | None
    cutoff: int | None


def parse_since(text: str, now: datetime | None = None) -> Since:
    """Hex of 4 to 40 signs is a commit (eight digits too), then relative times such as ``2w`` or ``1 week ago``, then dates."""
    value = text.strip()
    if re.fullmatch(r"[0-9a-fA-F]{4,40}", value):
        return Since("commit", value.lower(), None)
    now = now or datetime.now(timezone.utc)
    m = re.fullmatch(r"(\d+)\s*([A-Za-z]+)(?:\s+ago)?", value)
    if m:
        unit = m.group(2).lower()
        unit = SHORT.get(unit, unit[:-1] if unit.endswith("s") and unit[:-1] in UNITS else SHORT.get(unit.rstrip("s"), unit))
        if unit in UNITS:
            cutoff = now - timedelta(milliseconds=int(m.group(1)) * UNITS[unit])
            return Since("relative", None, int(cutoff.timestamp() * 1000))
    m = re.match(r"^\d{4}-\d{2}-\d{2}", value)
    if m:
        try:
            when = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError as e:
            raise ValueError(f"not a date: {text!r}") from e
        when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
        return Since("date", None, int(when.timestamp() * 1000))
    raise ValueError(f"not a commit, a relative time or a date: {text!r}")
