"""Durations and times as options give them."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

# Microseconds of each unit.
UNITS = {"ns": 0.001, "us": 1, "µs": 1, "ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h|d)")


def parse_duration(text: str) -> timedelta:
    """Numbers with units end to end, such as 1d12h or -30m; 0 needs no unit."""
    body = text.strip()
    sign = -1 if body.startswith("-") else 1
    body = body.lstrip("+-")
    if body == "0":
        return timedelta(0)
    parts = _PART.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"{text!r} is no duration")
    return sign * timedelta(microseconds=sum(float(n) * UNITS[u] for n, u in parts))


def parse_time(text: str, now: datetime, end_of_day: bool = False) -> datetime:
    """A date (its last second if asked for), a time with offset, or a positive duration before ``now``; in UTC without an offset."""
    text = text.strip()
    if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        day = datetime.fromisoformat(text)
        return day + timedelta(hours=23, minutes=59, seconds=59) if end_of_day else day
    if re.match(r"\d{4}-\d\d-\d\dT", text):
        when = datetime.fromisoformat(text)
        if when.tzinfo is None:
            raise ValueError(f"{text!r} has no offset")
        return when.astimezone(timezone.utc).replace(tzinfo=None)
    back = parse_duration(text)
    if back <= timedelta(0):
        raise ValueError("a relative time must be positive")
    return now - back
