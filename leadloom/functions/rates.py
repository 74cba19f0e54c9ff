"""Rate arguments of the throttle."""

from __future__ import annotations

_PERIOD_SECONDS = {"second": 1, "minute": 60, "hour": 3600}


def parse_rate(spec: str) -> tuple[int, int]:
    """`"5/minute"` -> (5, 60)."""
    count, _, period = spec.partition("/")
    seconds = _PERIOD_SECONDS.get(period.strip().lower())
    if seconds is None:
        raise ValueError(f"invalid rate: {spec!r}")
    return int(count.strip()), seconds
