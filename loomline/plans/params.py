"""What a caller fixes instead of the clock and the dashboard's variables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """t0 to t1 is a closed range; as_of stands for now; step is a bucket length."""

    t0: str = "2024-01-01 00:00:00"
    t1: str = "2024-01-31 00:00:00"
    as_of: str = "2024-01-31 00:00:00"
    step: str = "1 hour"
    max_age_seconds: int = 120


DEFAULT = Params()
#: The orders' dates lie before those of the events; all of them are in the range.
ORDERS = Params(t0="1995-01-01 00:00:00", t1="2001-12-31 00:00:00", as_of="2024-01-31 00:00:00", step="1 day")
