"""Date parsing and launch-calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings

_DAY_FIRST = ("d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy")


def parse_timestamp(c: Column) -> Column:
    """Day-first text or ISO text to a timestamp without zone, null when unreadable."""
    text = F.trim(c.cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in _DAY_FIRST]
    tries.append(text.try_cast("timestamp"))
    return F.coalesce(*tries).cast("timestamp_ntz")


def epoch_seconds(c: Column, now: Column) -> Column:
    """Seconds since the epoch; unreadable values take ``now`` (passed in, never the clock)."""
    parsed = c.cast("string").try_cast("timestamp")
    return F.coalesce(F.unix_timestamp(parsed), now)


def in_closed_days(c: Column, start, end) -> Column:
    """``start <= c < end + 1 day``; a plain range, so date partitions are pruned."""
    start, end = (x if isinstance(x, Column) else F.lit(x).cast("date") for x in (start, end))
    return (c >= start.cast("timestamp_ntz")) & (c < F.date_add(end, 1).cast("timestamp_ntz"))


def overlaps(start: Column, end: Column, period_start, period_end) -> Column:
    return (start <= F.lit(period_end).cast("date")) & (end >= F.lit(period_start).cast("date"))


def launch_periods(start: Column, settings: Settings = DEFAULTS) -> dict[str, Column]:
    """Capture, nurture and sales ranges (both ends included) from the capture start."""
    s = settings
    offsets = [s.capture_days, s.nurture_days, s.sales_days]
    names = ["capture", "nurture", "sales"]
    out, first = {}, 0
    for name, days in zip(names, offsets):
        out[f"{name}_start"] = F.date_add(start, first)
        out[f"{name}_end"] = F.date_add(start, first + days - 1)
        first += days
    return out


def sales_period(capture_end: Column, settings: Settings = DEFAULTS) -> dict[str, Column]:
    first = settings.nurture_days + 1
    return {
        "sales_start": F.date_add(capture_end, first),
        "sales_end": F.date_add(capture_end, first + settings.sales_days - 1),
    }


def period_flags(
    capture_start: Column,
    capture_end: Column,
    sales_start: Column,
    sales_end: Column,
    settings: Settings = DEFAULTS,
) -> dict[str, Column]:
    s = settings
    flags = {
        "capture_length_ok": F.datediff(capture_end, capture_start) + 1 == s.capture_days,
        "sales_length_ok": F.datediff(sales_end, sales_start) + 1 == s.sales_days,
        "gap_ok": F.datediff(sales_start, capture_end) - 1 == s.nurture_days,
        "capture_starts_tuesday": F.weekday(capture_start) == 1,
        "sales_start_monday": F.weekday(sales_start) == 0,
    }
    every = F.lit(True)
    for flag in flags.values():
        every = every & flag
    return {**flags, "all_ok": every}


def week_start(c: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", c).cast("date")
