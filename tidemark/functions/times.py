"""Zones, windows and datetime text."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1)


def ntz(value: datetime) -> Column:
    """A zone-less timestamp literal; it folds to a constant and so reaches the scan."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def cutoff(as_of: datetime, delay_minutes: int) -> datetime:
    """Rows younger than the delay stay hot, so that slow commits can still land."""
    return as_of - timedelta(minutes=delay_minutes)


def local_to_utc(ts: Column, zone: str) -> Column:
    """Read a zone-less local time as an instant and show it in UTC.

    The result does not depend on the session time zone.
    """
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


# Zoned windows. Converting every row would cost a zone lookup each and keep the comparison out of
# the scan. Far from a clock change (two days, more than any offset) it is the same to shift the
# bound instead, and almost every bound is. Next to a clock change local times can repeat or be
# missing; there a plain, wider bound goes to the scan and the converted time decides.
_SLACK = timedelta(days=2)


def local_bound(instant: datetime, zone: str | None) -> datetime | None:
    """The UTC bound as local time; None if the zone's offset changes around it."""
    if zone is None:
        return instant
    try:
        tz = ZoneInfo(zone)
    except ZoneInfoNotFoundError:
        return None
    hours = int(_SLACK / timedelta(hours=1))
    utc = instant.replace(tzinfo=timezone.utc)
    offsets = {(utc + timedelta(hours=h)).astimezone(tz).utcoffset()
               for h in range(-hours, hours + 1)}
    return instant + offsets.pop() if len(offsets) == 1 else None


def after(ts: Column, last: datetime, zone: str | None = None) -> Column:
    """``ts > last``; with a zone, ``ts`` is local and ``last`` is UTC."""
    bound = local_bound(last, zone)
    if bound is not None:
        return ts > ntz(bound)
    return (ts > ntz(last - _SLACK)) & (local_to_utc(ts, zone) > ntz(last))


def up_to(ts: Column, until: datetime, zone: str | None = None) -> Column:
    """``ts <= until``, zoned as in :func:`after`."""
    bound = local_bound(until, zone)
    if bound is not None:
        return ts <= ntz(bound)
    return (ts <= ntz(until + _SLACK)) & (local_to_utc(ts, zone) <= ntz(until))


def in_window(ts: Column, last: datetime, until: datetime, zone: str | None = None) -> Column:
    """``last < ts <= until``."""
    return after(ts, last, zone) & up_to(ts, until, zone)


def outside_window(ts: Column, last: datetime, until: datetime, zone: str | None = None) -> Column:
    """Every row that :func:`in_window` leaves, a missing time included, as a plain disjunction."""
    low, high = local_bound(last, zone), local_bound(until, zone)
    if low is not None and high is not None:
        return ts.isNull() | (ts <= ntz(low)) | (ts > ntz(high))
    # Not the same disjunction twice: the optimizer would take out what both have in common, and
    # the rest would no longer reach the scan.
    inside = in_window(ts, last, until, zone)
    return ((ts.isNull() | (ts <= ntz(last + _SLACK)) | (ts > ntz(until - _SLACK)))
            & ~F.coalesce(inside, F.lit(False)))


def iso_text(ts: Column) -> Column:
    """ISO datetime text, always with six fractional digits."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
