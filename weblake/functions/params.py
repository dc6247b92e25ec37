"""Values of requests: lists, times, paths and percentages."""

from __future__ import annotations

import base64
import binascii
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_list(value: str) -> list[str]:
    """A comma-separated list, trimmed, without empty parts."""
    return [x for x in map(str.strip, value.split(",")) if x]


def split_list_column(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), F.trim), lambda x: x != "")


def end_after(inclusive: int) -> int:
    """The exclusive end of a range whose last second is given; 0 stays open."""
    return inclusive + 1 if inclusive else 0


def local_day(day: date, zone: str = "UTC") -> int:
    """The second a day begins."""
    return int(datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)).timestamp())


def day_range(first: date, last: date, zone: str = "UTC") -> tuple[int, int]:
    """[start, end) of the days from first to last."""
    return local_day(first, zone), local_day(last + timedelta(days=1), zone)


def encode_path(path: str) -> str:
    return "b64_" + base64.urlsafe_b64encode(path.encode()).decode().rstrip("=")


def decode_path(value: str) -> str:
    """A path parameter; one that is not a valid encoding is taken as it is."""
    if not value.startswith("b64_"):
        return value
    try:
        text = base64.b64decode(value[4:] + "=" * (-len(value[4:]) % 4), b"-_", validate=True).decode()
    except (binascii.Error, UnicodeDecodeError):
        return value
    return value if "\0" in text else text


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, 100.0 * part / total).otherwise(0.0)


def minute_of(seconds: Column) -> Column:
    return seconds - F.pmod(seconds, F.lit(60))


def hour_of(seconds: Column) -> Column:
    return seconds - F.pmod(seconds, F.lit(3600))


def local_date(seconds: Column) -> Column:
    """The date in the session's zone."""
    return F.to_date(F.timestamp_seconds(seconds))
