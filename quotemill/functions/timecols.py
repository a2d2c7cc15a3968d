"""Packed timestamps YYYYMMDDHHMMSSmmm as column expressions.  All arithmetic is within one day, in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _whole(c: Column, by: int, mod: int | None = None) -> Column:
    out = F.floor(c.cast("decimal(20,0)") / F.lit(by).cast("decimal(20,0)")).cast("long") if by > 1 else c.cast("long")
    return out if mod is None else F.pmod(out, F.lit(mod).cast("long"))


def ymd(ts: Column) -> Column:
    return _whole(ts, 10**9)


def year(ts: Column) -> Column:
    return _whole(ts, 10**13).cast("int")


def hour(ts: Column) -> Column:
    return _whole(ts, 10**7, 100).cast("int")


def minute(ts: Column) -> Column:
    return _whole(ts, 10**5, 100).cast("int")


def second(ts: Column) -> Column:
    return _whole(ts, 10**3, 100).cast("int")


def milli(ts: Column) -> Column:
    return _whole(ts, 1, 1000).cast("int")


def ms_of_day(ts: Column) -> Column:
    return hour(ts) * 3_600_000 + minute(ts) * 60_000 + second(ts) * 1000 + milli(ts)


def pack(day: Column, ms: Column) -> Column:
    """Packed timestamp of a YYYYMMDD day and milliseconds since its midnight."""
    ms = ms.cast("long")
    h, m = F.floor(ms / 3_600_000).cast("long"), F.floor(F.pmod(ms, F.lit(3_600_000)) / 60_000).cast("long")
    rest = F.pmod(ms, F.lit(60_000).cast("long"))
    return day.cast("long") * F.lit(10**9) + h * 10_000_000 + m * 100_000 + rest


def pack_parts(day: Column, h: Column, m: Column, s: Column, ms: Column) -> Column:
    return day.cast("long") * F.lit(10**9) + h.cast("long") * 10_000_000 + m.cast("long") * 100_000 + s.cast("long") * 1000 + ms.cast("long")


def add_ms(ts: Column, n: Column | int) -> Column:
    """True addition, also across hours and days."""
    return from_timestamp(F.timestamp_millis(F.unix_millis(to_timestamp(ts)) + n))


def same_day(a: Column, b: Column) -> Column:
    return ymd(a) == ymd(b)


def to_timestamp(ts: Column) -> Column:
    sec = (second(ts) * 1000 + milli(ts)).cast("decimal(8,3)") / F.lit(1000)
    return F.make_timestamp(year(ts), F.pmod(_whole(ts, 10**11), F.lit(100).cast("long")).cast("int"), F.pmod(ymd(ts), F.lit(100).cast("long")).cast("int"), hour(ts), minute(ts), sec.cast("decimal(16,6)"))


def from_timestamp(t: Column) -> Column:
    return F.date_format(t, "yyyyMMddHHmmssSSS").cast("long")


def day_text(day: Column) -> Column:
    """YYYYMMDD -> YYYY-MM-DD."""
    d = day.cast("string")
    return F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))
