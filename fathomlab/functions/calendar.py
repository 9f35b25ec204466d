"""Market calendar as columns: everything in the instrument's time zone, never the session's."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: US sessions (fixed values): code, name, first minute, end minute; the first that holds a minute counts.
US_SESSIONS = [(1, "open", 570, 600), (2, "morning", 600, 720), (3, "midday", 720, 840), (4, "afternoon", 840, 960), (5, "premarket", 240, 570), (6, "afterhours", 960, 1200)]


def local(ts: Column, tz: str) -> Column:
    """UTC wall time (TIMESTAMP_NTZ) as wall time of ``tz``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def to_utc(ts: Column, tz: Column | str) -> Column:
    """Wall time of ``tz`` as UTC wall time; summer time by the zone's rules."""
    return F.convert_timezone(F.lit(tz) if isinstance(tz, str) else tz, F.lit("UTC"), ts.cast("timestamp_ntz"))


def parts(ts: Column, tz: str) -> dict[str, Column]:
    """Calendar of an instant: session_date, year, month, day_of_month, day_of_week (ISO), hour, minute,
    minute_of_day, day_of_year."""
    at = local(ts, tz)
    return {
        "session_date": at.cast("date"), "year": F.year(at), "month": F.month(at), "day_of_month": F.dayofmonth(at), "day_of_week": F.weekday(at) + 1,
        "hour": F.hour(at), "minute": F.minute(at), "minute_of_day": F.hour(at) * 60 + F.minute(at), "day_of_year": F.dayofyear(at),
    }


def session_code(minute: Column) -> Column:
    """Code of the most specific session that holds a minute of the day, 0 outside all."""
    out = F.lit(0)
    for code, _, a, b in reversed(US_SESSIONS):
        out = F.when((minute >= a) & (minute < b), code).otherwise(out)
    return out


def parse_naive(date: Column, time: Column) -> Column:
    """Y.M.D, Y-M-D or D/M/Y with an optional H:M[:S]; null if it is none of them."""
    d = F.coalesce(F.try_to_date(F.regexp_replace(F.trim(date), r"\.", "-"), "yyyy-M-d"), F.try_to_date(F.trim(date), "d/M/yyyy"))
    t = F.when(F.length(F.trim(F.coalesce(time, F.lit("")))) == 0, "00:00:00").when(F.trim(time).rlike(r"^\d{1,2}:\d{2}$"), F.concat(F.trim(time), F.lit(":00"))).otherwise(F.trim(time))
    return F.when(d.isNotNull() & t.rlike(r"^\d{1,2}:\d{2}:\d{2}$"), F.try_to_timestamp(F.concat_ws(" ", d.cast("string"), t), F.lit("yyyy-MM-dd H:mm:ss"))).cast("timestamp_ntz")


def zone(name: str) -> str:
    """A zone for Spark: IANA names stay; UTC+h[:mm] becomes a fixed offset with its own sign."""
    import re

    m = re.fullmatch(r"(?:UTC|GMT)(?:([+-])(\d{1,2})(?::?(\d{2}))?)?", name.strip(), re.I)
    if not m:
        return name.strip()
    return f"{m[1]}{int(m[2]):02d}:{m[3] or '00'}" if m[1] else "UTC"
