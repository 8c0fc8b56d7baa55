"""Date, time and duration functions as Column builders.

Durations are text (``P1DT2H``) at the edges, seconds or months as numbers inside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MS = {"day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000}


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` in which ``value`` is computed once, however often ``f`` names it; nested functions would multiply otherwise."""
    return F.element_at(F.transform(F.array(value), f), 1)


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def parse_date(text: Column) -> Column:
    """Milliseconds since 1970 of an ISO text; null where it is none."""
    return F.unix_millis(F.try_to_timestamp(text))


def diff_minutes(a: Column, b: Column) -> Column:
    """Absolute, rounded half up."""
    return F.floor(F.abs(millis(a) - millis(b)) / 60_000.0 + 0.5)


def diff_hours(a: Column, b: Column) -> Column:
    return F.round(F.abs(millis(a) - millis(b)) / 3_600_000.0, 2)


def between(a: Column, b: Column, unit: str) -> Column:
    """Signed whole units from ``a`` to ``b``, floored; hours are exact."""
    raw = (millis(b) - millis(a)) / F.lit(float(MS[unit]))
    return raw if unit == "hour" else F.floor(raw)


#: The letters of a format and Spark's.
LETTERS = {"YYYY": "yyyy", "DD": "dd"}


def format_date(ts: Column, pattern: str) -> Column:
    for a, b in LETTERS.items():
        pattern = pattern.replace(a, b)
    return F.date_format(ts, pattern)


def part_of_text(text: Column, unit: str) -> Column:
    """Year, month, day, hours, minutes or seconds as written; the zone is not applied."""
    groups = {"year": 1, "month": 2, "day": 3, "hours": 4, "minutes": 5, "seconds": 6}
    found = F.regexp_extract(text, r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?", groups[unit])
    return found.try_cast("double") if unit == "seconds" else found.try_cast("int")


def zone(text: Column) -> Column:
    """``Z``, ``+02:00`` or the empty text."""
    return F.regexp_extract(text, r"(Z|[+-]\d\d:\d\d)$", 1)


def number(digits: Column, kind: str) -> Column:
    """Digits as a number; none, or too many, are zero.  A leading zero keeps the empty text from failing in the cast, which is slow."""
    return F.coalesce(F.concat(F.lit("0"), digits).try_cast(kind), F.lit(0).cast(kind))


def _part(text: Column, letter: str, time: bool) -> Column:
    head = r"^-?P(?:\d+Y)?(?:\d+M)?" if not time else r"^-?P[^T]*T"
    body = {"D": r"(\d+)D", "H": r"(\d+)H", "M": r"(?:\d+H)?(\d+)M", "S": r"(?:\d+H)?(?:\d+M)?(\d+(?:\.\d+)?)S"}[letter]
    return number(F.regexp_extract(text, head + body, 1), "double")


def is_day_time(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^-?P(?=\d|T\d)(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$"))


def seconds_of(text: Column) -> Column:
    """Seconds of a dayTimeDuration text; null where it is none."""

    def read(t: Column) -> Column:
        total = _part(t, "D", False) * 86400 + _part(t, "H", True) * 3600 + _part(t, "M", True) * 60 + _part(t, "S", True)
        return F.when(is_day_time(t), once(total, lambda n: F.when(t.startswith("-"), -n).otherwise(n)))

    return once(text, read)


def duration_text(seconds: Column) -> Column:
    """``P1DT2H3M4S`` of a number of seconds; whole seconds only, zero is ``PT0S``."""
    piece = lambda v, u: F.when(v > 0, F.concat(v.cast("string"), F.lit(u))).otherwise("")

    def write(signed: Column) -> Column:
        n = F.abs(signed).cast("long")
        d, h = F.floor(n / 86400), F.floor(n % 86400 / 3600)
        m, s = F.floor(n % 3600 / 60), n % 60
        time = once(F.concat(piece(h, "H"), piece(m, "M"), piece(s, "S")), lambda t: F.when(t != "", F.concat(F.lit("T"), t)).otherwise(""))
        return F.when(n.isNull(), None).when(n == 0, "PT0S").otherwise(F.concat(F.when(signed < 0, "-").otherwise(""), F.lit("P"), piece(d, "D"), time))

    return once(seconds, write)


def months_of(text: Column) -> Column:
    """Months of a yearMonthDuration text; null where it is none."""

    def read(t: Column) -> Column:
        grab = lambda p: number(F.regexp_extract(t, p, 1), "int")
        total = grab(r"^-?P(\d+)Y") * 12 + grab(r"^-?P(?:\d+Y)?(\d+)M")
        return F.when(F.rlike(t, F.lit(r"^-?P(?=\d)(\d+Y)?(\d+M)?$")), once(total, lambda n: F.when(t.startswith("-"), -n).otherwise(n)))

    return once(text, read)


def months_text(months: Column) -> Column:
    """``P1Y2M`` of a number of months; zero is ``P0M``."""

    def write(signed: Column) -> Column:
        n = F.abs(signed)
        y, m = F.floor(n / 12), n % 12
        body = F.concat(F.lit("P"), F.when(y > 0, F.concat(y.cast("string"), F.lit("Y"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
        return F.when(n.isNull(), None).when(n == 0, "P0M").otherwise(F.concat(F.when(signed < 0, "-").otherwise(""), body))

    return once(months, write)


def add_months(a: Column, b: Column) -> Column:
    """Sum of two yearMonthDurations; null where one is none."""
    return months_text(months_of(a) + months_of(b))


def subtract_months(a: Column, b: Column) -> Column:
    return months_text(months_of(a) - months_of(b))


def month_component(text: Column, unit: str) -> Column:
    """Years or months as they stand in a yearMonthDuration's normal form: 14 months are 1 year and 2 months."""
    whole = lambda n: F.floor(F.abs(n) / 12) if unit == "years" else F.abs(n) % 12
    return once(months_of(text), lambda n: F.when(n < 0, -whole(n)).otherwise(whole(n)).cast("long"))


def plus_months(ts: Column, months: Column) -> Column:
    """Clipped to the month's end."""
    return ts + F.make_ym_interval(F.lit(0), months)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_millis(millis(ts) + (seconds * 1000).cast("long"))


def adjust(ts: Column, zone_name: str) -> Column:
    """Clock time of a UTC instant in another zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone_name), ts.cast("timestamp_ntz"))


def component(text: Column, unit: str) -> Column:
    """Days, hours, minutes or seconds as they stand in a normal form: 90 minutes are 1 hour and 30 minutes."""

    def read(n: Column) -> Column:
        whole = F.abs(n)
        value = {
            "days": F.floor(whole / 86400), "hours": F.floor(whole % 86400 / 3600), "minutes": F.floor(whole % 3600 / 60), "seconds": whole % 60,
        }[unit]
        return F.when(n < 0, -value).otherwise(value)

    return once(seconds_of(text), read)


def in_units(text: Column, unit: str) -> Column:
    """The whole duration in days, hours, minutes or seconds."""
    return seconds_of(text) / F.lit({"days": 86400.0, "hours": 3600.0, "minutes": 60.0, "seconds": 1.0}[unit])


def add(a: Column, b: Column) -> Column:
    return duration_text(seconds_of(a) + seconds_of(b))


def subtract(a: Column, b: Column) -> Column:
    return duration_text(seconds_of(a) - seconds_of(b))


def scale(a: Column, factor: Column) -> Column:
    return duration_text(seconds_of(a) * factor)


def divide(a: Column, by: Column) -> Column:
    """Null for a division by zero."""
    return duration_text(F.try_divide(seconds_of(a), by))


def timezone_duration(text: Column) -> Column:
    """``PT2H`` for ``+02:00``, ``PT0S`` for ``Z``, null without a zone."""

    def read(z: Column) -> Column:
        minutes = F.regexp_extract(z, r"(\d\d):", 1).try_cast("int") * 60 + F.regexp_extract(z, r":(\d\d)", 1).try_cast("int")
        return F.when(z == "Z", "PT0S").when(z != "", duration_text(F.when(z.startswith("-"), -minutes).otherwise(minutes) * 60))

    return once(zone(text), read)
