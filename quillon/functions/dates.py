"""Date and time functions over text, Julian day numbers and seconds since 1970, with modifiers.

A time value is a TIMESTAMP_NTZ column; modifiers are applied in order. Adding months or years keeps the
day number and lets it overflow into the next month (31 January + 1 month = 2 or 3 March), unless the
modifier floor asks for the last day. The session's time zone plays no part.
"""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
EPOCH_JULIAN = 2440587.5
_AMOUNT = re.compile(r"^([+-]?\d+(?:\.\d+)?)\s*(second|minute|hour|day|month|year)s?$")
_CLOCK = re.compile(r"^([+-])(\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?$")
_SPAN = re.compile(r"^([+-])(\d{4})-(\d\d)-(\d\d)(?: (\d\d):(\d\d)(?::(\d\d))?)?$")
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _micros(t: Column) -> Column:
    """Microseconds since 1970 of a time value. Here and in _ahead the value stands once, so that nested values stay small."""
    return ((t.cast("timestamp_ntz") - _epoch()).cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def from_micros(m: Column) -> Column:
    """The time value of microseconds since 1970."""
    return _ahead(_epoch(), m)


def _ahead(t: Column, m: Column | int) -> Column:
    """The time value m microseconds later."""
    return F.timestamp_add("MICROSECOND", F.lit(m).cast("long"), t.cast("timestamp_ntz"))


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def parse(text: Column) -> Column:
    """A time value of text such as 2024-05-06, 2024-05-06 07:08[:09[.123]] (also with T), 07:08[:09]
    (of 1 January 2000); null if it is none."""
    t = F.trim(text)
    t = F.when(t.rlike(r"^\d\d:\d\d(:\d\d(\.\d+)?)?$"), F.concat(F.lit("2000-01-01 "), t)).otherwise(t)
    return F.when(t.rlike(r"^\d{4}-\d\d-\d\d([ T]+\d\d:\d\d(:\d\d(\.\d+)?)?)?Z?$"), F.regexp_replace(F.regexp_replace(t, "Z$", ""), "[ T]+", " ").try_cast("timestamp_ntz"))


def from_julian(day: Column) -> Column:
    return from_micros(F.round((day - F.lit(EPOCH_JULIAN)) * F.lit(86_400_000.0)).cast("long") * 1000)


def from_epoch(seconds: Column) -> Column:
    return from_micros((seconds * 1_000_000).cast("long"))


def _months(t: Column, n: int, floor: bool) -> Column:
    clock = _micros(t) % F.lit(DAY)
    clock = F.when(clock < 0, clock + DAY).otherwise(clock)
    if floor:
        date = F.add_months(t.cast("date"), n)
    else:
        first = F.add_months(F.trunc(t.cast("date"), "MM"), n)
        date = F.date_add(first, F.dayofmonth(t) - 1)
    return from_micros(F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * DAY + clock)


def modified(t: Column, *modifiers: str) -> Column:
    """A time value after its modifiers. utc and localtime convert from and to the session's time zone;
    ceiling is how months overflow without floor; auto and subsec change no time value."""
    words = [m.strip().lower() for m in modifiers]
    floor = "floor" in words
    for m in words:
        if m in ("floor", "ceiling", "auto", "subsec", "subsecond"):
            continue
        if m in ("utc", "localtime"):
            zones = (F.current_timezone(), F.lit("UTC"))
            t = F.convert_timezone(*(zones if m == "utc" else zones[::-1]), t)
            continue
        if found := _AMOUNT.match(m):
            amount, unit = float(found[1]), found[2]
            if unit in SECONDS:
                t = _ahead(t, int(round(amount * SECONDS[unit] * 1_000_000)))
            else:
                t = _months(t, int(amount) * (12 if unit == "year" else 1), floor)
        elif found := _CLOCK.match(m):
            n = (int(found[2]) * 3600 + int(found[3]) * 60 + int(found[4] or 0)) * 1_000_000 + int((found[5] or "0").ljust(6, "0")[:6])
            t = _ahead(t, n if found[1] == "+" else -n)
        elif found := _SPAN.match(m):
            side = 1 if found[1] == "+" else -1
            t = _months(t, side * (int(found[2]) * 12 + int(found[3])), floor)
            n = (int(found[4]) * 86400 + int(found[5] or 0) * 3600 + int(found[6] or 0) * 60 + int(found[7] or 0)) * 1_000_000
            t = _ahead(t, side * n)
        elif m.startswith("start of "):
            part = {"day": "DD", "month": "MM", "year": "YEAR"}[m[9:]]
            t = F.date_trunc(part, t).cast("timestamp_ntz")
        elif m.startswith("weekday "):
            ahead = (F.lit(int(m[8:])) - (F.dayofweek(t) - 1) + 7) % 7
            t = _ahead(t, ahead.cast("long") * DAY)
        else:
            raise ValueError(f"unknown modifier {m!r}")
    return t


def now() -> Column:
    """The query's own time in UTC, the same in all of its rows."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def julianday(t: Column) -> Column:
    return _micros(t).cast("double") / F.lit(float(DAY)) + F.lit(EPOCH_JULIAN)


def unixepoch(t: Column, subsec: bool = False) -> Column:
    return _micros(t).cast("double") / 1e6 if subsec else F.floor(_micros(t) / 1_000_000).cast("bigint")


def date(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")


def time(t: Column) -> Column:
    return F.date_format(t, "HH:mm:ss")


def datetime(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def _week(t: Column, first_is_sunday: bool) -> Column:
    """Week of the year, weeks from the first Sunday (or Monday) on."""
    day = F.dayofyear(t) - 1
    weekday = F.dayofweek(t) - 1 if first_is_sunday else (F.dayofweek(t) + 5) % 7
    return F.floor((day + 7 - weekday) / 7)


def strftime(form: str, t: Column) -> Column:
    """Text by conversion letters; null for an unknown one."""
    pad = lambda x, n=2, c="0": F.lpad(x.cast("string"), n, c)
    conversions = {
        "d": lambda: pad(F.dayofmonth(t)), "e": lambda: pad(F.dayofmonth(t), 2, " "), "f": lambda: F.date_format(t, "ss.SSS"), "F": lambda: date(t),
        "G": lambda: pad(F.extract(F.lit("YEAROFWEEK"), t), 4), "g": lambda: pad(F.extract(F.lit("YEAROFWEEK"), t) % 100), "H": lambda: pad(F.hour(t)), "k": lambda: pad(F.hour(t), 2, " "),
        "I": lambda: pad((F.hour(t) + 11) % 12 + 1), "l": lambda: pad((F.hour(t) + 11) % 12 + 1, 2, " "), "j": lambda: pad(F.dayofyear(t), 3), "J": lambda: julianday(t).cast("string"),
        "m": lambda: pad(F.month(t)), "M": lambda: pad(F.minute(t)), "p": lambda: F.when(F.hour(t) < 12, "AM").otherwise("PM"), "P": lambda: F.when(F.hour(t) < 12, "am").otherwise("pm"),
        "R": lambda: F.date_format(t, "HH:mm"), "s": lambda: unixepoch(t).cast("string"), "S": lambda: F.date_format(t, "ss"), "T": lambda: time(t),
        "u": lambda: ((F.dayofweek(t) + 5) % 7 + 1).cast("string"), "w": lambda: (F.dayofweek(t) - 1).cast("string"), "U": lambda: pad(_week(t, True)), "W": lambda: pad(_week(t, False)),
        "V": lambda: pad(F.weekofyear(t)), "Y": lambda: F.date_format(t, "yyyy"), "%": lambda: F.lit("%"),
    }
    parts, i = [F.lit("")], 0
    while i < len(form):
        if form[i] == "%":
            i += 1
            if i >= len(form) or form[i] not in conversions:
                return F.lit(None).cast("string")
            parts.append(conversions[form[i]]())
        else:
            end = form.find("%", i)
            end = len(form) if end < 0 else end
            parts.append(F.lit(form[i:end]))
            i = end - 1
        i += 1
    return F.concat(*parts)


def timediff(a: Column, b: Column) -> Column:
    """The span +YYYY-MM-DD HH:MM:SS.SSS that leads from b to a as a modifier: b moves by whole months into
    the month of a, or as few months short of it as keep it from passing a; the rest is days and time."""
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    back, first = a < b, lambda t: F.trunc(t.cast("date"), "MM")
    apart, days = F.abs(a - b), lambda n: F.lit(timedelta(days=1)) * n
    # What is left after whole months between the months of both; below 0 if b has then passed a.
    gap = apart - days(F.abs(F.datediff(first(a), first(b))))
    # Going on, b can be a day that the month before a does not have: 31 January and 1 March.
    far = gap + days(F.dayofmonth(F.date_sub(first(a), 1))) < timedelta(0)
    short = F.when(gap >= timedelta(0), 0).when(back, -1).when(far, 2).otherwise(1)
    rest = apart - days(F.abs(F.datediff(F.add_months(first(a), -short), first(b))))
    months = F.abs((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)) - F.abs(short)
    two = lambda x, n=2: F.lpad(x.cast("string"), n, "0")
    part = lambda unit: F.extract(F.lit(unit), rest)
    return F.concat(
        F.when(back, "-").otherwise("+"), two(F.floor(months / 12), 4), F.lit("-"), two(months % 12), F.lit("-"), two(part("DAY")), F.lit(" "),
        two(part("HOUR")), F.lit(":"), two(part("MINUTE")), F.lit(":"), F.substring(two(part("SECOND"), 9), 1, 6),
    )
