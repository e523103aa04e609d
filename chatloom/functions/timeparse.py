"""Times as people write them in chats, resolved against an explicit "now".

All functions are Column expressions.  ``as_of_ms`` and ``tz`` fix what "today" is; nothing reads the clock.
``strict_parity`` keeps two known slips of the original behaviour: one spelling of weekdays isn't seen, and a text
without a time means midnight.
"""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.functions.text import collapsed, without_space

# Weekday characters, Monday first, and the patterns of dates and times.
WEEKDAYS = (("一", 1), ("二", 2), ("三", 3), ("四", 4), ("五", 5), ("六", 6), ("日", 7), ("天", 7))
CLOCK = "([0-9]{1,2}):([0-9]{2})"
FULL_DATE = "([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})"
MONTH_DAY = "([0-9]{1,2})[/月]([0-9]{1,2})"
CLOCK_END = "([0-9]{1,2})[:：]([0-9]{2})(?![0-9])"
DATE_SIGNS = "[月日号昨天今周星期]"


def _today(as_of_ms: int, tz: str) -> datetime:
    return datetime.fromtimestamp(as_of_ms / 1000, ZoneInfo(tz))


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def epoch_of(year: Column, month: Column, day: Column, hour: Column, minute: Column, tz: str) -> Column:
    """Milliseconds of a wall clock time whose parts may run over (31 February, hour 30): they carry on."""
    first = F.make_date(F.when(year < 100, year + 1900).otherwise(year), F.lit(1), F.lit(1))
    days = F.unix_date(F.add_months(first, month - 1)).cast("long") + day - 1
    wall = days * 86400000 + hour.cast("long") * 3600000 + minute.cast("long") * 60000
    return wall if tz == "UTC" else F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(wall), tz))


def weekday_number(text: Column) -> Column:
    """1 to 7 for the first weekday character in the fixed order; null without one."""
    return F.coalesce(*(F.when(text.contains(char), F.lit(n)) for char, n in WEEKDAYS))


def weekday_date(number: Column, as_of_ms: int, tz: str = "UTC") -> Column:
    """The latest such weekday before today; today's own weekday is a week ago."""
    now = _today(as_of_ms, tz)
    return F.date_sub(F.lit(now.date()), (F.pmod(F.lit(now.isoweekday()) - number - 1, F.lit(7)) + 1).cast("int"))


def _date_parts(d: Column) -> tuple[Column, Column, Column]:
    return F.year(d), F.month(d), F.day(d)


def checkpoint(time_str: Column, as_of_ms: int, tz: str = "UTC", strict_parity: bool = False) -> Column:
    """struct<epoch_ms, year, month, day, hour, minute> of a time string; date parts are null where today is meant."""
    now = _today(as_of_ms, tz)
    clean = collapsed(F.coalesce(time_str, F.lit("")))
    has_clock = clean.rlike(CLOCK)
    hour, minute = (F.coalesce(_int(F.regexp_extract(clean, CLOCK, i)), F.lit(0)) for i in (1, 2))
    yesterday = F.date_sub(F.lit(now.date()), 1)
    is_yesterday = clean.contains("昨天") | clean.contains("昨日")
    names_weekday = clean.contains("周") | clean.contains("是期")
    if not strict_parity:
        names_weekday = names_weekday | clean.contains("星期")
    on_weekday = weekday_date(weekday_number(clean), as_of_ms, tz)
    full = [_int(F.regexp_extract(clean, FULL_DATE, i)) for i in (1, 2, 3)]
    short = [F.lit(now.year), *(_int(F.regexp_extract(clean, MONTH_DAY, i)) for i in (1, 2))]
    parts = [
        F.when(is_yesterday, a).when(names_weekday, b).when(clean.rlike(FULL_DATE), c).when(clean.rlike(MONTH_DAY), d)
        for a, b, c, d in zip(_date_parts(yesterday), _date_parts(on_weekday), full, short, strict=True)
    ]
    year, month, day = parts
    epoch = epoch_of(F.coalesce(year, F.lit(now.year)), F.coalesce(month, F.lit(now.month)), F.coalesce(day, F.lit(now.day)), hour, minute, tz)
    if not strict_parity:
        epoch = F.when(~has_clock & day.isNull(), F.lit(as_of_ms // 60000 * 60000)).otherwise(epoch)
    return F.struct(epoch.alias("epoch_ms"), year.alias("year"), month.alias("month"), day.alias("day"), hour.alias("hour"), minute.alias("minute"))


def message_epoch(time_str: Column, as_of_ms: int, tz: str = "UTC", strict_parity: bool = False) -> Column:
    """A message's time: its date if year, month and day are all given and not 0, else today, at its hour and minute."""
    now = _today(as_of_ms, tz)
    c = checkpoint(time_str, as_of_ms, tz, strict_parity)
    given = (F.coalesce(c["year"], F.lit(0)) > 0) & (F.coalesce(c["month"], F.lit(0)) > 0) & (F.coalesce(c["day"], F.lit(0)) > 0)
    today = epoch_of(F.lit(now.year), F.lit(now.month), F.lit(now.day), c["hour"], c["minute"], tz)
    if not strict_parity:
        today = F.when(F.coalesce(time_str, F.lit("")).rlike(CLOCK), today).otherwise(F.lit(as_of_ms // 60000 * 60000))
    return F.when(given, c["epoch_ms"]).otherwise(today)


def looks_like_time(clean: Column) -> Column:
    """Gate on text without white space: a clock time in a short line, with a date sign or alone."""
    return clean.rlike(CLOCK_END) & (F.length(clean) <= 20) & (clean.rlike(DATE_SIGNS) | clean.rlike("^[0-9]{1,2}:[0-9]{2}\\z"))


def parse_timestamp(text: Column, as_of_ms: int, tz: str = "UTC", signs_only: bool = False) -> Column:
    """struct<hour, minute, month, day, year> by the first grammar rule that fits and is in range, else null.

    ``signs_only``: for texts that can only be a month and a day with their signs and a clock time, the one rule for these.
    """
    now = _today(as_of_ms, tz)
    clean = without_space(text)

    def part(pattern: str, i: int) -> Column:
        return _int(F.regexp_extract(clean, pattern, i))

    def rule(pattern: str, hour: int, minute: int, month: Column | None, day: Column | None, year: Column | None) -> Column:
        none = F.lit(None).cast("int")
        month, day, year = (none if x is None else x for x in (month, day, year))
        h, m = part(pattern, hour), part(pattern, minute)
        fits = clean.rlike(pattern) & h.between(0, 23) & m.between(0, 59) & (month.isNull() | month.between(1, 12)) & (day.isNull() | day.between(1, 31))
        return F.when(fits, F.struct(h.alias("hour"), m.alias("minute"), month.alias("month"), day.alias("day"), year.alias("year")))

    skip = "[^0-9]*"
    full, cjk, slash = f"^{FULL_DATE}{skip}{CLOCK_END}", f"^([0-9]{{1,2}})月([0-9]{{1,2}})[日号]{skip}{CLOCK_END}", f"^([0-9]{{1,2}})/([0-9]{{1,2}}){skip}{CLOCK_END}"
    before, weekday, alone = f"^(昨天|昨日){skip}{CLOCK_END}", f"^(周|星期)([一二三四五六日天]){skip}{CLOCK_END}", "^([0-9]{1,2})[:：]([0-9]{2})\\z"
    y1, m1, d1 = _date_parts(F.date_sub(F.lit(now.date()), 1))
    y2, m2, d2 = _date_parts(weekday_date(weekday_number(F.regexp_extract(clean, weekday, 2)), as_of_ms, tz))
    if signs_only:
        return F.when(looks_like_time(clean), rule(cjk, 3, 4, part(cjk, 1), part(cjk, 2), None))
    rules = [
        rule(full, 4, 5, part(full, 2), part(full, 3), part(full, 1)),
        rule(cjk, 3, 4, part(cjk, 1), part(cjk, 2), None),
        rule(slash, 3, 4, part(slash, 1), part(slash, 2), None),
        rule(before, 2, 3, m1, d1, y1),
        rule(weekday, 3, 4, m2, d2, y2),
        rule(alone, 1, 2, None, None, None),
    ]
    return F.when(looks_like_time(clean), F.coalesce(*rules))


def to_epoch_ms(parsed: Column, as_of_ms: int, tz: str = "UTC") -> Column:
    """Milliseconds of a parsed timestamp; missing parts are today's."""
    now = _today(as_of_ms, tz)
    return epoch_of(F.coalesce(parsed["year"], F.lit(now.year)), F.coalesce(parsed["month"], F.lit(now.month)), F.coalesce(parsed["day"], F.lit(now.day)), parsed["hour"], parsed["minute"], tz)


def checkpoint_stamp(c: Column, as_of_ms: int, tz: str = "UTC") -> Column:
    """YYYYMMDD_HHmm of a checkpoint struct, with today's parts for those that are missing or 0; all zeros for null."""
    now = _today(as_of_ms, tz)

    def part(name: str, other: int) -> Column:
        return F.lpad(F.coalesce(F.nullif(c[name], F.lit(0)), F.lit(other)).cast("string"), 4 if name == "year" else 2, "0")

    stamp = F.concat(part("year", now.year), part("month", now.month), part("day", now.day), F.lit("_"), part("hour", 0), part("minute", 0))
    return F.when(c.isNull(), F.lit("00000000_0000")).otherwise(stamp)
