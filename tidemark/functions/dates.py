"""Dates in words, resolved on the driver against an explicit day."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The phrases in Chinese.
CHINESE = {"今天": "today", "昨天": "yesterday", "前天": "2 days ago", "本周": "this week", "这周": "this week", "上周": "last week", "本月": "this month", "这个月": "this month", "上月": "last month", "上个月": "last month"}


def date_range(words: str, as_of: date) -> tuple[date, date]:
    """First and last day of a phrase such as ``last 7 days`` or ``this month``."""
    w = " ".join(words.lower().split())
    w = CHINESE.get(w, w)
    if m := re.fullmatch(r"(?:最近|过去)\s?(\d+)\s?天", w):
        w = f"last {m[1]} days"
    elif m := re.fullmatch(r"(\d+)\s?天前", w):
        w = f"{m[1]} days ago"
    monday, first = as_of - timedelta(as_of.weekday()), as_of.replace(day=1)
    fixed = {
        "today": (as_of, as_of),
        "yesterday": (as_of - timedelta(1), as_of - timedelta(1)),
        "this week": (monday, as_of),
        "last week": (monday - timedelta(7), monday - timedelta(1)),
        "this month": (first, as_of),
        "last month": ((first - timedelta(1)).replace(day=1), first - timedelta(1)),
    }
    if w in fixed:
        return fixed[w]
    if m := re.fullmatch(r"last (\d+) days?", w):
        return as_of - timedelta(int(m[1]) - 1), as_of
    if m := re.fullmatch(r"(\d+) days? ago", w):
        return as_of - timedelta(int(m[1])), as_of - timedelta(int(m[1]))
    if m := re.fullmatch(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", w):
        day = date(*map(int, m.groups()))
        return day, day
    raise ValueError(f"not a date or a range: {words!r}")


#: Words for a day, how many days ago it is; weekdays from Monday on.
DAY_WORDS = {"今天": 0, "昨天": 1, "前天": 2, "大前天": 3, "today": 0, "yesterday": 1}
WEEKDAYS = {"en": "monday tuesday wednesday thursday friday saturday sunday".split(), "zh": "一二三四五六日"}


def _day_of(year: Column, month: Column, day: Column) -> Column:
    """The date, or NULL if there is no such day."""
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-M-d")))


def spoken_day(text: Column, as_of: Column, most_days: int = 365) -> Column:
    """The day that a text begins with, seen from ``as_of``; NULL if it says none.

    Days ago (up to ``most_days``), words for a day, weekdays of the last or this week (this week's is the last one gone by), and
    written dates in both languages; a month and day without a year are never after the month of ``as_of``."""
    said = F.lower(F.trim(text))
    part = lambda pattern, i=1: F.regexp_extract(said, pattern, i)
    ago = lambda n: F.when(n <= most_days, F.date_sub(as_of, n.cast("int")))
    monday_based = F.weekday(as_of)
    rules: list[tuple[Column, Column]] = [(said == word, F.date_sub(as_of, n)) for word, n in DAY_WORDS.items()]
    for pattern in (r"^(\d+)\s*天前", r"^(\d+)\s*days?\s+ago"):
        rules.append((said.rlike(pattern), ago(part(pattern).try_cast("bigint"))))
    chinese, english = "^(上|本)周([一二三四五六日天])", rf"^(last|this)\s+({'|'.join(WEEKDAYS['en'])})"
    for pattern, last, number in (
        (chinese, "上", F.position(F.when(part(chinese, 2) == "天", "日").otherwise(part(chinese, 2)), F.lit(WEEKDAYS["zh"])) - 1),
        (english, "last", F.array_position(F.array(*map(F.lit, WEEKDAYS["en"])), part(english, 2)).cast("int") - 1),
    ):
        back = monday_based - number
        rules.append((said.rlike(pattern), F.date_sub(as_of, F.when(part(pattern) == last, back + 7).otherwise(F.pmod(back, F.lit(7))))))
    for pattern in (r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(?:(\d{4})年)?(\d{1,2})月(\d{1,2})日", r"^(?:(\d{4})/)?(\d{1,2})/(\d{1,2})"):
        month = part(pattern, 2)
        guessed = (F.year(as_of) - F.when(month.try_cast("int") > F.month(as_of), 1).otherwise(0)).cast("string")
        rules.append((said.rlike(pattern), _day_of(F.when(part(pattern) == "", guessed).otherwise(part(pattern)), month, part(pattern, 3))))
    out = F.when(*rules[0])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out


def compare_period(words: str | dict[str, str], as_of: date) -> tuple[date, date] | None:
    """First and last day of a period to compare; other than in ``date_range`` the last week and month are the 7 and 30 days before."""
    if isinstance(words, dict):
        try:
            return date.fromisoformat(words["start"]), date.fromisoformat(words["end"])
        except (KeyError, ValueError):
            return None
    ago = lambda n: as_of - timedelta(n)
    return {
        "today": (as_of, as_of), "yesterday": (ago(1), ago(1)), "last_week": (ago(7), ago(1)), "this_week": (ago(as_of.weekday()), as_of),
        "last_month": (ago(30), ago(1)), "this_month": (as_of.replace(day=1), as_of),
    }.get(words)


def checked_day(day: date, as_of: date, most_days: int = 365) -> date:
    """The day, if it is neither in the future nor too long ago."""
    if day > as_of:
        raise ValueError(f"{day} is after {as_of}")
    if (as_of - day).days > most_days:
        raise ValueError(f"{day} is more than {most_days} days before {as_of}")
    return day


def day_state(day: Column, as_of: Column, most_days: int = 365) -> Column:
    """``future``, ``old`` or ``ok``."""
    return F.when(day > as_of, "future").when(F.datediff(as_of, day) > most_days, "old").otherwise("ok")


def age_days(published: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(published)) / F.lit(86_400e6)


def clock(time: Column) -> Column:
    """HH:MM of ``2024-01-31 09:30:00``, ``09-30`` or ``09:30``."""
    return F.regexp_replace(F.substring(F.element_at(F.split(time, " "), -1), 1, 5), "-", ":")


def in_period(t: Column, start: str, end: str) -> Column:
    """Whether a time of day HH:MM is in [start, end), which may wrap around midnight."""
    return (t >= start) & (t < end) if start <= end else (t >= start) | (t < end)


def day_spine(spark_frame: DataFrame, start: date, end: date, column: str = "date") -> DataFrame:
    """One row for each day, for zero-filled series."""
    days = F.sequence(F.lit(start), F.lit(end))
    return spark_frame.sparkSession.range(1).select(F.explode(days).alias(column))


def fresh(published: Column, as_of: Column, most_days: Column) -> Column:
    """Undated rows and a limit of 0 or less always pass."""
    return published.isNull() | (most_days <= 0) | (age_days(published, as_of) <= most_days)
