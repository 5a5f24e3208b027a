"""Labels of days read back: the inverse of what `clock` and `stores` write, and what contradicts itself in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import clock
from .stores import DEADLINE, OPENING

TODAY_WORD, TOMORROW_WORD, AHEAD = "本日", "明日", "あと"
RANGE = "〜"
MONTHS_EN = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _whole(d: Column, dom: Column) -> Column:
    """The day, where its month has one of that number."""
    return F.when(F.dayofmonth(d) == dom, d)


def _japanese(label: Column, today: str | Column) -> Column:
    def named(x: Column) -> Column:
        dated = clock.rolled(x["year"], x["month"], x["day"])
        return _whole(F.when(x["year"].isNotNull(), dated).otherwise(clock.nearest_year(x["month"], x["day"], today)), x["day"])

    first = F.get(clock.dates_written(label), F.lit(0))
    begins = label.rlike(r"^\s*\d")
    return F.when(begins, F.transform(F.array(first), lambda x: F.when(x["nth"] == 1, named(x)))[0])


def _english(label: Column, today: str | Column) -> Column:
    month = reduce(lambda found, k: F.when(F.lower(F.left(label, F.lit(3))) == MONTHS_EN[k].lower(), k + 1).otherwise(found), range(12), F.lit(None).cast("int"))

    def named(x: Column) -> Column:
        d, y = F.get(x, F.lit(0)), F.get(x, F.lit(1))
        dom = F.when(F.length(d["n"]) <= 2, d["n"].cast("int"))
        year = F.when((d["unit"] == ",") & (F.length(y["n"]) == 4), y["n"].cast("int"))
        return _whole(F.when(year.isNotNull(), clock.rolled(year, month, dom)).otherwise(clock.nearest_year(month, dom, today)), dom)

    return F.when(month.isNotNull(), F.transform(F.array(clock.parts(label)), named)[0])


def displayed_day(label: Column, today: str | Column) -> Column:
    """The day that a label shows, such as 8/16(日), 2026年8月16日(日), 2027/1/5(火), Sep 5 (Fri) or Sep 5, 2027 (Fri).

    Without a year it is the one nearest to today. Labels of months, and days that don't exist, are no days.
    """
    text = F.trim(label)
    return F.coalesce(_japanese(text, today), _english(text, today))


def shown_weekday(label: Column) -> Column:
    """The number of the weekday (1 is Sunday) that a label has in brackets; null without one."""
    said = F.regexp_extract(label, r"[(（]\s*([^)）\s]+)\s*[)）]", 1)
    by_name = F.instr(F.lit(clock.WEEKDAYS), said)
    english = F.array_position(F.array(*map(F.lit, clock.WEEKDAYS_EN)), said)
    return F.when(F.length(said) == 1, F.nullif(by_name, F.lit(0))).otherwise(F.nullif(english, F.lit(0)).cast("int"))


def badge_days(badge: Column) -> Column:
    """How many days ahead a countdown says, in either language; null for other badges."""
    b = F.lower(F.regexp_replace(badge, r"[^\p{L}\p{Nd}]", ""))
    number = lambda before, after: F.regexp_extract(b, rf"^{before}(\d{{1,2}}){after}$", 1).try_cast("int")
    return F.when(b.isin(TODAY_WORD, "today"), 0).when(b.isin(TOMORROW_WORD, "tomorrow"), 1).otherwise(F.coalesce(number(AHEAD, clock.DAY), number("in", "days?")))


def label_problems(label: Column, badge: Column, today: str | Column) -> Column:
    """array<string> of what is wrong with a shown day: `weekday` isn't the calendar's, `countdown` isn't to that day."""

    def problems(d: Column) -> Column:
        weekday = F.when(shown_weekday(label) != F.dayofweek(d), F.lit("weekday"))
        countdown = F.when(badge_days(badge) != F.datediff(d, clock.day(today)), F.lit("countdown"))
        return F.array_compact(F.array(weekday, countdown))

    return F.transform(F.array(displayed_day(label, today)), problems)[0]


def unfrozen(when: Column, kind: Column, scraped_at: Column) -> Column:
    """struct(when, at, kind) of a store's time as it was read: today and tomorrow become the days they were then.

    `at` is that day as text, null where the time names none; a kind that wasn't given is told by the side of the range mark.
    A month and day are of the year nearest to the reading. Null and empty times stay.
    """
    base = clock.jst_day(scraped_at)

    def named(x: Column) -> Column:
        def slash(p: Column, k: Column) -> Column:
            q = F.get(x, k + 1)
            there = (p["unit"] == "/") & (p["near"] == "/") & (p["far"] == "/") & (p["tail"] == "") & q.isNotNull()
            month, dom = F.right(p["n"], F.lit(2)).cast("int"), F.substring(q["n"], 1, 2).cast("int")
            return F.when(there, F.struct(month.alias("m"), dom.alias("d")))

        first = F.get(F.filter(F.transform(x, slash), lambda v: v.isNotNull()), F.lit(0))
        return F.transform(F.array(first), lambda v: clock.nearest_year(v["m"], v["d"], base))[0]

    d = F.when(when.contains(TODAY_WORD), base).when(when.contains(TOMORROW_WORD), F.date_add(base, 1)).otherwise(F.transform(F.array(clock.parts(when)), named)[0])
    side = F.when(when.startswith(RANGE), DEADLINE).when(when.endswith(RANGE), OPENING)

    def told(day_: Column) -> Column:
        short = F.concat(F.month(day_).cast("string"), F.lit("/"), F.dayofmonth(day_).cast("string"))
        first = rf"^(.*?)({TODAY_WORD}|{TOMORROW_WORD}|\d{{1,2}}/\d{{1,2}})"  # the first of them alone
        said = F.when(day_.isNotNull(), F.regexp_replace(when, F.lit(first), F.concat(F.lit("$1"), short))).otherwise(when)
        return F.struct(said.alias("when"), day_.cast("string").alias("at"), F.coalesce(kind, side).alias("kind"))

    return F.transform(F.array(d), told)[0]
