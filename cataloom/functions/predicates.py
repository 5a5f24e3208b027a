"""Filters of the catalog's views, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import day, next_monday, next_month

#: Event types whose day is to be announced, and the three groups of the rest (fixed values).
TBD_TYPES = ("登場予定", "開催")
STATUS_TYPES = {"reserve": ("予約", "予約開始", "予約受付中", "受付開始"), "lottery": ("抽選",), "release": ("発売", "販売開始", "登場予定", "開催", "再販")}
LOTTERY = "抽選"
#: A source whose titles all name lotteries, so that the word says nothing there.
LOTTERY_NOISE = "snkrdunk"
MIRRORS = ("channeltono", "rarecheck")


def in_scope(scope: Column, hidden: str = "en") -> Column:
    return ~scope.eqNullSafe(F.lit(hidden))


def title_contains(title: Column, text: str) -> Column:
    return F.lower(title).contains(text.lower())


def is_lottery(event_type: Column, has_lottery: Column, title: Column, source: Column, word: str = LOTTERY, kind: str = LOTTERY) -> Column:
    return (event_type == kind) | F.coalesce(has_lottery, F.lit(False)) | ((source != LOTTERY_NOISE) & title.contains(word))


def is_now(event_date: Column, event_type: Column, tbd=TBD_TYPES) -> Column:
    return event_date.isNull() & ~event_type.isin(*tbd)


def has_type(event_type: Column, status: str, types=STATUS_TYPES) -> Column:
    return event_type.isin(*types[status])


def upcoming(event_date: Column, today) -> Column:
    return event_date.isNull() | (event_date >= day(today))


def this_week(event_date: Column, today) -> Column:
    return (event_date >= day(today)) & (event_date < next_monday(today))


def this_month(event_date: Column, today) -> Column:
    return (event_date >= day(today)) & (event_date < next_month(today))


def dated(event_date: Column, today) -> Column:
    return event_date >= day(today)


def has_substance(*fields: Column) -> Column:
    found = F.lit(False)
    for f in fields:
        found |= F.coalesce(F.length(F.trim(f)) > 0, F.lit(False))
    return found


def is_dead_end(official_url: Column, searchable: Column, stores: Column) -> Column:
    return ~(F.coalesce(official_url != "", F.lit(False)) | F.coalesce(searchable, F.lit(False)) | F.coalesce(F.size(stores) > 0, F.lit(False)))


def is_mirror_without_day(source: Column, event_date: Column, planned: Column, mirrors=MIRRORS) -> Column:
    return source.isin(*mirrors) & event_date.isNull() & planned.isNull()


def is_generic_image(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(r"no[-_]?image|noimg|placeholder|default[-_.]|dummy|spacer|ogp?[-_]?default|/logo"), F.lit(False))


def placement(category: Column, preorder: Column, digital: Column, shipped_abroad: Column) -> Column:
    """Where a shop's product is shown: both surfaces, abroad only, or nowhere; the first rule that holds."""
    return F.when(digital, "skip").when(preorder, "jp").when(shipped_abroad & category.isNotNull(), "en-only").otherwise("skip")
