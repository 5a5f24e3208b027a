"""Stores and prizes: JSON arrays in text columns, read strictly, and what their deadlines say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PRIZE, STORE
from .clock import _bound, day

DEADLINE, OPENING = "締切", "開始"
SUMMARY_PREFIX = "受付中ストア："


def _typed(json: Column, names: tuple[str, ...]) -> Column:
    """Array of the objects' raw JSON values by name: strings keep their quotes, so that types can be told apart."""
    return F.from_json(json, f"array<struct<{', '.join(f'`{n}`:string' for n in names)}>>", {"mode": "PERMISSIVE"})


def parse_stores(json: Column) -> Column:
    """array<struct> of stores with a name; odd days and kinds become null; null if none is left or the text is broken."""
    rows = _typed(F.nullif(json, F.lit("")), tuple(STORE.names))
    named = F.filter(rows, lambda s: F.coalesce(F.length(F.trim(s["name"])) > 0, F.lit(False)))
    blank = lambda x: F.nullif(x, F.lit(""))
    made = F.transform(
        named,
        lambda s: F.struct(
            s["name"].alias("name"), blank(s["url"]).alias("url"), blank(s["form"]).alias("form"), blank(s["when"]).alias("when"), blank(s["note"]).alias("note"),
            F.when(s["at"].rlike(r"^\d{4}-\d{2}-\d{2}$"), s["at"]).alias("at"), F.when(s["kind"].isin(DEADLINE, OPENING), s["kind"]).alias("kind"),
        ),
    )
    return _bound(made, lambda x: F.when(F.size(x) > 0, x))


def parse_prizes(json: Column) -> Column:
    rows = F.from_json(F.nullif(json, F.lit("")), f"array<{PRIZE.simpleString()}>", {"mode": "PERMISSIVE"})
    named = F.filter(rows, lambda p: F.coalesce(F.length(F.trim(p["name"])) > 0, F.lit(False)) & p["label"].isNotNull())
    return _bound(named, lambda x: F.when(F.size(x) > 0, x))


def store_days(stores: Column) -> Column:
    return F.array_compact(F.transform(stores, lambda s: F.try_to_date(s["at"])))


def deadlines(stores: Column) -> Column:
    return F.array_compact(F.transform(F.filter(stores, lambda s: F.coalesce(s["kind"] == DEADLINE, F.lit(False))), lambda s: F.try_to_date(s["at"])))


def soonest_open(stores: Column, today: str | Column) -> Column:
    return F.array_min(F.filter(deadlines(stores), lambda d: d >= day(today)))


def last_deadline(stores: Column) -> Column:
    return F.array_max(deadlines(stores))


def is_closed(s: Column, today: str | Column) -> Column:
    return F.coalesce((s["kind"] == DEADLINE) & (F.try_to_date(s["at"]) < day(today)), F.lit(False))


def open_stores(stores: Column, today: str | Column) -> Column:
    return F.filter(stores, lambda s: ~is_closed(s, today))


def closed_stores(stores: Column, today: str | Column) -> Column:
    return F.filter(stores, lambda s: is_closed(s, today))


def nearest_move(stores: Column, today: str | Column) -> Column:
    """Days between today and a store's nearest day; null counts as never."""
    return F.array_min(F.transform(store_days(stores), lambda d: F.abs(F.datediff(d, day(today)))))


def summary(stores: Column, most: int = 3) -> Column:
    """The first stores in words, equal ones as 口, and how many more."""
    label = lambda s: F.concat_ws("|", s["name"], F.coalesce(s["form"], F.lit("")), F.coalesce(s["when"], F.lit("")))
    labels = F.transform(stores, label)
    own = F.array_distinct(labels)

    def words(l: Column) -> Column:
        same = F.filter(stores, lambda s: label(s) == l)
        n = F.size(same)
        parts = F.concat_ws("・", same[0]["form"], same[0]["when"], F.when(n > 1, F.concat(n.cast("string"), F.lit("口"))))
        return F.concat(same[0]["name"], F.when(parts != "", F.concat(F.lit("（"), parts, F.lit("）"))).otherwise(""))

    rest = F.size(own) - most
    return F.concat(F.array_join(F.transform(F.slice(own, 1, most), words), "、"), F.when(rest > 0, F.concat(F.lit(" 他"), rest.cast("string"), F.lit("店"))).otherwise(""))


def live_summary(highlights: Column, stores: Column, today: str | Column) -> Column:
    """Highlights that list open stores, listed anew for today; others stay."""
    t = day(today)
    at = lambda s: F.try_to_date(s["at"])
    opened = F.filter(stores, lambda s: F.coalesce(F.when(at(s).isNull(), True).when(s["kind"] == DEADLINE, at(s) >= t).when(s["kind"] == OPENING, at(s) <= t), F.lit(True)))
    fresh = highlights.startswith(SUMMARY_PREFIX) & (F.size(opened) > 0) & (F.size(opened) < F.size(stores))
    return F.when(F.coalesce(fresh, F.lit(False)), F.concat(F.lit(SUMMARY_PREFIX), summary(opened))).otherwise(highlights)


def preferred_url(stores: Column) -> Column:
    """A store's own page before a form, a form before a post; the first of equals."""
    rank = lambda u: F.when(F.lower(F.try_parse_url(u, F.lit("HOST"))).rlike(r"(^|\.)(x|twitter)\.com$"), 2).when(F.lower(u).rlike(r"docs\.google\.com|forms\.gle"), 1).otherwise(0)
    ranked = F.transform(stores, lambda s, k: F.struct(F.when(s["url"].isNull(), 9).otherwise(rank(s["url"])).alias("rank"), k.alias("k"), s["url"].alias("url")))
    return F.array_min(ranked)["url"]


def merge_prizes(old: Column, new: Column) -> Column:
    """New prizes, with the resale facts of old ones of the same label where they have none. Arrays of one item's prizes.

    Old ones are bound: they may be parsed from a text, which would else be done again for each prize and fact.
    """
    facts = ("resalePrice", "resaleText", "resaleUrl", "resaleSource")

    def carried(p: Column, first: Column) -> Column:
        take = p["resalePrice"].isNull()
        return F.struct(*[(F.when(take, first[n]).otherwise(p[n]) if n in facts else p[n]).alias(n) for n in PRIZE.names])

    def merged(was: Column) -> Column:
        same = lambda p: F.get(F.filter(was, lambda o: o["label"] == p["label"]), F.lit(0))
        return F.when(was.isNull(), new).otherwise(F.transform(new, lambda p: _bound(same(p), lambda first: carried(p, first))))

    return _bound(old, merged)


#: What a line-up of prizes begins with, what stands between prizes, and labels of those that collectors pay for (fixed values).
LINEUP_PREFIX, BETWEEN_PRIZES = "各賞ラインナップ：", "／"
HOT_LABELS, HOT_PARTS = ("A賞",), ("ラストワン", "ダブルチャンス")


def lineup(highlights: Column) -> Column:
    """array<struct<label, name>> of a line-up in words; an entry without a prize's label is all label. Null for other texts."""
    body = F.regexp_replace(F.substr(highlights, F.lit(len(LINEUP_PREFIX) + 1)), r"（全\d+種）\s*$", "")
    entries = F.filter(F.transform(F.split(body, BETWEEN_PRIZES), lambda e: F.trim(e)), lambda e: e != "")
    label = lambda e: F.regexp_extract(e, r"^(.+?賞)\s+(.+)$", 1)
    made = F.transform(entries, lambda e: F.struct(F.coalesce(F.nullif(label(e), F.lit("")), e).alias("label"), F.trim(F.regexp_extract(e, r"^(.+?賞)\s+(.+)$", 2)).alias("name")))
    return F.when(highlights.startswith(LINEUP_PREFIX) & (F.size(made) > 0), made)


def is_hot(label: Column) -> Column:
    hot = label.isin(*HOT_LABELS)
    for part in HOT_PARTS:
        hot |= label.contains(part)
    return F.coalesce(hot, F.lit(False))


def notable(prizes: Column) -> Column:
    return F.filter(prizes, lambda p: is_hot(p["label"]))


def ended_summary(stores: Column, today: str | Column, days: int = 60, most: int = 3) -> Column:
    """struct(summary, url) of stores that closed lately, in their order; null if none drew lots, or none has an address.

    A store's own page goes before a form. A day still to come says that the list isn't one of ended stores.
    """
    t, at = day(today), lambda s: F.try_to_date(s["at"])
    dated = F.filter(stores, lambda s: at(s).isNotNull())
    recent = F.filter(dated, lambda s: F.datediff(t, at(s)) <= days)
    newest = F.array_max(F.transform(dated, at))
    linked = F.filter(recent, lambda s: F.length(s["url"]) > 0)
    pages = F.filter(linked, lambda s: ~F.lower(s["url"]).rlike(r"docs\.google\.com|forms\.gle"))
    url = F.coalesce(F.get(pages, 0)["url"], F.get(linked, 0)["url"])
    label = lambda s: F.concat(s["name"], F.lit("（"), F.month(at(s)).cast("string"), F.lit("/"), F.dayofmonth(at(s)).cast("string"), F.lit("）"))
    lots = F.exists(recent, lambda s: F.coalesce(s["form"].contains("抽選"), F.lit(False)))
    text = F.array_join(F.transform(F.slice(recent, 1, most), label), "・")
    return F.when(F.datediff(t, newest).between(0, days) & lots & url.isNotNull(), F.struct(text.alias("summary"), url.alias("url")))


#: What is said of a store that takes no entries yet, in both languages, and what a lottery's day can be (fixed values).
NOT_YET, NOT_YET_EN = "（受付前）", " (not open yet)"
CLOSES, OPENS, ANNOUNCED = "応募締切", "受付開始", "告知の日付"


def when_label(s: Column, today: str | Column, abroad: bool = False) -> Column:
    """A store's time as today's reader sees it: a kept day becomes today or tomorrow, and one that opens later says so."""
    ahead = F.datediff(F.try_to_date(s["at"]), day(today))
    near = F.when(ahead == 0, "本日").when(ahead == 1, "明日")
    first = r"^(.*?)\d{1,2}/\d{1,2}"  # the first day alone
    named = F.when(near.isNotNull(), F.regexp_replace(s["when"], F.lit(first), F.concat(F.lit("$1"), near))).otherwise(s["when"])
    late = F.coalesce((s["kind"] == OPENING) & (ahead > 0), F.lit(False))
    said = s["when"] if abroad else named
    return F.when(F.length(s["when"]) > 0, F.when(late, F.concat(said, F.lit(NOT_YET_EN if abroad else NOT_YET))).otherwise(said))


def lottery_day(event_date: Column, stores: Column, source: Column, closing: tuple[str, ...] = (), unsure: tuple[str, ...] = ()) -> Column:
    """What a lottery's day is: by the stores of that day, else by what its source (`closing` or `unsure`) is known to give; or null."""
    same = F.filter(stores, lambda s: F.coalesce(F.try_to_date(s["at"]) == event_date, F.lit(False)))
    kind = lambda name: lambda s: F.coalesce(s["kind"] == name, F.lit(False))
    by_store = F.when(F.exists(same, kind(DEADLINE)), CLOSES).when((F.size(same) > 0) & F.forall(same, kind(OPENING)), OPENS)
    return F.coalesce(by_store, F.when(source.isin(*closing), CLOSES).when(source.isin(*unsure), ANNOUNCED))
