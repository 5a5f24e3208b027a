"""Checks of a catalog's rows, as one table of findings (name, id): each check is a condition, or a group's condition that its rows share.

Conditions of rows are told in one pass. Groups are counted with partial sums, and only those that are found join back.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, price, stores, text
from ..sources.shared import cut

#: Days of a page's own making, which are no event's (fixed values).
NOT_EVENTS = "投稿日|掲載日|更新日"
MOST_MARKET_RATIO = 20


def row_checks(today: str) -> dict[str, Column]:
    """Conditions over schema.ITEM's columns; null counts as false."""
    d, t = F.col("event_date"), F.col("event_date_text")
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    named = clock.dates_written(t)
    return {
        "market_ratio": F.col("market_price") >= MOST_MARKET_RATIO * price.parse_yen(F.col("price")),
        "date_text_mismatch": (F.size(named) > 0) & ~clock.names_day(named, d),
        "date_text_not_event": t.rlike(NOT_EVENTS),
        **day_checks(today, clock.planned_date(t)),
        "prizes_broken": given(F.col("prizes")) & stores.parse_prizes(F.col("prizes")).isNull(),
        "stores_broken": given(F.col("stores")) & stores.parse_stores(F.col("stores")).isNull(),
        "frozen_relative_date": clock.has_frozen_relative(t),
        "text_invisible": text.has_invisible(F.col("title")),
        "image_missing": ~given(F.col("image_url")),
        "price_pack": price.is_suspect_pack_price(F.col("genre"), F.col("title"), F.col("price")),
    }


def day_checks(today: str, planned: Column) -> dict[str, Column]:
    """Those of `row_checks` that the calendar alone can bring; `planned` is the day that a row's text promises."""
    past = lambda d: d < clock.day(today)
    return {"date_text_past": past(planned), "stale_promise": F.col("event_type").isin(*clock.PAST_LABELS) & past(F.coalesce(planned, F.col("event_date")))}


def of_rows(items: DataFrame, checks: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return items.select(F.explode(found).alias("finding"), "id")


def shared(items: DataFrame, name: str, value: Column, least: int) -> DataFrame:
    """Rows whose value at least so many rows have."""
    x = items.select("id", value.alias("v")).where(F.col("v").isNotNull())
    often = x.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("v")
    return x.join(often, "v", "left_semi").select(F.lit(name).alias("finding"), "id")


def image_rates(items: DataFrame, before: DataFrame, least: int = 10) -> DataFrame:
    """(source, finding): sources without any image, or with under half the rate of before (source, rate)."""
    has = F.coalesce(F.length("image_url") > 0, F.lit(False))
    now = items.groupBy("source").agg(F.count("*").alias("n"), F.avg(has.cast("int")).alias("now"))
    x = now.join(before, "source", "left").where(F.col("n") >= least)
    finding = F.when(F.col("now") == 0, "image_source_zero").when(F.col("now") < F.col("rate") / 2, "image_rate_dropped")
    return x.select("source", finding.alias("finding")).where("finding is not null")


def page_counts(before: DataFrame, now: DataFrame, unexplained: DataFrame, least: int = 10) -> DataFrame:
    """(page, finding) of pages (page, n) that are gone or under half, where losses (page, lost) are unexplained."""
    x = before.withColumnRenamed("n", "prev").join(now, "page", "left").join(unexplained, "page").where(F.col("lost") > 0)
    finding = F.when(F.coalesce("n", F.lit(0)) == 0, "page_vanished").when((F.col("prev") >= least) & (F.col("n") * 2 < F.col("prev")), "page_count_drop")
    return x.select("page", finding.alias("finding")).where("finding is not null")


def _sets(items: DataFrame, code: Column, words: Column) -> DataFrame:
    """(code, words, k): a code's distinct sets of words, and how many there are. Codes with an empty set or a single one are left out."""
    sets = items.select(code.alias("code"), F.array_sort(F.array_distinct(F.coalesce(words, F.array().cast("array<string>")))).alias("words")).where("code is not null").distinct()
    several = sets.groupBy("code").agg(F.count("*").alias("k"), F.min(F.size("words")).alias("least")).where("k > 1 and least > 0")
    return sets.join(several.select("code", "k"), "code")


def code_conflicts(items: DataFrame, code: Column, tokens: Column, letters: int = 4) -> DataFrame:
    """(code): article codes of which two rows have names without a word in common; words have at least so many letters.

    A row without words has none in common with any, so two rows are enough. Else equal sets of words count once, and counts
    settle what they can: a word that all sets of a code have ends it; a set whose words are in fewer sets than there are, all
    told, meets one it shares nothing with. What is left is asked of the code's sets without its commonest word, as all that
    have it share it: how many sets their own words are in. No word that all rows share is ever paired.
    """
    words = F.filter(tokens, lambda w: F.length(w) >= letters)
    rows = items.select(code.alias("code"), F.coalesce(F.size(words) == 0, F.lit(True)).alias("empty")).where("code is not null")
    empty = rows.groupBy("code").agg(F.count("*").alias("n"), F.max("empty").alias("empty")).where("empty and n > 1").select("code")

    x = cut(_sets(items, code, words), "code-sets")
    every = x.select("code", "words", "k", F.explode("words").alias("word"))
    count = every.groupBy("code", "word").agg(F.count("*").alias("f"))
    commonest = count.groupBy("code").agg(F.max_by("word", F.struct("f", "word")).alias("commonest"), F.max("f").alias("most"))
    told = x.join(commonest, "code").where("most < k and not array_contains(words, commonest)").select("code", "words", "k")
    reach = told.select("code", "words", "k", F.explode("words").alias("word")).join(count, ["code", "word"]).groupBy("code", "words", "k").agg(F.sum("f").alias("reach"))
    # a set is counted once for each of its own words: those k - 1 others need as many more
    short = F.col("reach") - F.size("words") < F.col("k") - 1
    settled = reach.where(short).select("code").distinct()
    open_ = reach.where(~short).join(settled, "code", "left_anti").select("code", "words", "k", F.explode("words").alias("word"))
    met = open_.join(every.select("code", F.xxhash64("words").alias("other"), "word"), ["code", "word"]).groupBy("code", "words", "k").agg(F.countDistinct("other").alias("met"))
    return empty.unionByName(settled).unionByName(met.where("met < k").select("code")).distinct()


def same_product(items: DataFrame, group: Column, tokens: Column, codes: Column) -> DataFrame:
    """(id, keepable) of rows of a group, such as those of one image: whether they can be one product.

    One name must hold the words of all (the hub). If the hub has codes, rows with all of them are kept; if it has none, each
    two names must be one within the other, or no row is kept. No pairs are made: a hub has as many words as the group;
    and names are within one another if each word is in all names of at least as many words as the shortest it is in. Groups
    of null are left out. Of hubs, which all have the same words, the one of the smallest id tells the codes.
    """
    of = lambda c: F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))
    rows = items.select("id", group.alias("group"), of(tokens).alias("words"), of(codes).alias("codes")).where("`group` is not null").withColumn("size", F.size("words"))
    n_words = rows.select("group", F.explode("words").alias("word")).groupBy("group").agg(F.countDistinct("word").alias("all"))
    longest = rows.groupBy("group").agg(F.max_by(F.struct("size", "codes"), F.struct("size", -F.col("id"))).alias("hub"))
    hubs = longest.join(n_words, "group", "left").where("hub.size = coalesce(all, 0)").select("group", F.col("hub.codes").alias("hub_codes"))

    loose = rows.join(hubs.where("size(hub_codes) = 0").select("group"), "group", "left_semi")
    sizes = loose.groupBy("group", "size").agg(F.count("*").alias("n"))
    at_least = sizes.alias("a").join(sizes.alias("b"), (F.col("a.group") == F.col("b.group")) & (F.col("b.size") >= F.col("a.size")))  # a group has few sizes
    at_least = at_least.groupBy(F.col("a.group").alias("group"), F.col("a.size").alias("shortest")).agg(F.sum("b.n").alias("longer"))
    each = loose.select("group", "size", F.explode("words").alias("word")).groupBy("group", "word").agg(F.count("*").alias("f"), F.min("size").alias("shortest"))
    broken = each.join(at_least, ["group", "shortest"]).where("f <> longer").select("group").distinct().withColumn("broken", F.lit(True))

    asked = rows.join(hubs, "group", "left").join(broken, "group", "left")
    coded = F.size(F.array_except("hub_codes", "codes")) == 0
    keepable = F.when(F.col("hub_codes").isNull(), False).when(F.size("hub_codes") > 0, coded).otherwise(F.col("broken").isNull())
    return asked.select("id", keepable.alias("keepable"))


def zero_adoption(adopted: Column, crawled: Column) -> Column:
    """What a crawl that took nothing over says: nothing was there, or all was passed over; null where nobody counted what was there."""
    return F.when(adopted > 0, "ok").when(crawled == 0, "nothing_crawled").when(crawled > 0, "nothing_adopted")


def label_checks(today: str, windowed: tuple[str, ...] = (), window_days: int = 44) -> dict[str, Column]:
    """Conditions over what a row shows; sources in `windowed` list nothing older than so many days."""
    d, h, given = F.col("event_date"), F.col("highlights"), lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    listed = F.split(F.substr(h, F.lit(len(stores.SUMMARY_PREFIX) + 1)), "、")
    return {
        "lottery_no_evidence": F.col("has_lottery") & ~given(h) & ~given(F.col("prizes")),
        "dangling_particle": text.looks_truncated(F.col("title")),
        "stores_indistinguishable": h.startswith(stores.SUMMARY_PREFIX) & (F.size(F.array_distinct(listed)) < F.size(listed)),
        "undated_month_in_title": clock.date_label(d, F.col("event_date_text"), today).isNull() & clock.month_from_title(F.col("title"), today).isNotNull(),
        "recent_window_overrun": F.col("source").isin(*windowed) & (d < F.date_sub(clock.day(today), window_days)),
    }


def out_of_month(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows of a month's page whose period has no day in [start, end)."""
    period = clock.period(F.col("event_date"), stores.store_days(stores.parse_stores(F.col("stores"))))
    return rows.where(~clock.overlaps(period, start, end)).select(F.lit("month_page_out_of_range").alias("finding"), "id")


def appearing(items: DataFrame, today: str, later: str) -> DataFrame:
    """Findings that the calendar alone will bring: there on the later day, and not today.

    Each row is told by itself, in one pass: texts are read once for both days, and nothing is joined.
    """
    x = items.select("id", "event_type", "event_date", clock.planned_date(F.col("event_date_text")).alias("planned"))
    now, then = (day_checks(d, F.col("planned")) for d in (today, later))
    return of_rows(x, {name: c & ~F.coalesce(now[name], F.lit(False)) for name, c in then.items()})


#: What a market label must name, addresses of one's own that must not be kept, and signs that an address was never read (fixed values).
MARKET_KINDS = "中古|新品|メルカリ|実売|落札"
OWN_LINKS = r"(?i)^https?://hb\.afl\.rakuten\.co\.jp/"
ENTITIES = r"&(amp|lt|gt|quot|#0?39);"
#: Characters of broken decoding: the replacement mark, and controls other than tab and line ends.
BROKEN = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]"
MOST_YEN, MOST_PRIZE_RATIO = 3_000_000, 40


def value_checks(today: str) -> dict[str, Column]:
    """Conditions over what a row keeps: prices, years, addresses, characters, and days that its stores tell anew. Null counts as false."""
    d, t, face = F.col("event_date"), F.col("event_date_text"), price.parse_yen(F.split(F.col("price"), " / ")[0])
    shops = stores.parse_stores(F.col("stores"))
    deadline = stores.last_deadline(shops)
    any_store = lambda pattern: F.exists(shops, lambda s: F.coalesce(s["url"].rlike(pattern), F.lit(False)))
    in_any = lambda pattern, *names: reduce(or_, [F.coalesce(F.col(n).rlike(pattern), F.lit(False)) for n in names])
    odd_prize = lambda p: p["resalePrice"].isNotNull() & (
        F.coalesce((F.length(p["resaleText"]) > 0) & ~p["resaleText"].rlike(MARKET_KINDS), F.lit(False)) | F.coalesce(p["resalePrice"] >= MOST_PRIZE_RATIO * face, F.lit(False))
    )
    return {
        "price_absurd": face > MOST_YEN,
        "market_label": F.col("market_price").isNotNull() & ~F.coalesce(F.col("market_price_text"), F.lit("")).rlike(MARKET_KINDS),
        "date_year_guessed": (d > F.add_months(clock.day(today), 12)) & ~F.coalesce(t, F.lit("")).rlike(r"\d{4}\s*年|\d{4}[/-]"),
        "date_fabricated_precision": clock.is_month_precision(t) & clock.date_label(d, t, today).rlike(r"\d{1,2}/\d{1,2}"),
        "text_broken_char": in_any(BROKEN, "title", "highlights"),
        "prizes_resale_suspect": F.exists(stores.parse_prizes(F.col("prizes")), odd_prize),
        "eventdate_not_recomputable": deadline.isNotNull() & ~d.eqNullSafe(deadline),
        "own_affiliate_stored": in_any(OWN_LINKS, "url", "official_url") | F.coalesce(any_store(OWN_LINKS), F.lit(False)),
        "official_url_entity": in_any(ENTITIES, "official_url") | F.coalesce(any_store(ENTITIES), F.lit(False)),
    }


def scope_leaks(page_rows: DataFrame, allowed: list[str]) -> DataFrame:
    """(page, id) of rows (page, id, scope) of the foreign scope on pages that aren't for it."""
    return page_rows.where((F.col("scope") == "en") & ~F.col("page").isin(*allowed)).select("page", "id")


def open_but_hidden(items: DataFrame, shown: DataFrame, key: Column, today: str) -> DataFrame:
    """(finding, id) of rows with a deadline still to come that no page shows, nor another row of the same key. `shown` has id."""
    soonest = stores.soonest_open(stores.parse_stores(F.col("stores")), today)
    keyed = items.select("id", key.alias("key"), soonest.isNotNull().alias("open"))
    seen_keys = keyed.join(shown.select("id"), "id", "left_semi").select("key").distinct()
    hidden = keyed.where("open").join(shown.select("id"), "id", "left_anti").join(seen_keys, "key", "left_anti")
    return hidden.select(F.lit("stores_open_but_hidden").alias("finding"), "id")


def prize_prices(items: DataFrame, priced_before: int, today: str, ripe_days: int = 14, least: int = 5) -> DataFrame:
    """One row (finding) for each way in which resale prices of prizes have died: none on ripe rows, or none left of those before."""
    prizes = stores.parse_prizes(F.col("prizes"))
    priced = F.size(F.filter(prizes, lambda p: p["resalePrice"].isNotNull()))
    ripe = F.coalesce((F.length("prizes") > 0) & (F.col("event_date") < F.date_sub(clock.day(today), ripe_days)), F.lit(False))
    x = items.select(ripe.alias("ripe"), F.when(prizes.isNotNull(), priced).otherwise(0).alias("priced"))
    n = x.agg(F.count_if("ripe").alias("ripe"), F.count_if(F.col("ripe") & (F.col("priced") > 0)).alias("ripe_priced"), F.coalesce(F.sum("priced"), F.lit(0)).alias("priced"))
    dead = F.when((F.col("ripe") >= least) & (F.col("ripe_priced") == 0), "prizes_resale_missing")
    lost = F.when((F.col("priced") == 0) & (F.lit(priced_before) > 0), "prizes_resale_lost")
    return n.select(F.explode(F.array_compact(F.array(dead, lost))).alias("finding"))


def dead_faces(items: DataFrame, faces: dict[str, Column], before: DataFrame, least: int = 5) -> DataFrame:
    """(face, was) of intakes, each a condition of rows, that had `least` rows before (face, n) and have none."""
    counts = items.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in faces.items()])
    now = counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("face"), F.col(name).alias("now")) for name in faces])).alias("f")).select("f.*")
    return now.join(before, "face").where((F.col("now") == 0) & (F.col("n") >= least)).select("face", F.col("n").alias("was"))


def lost_routes(items: DataFrame, official_sources: list[str], before: DataFrame, least: int = 20) -> DataFrame:
    """(source, now) of sources of which under half as many rows as before (source, rate) lead to an official page; half or more did."""
    has = F.col("source").isin(*official_sources) | F.coalesce(F.length("official_url") > 0, F.lit(False)) | stores.parse_stores(F.col("stores")).isNotNull()
    now = items.groupBy("source").agg(F.count("*").alias("n"), F.avg(has.cast("int")).alias("now"))
    return now.join(before, "source").where((F.col("n") >= least) & (F.col("rate") >= 0.5) & (F.col("now") < F.col("rate") / 2)).select("source", F.round("now", 4).alias("now"))


#: Words that tell of a lottery or of its prizes, names of line-ups, and tags of news (fixed values).
PRIZE_CLAIM, LINEUPS = "賞品[:：]", ("各賞ラインナップ", "賞品ラインナップ")
LOTTERY_WORDS, LOTTERY_CLAIMS = ("抽選", "くじ"), ("抽選・くじあり", "抽選賞品")
NEWS_TAGS = ("【ニュース】", "【速報】")


def claim_checks(store_lists: tuple[str, ...] = ()) -> dict[str, Column]:
    """Conditions over claims of lotteries and prizes, and over news; sources in `store_lists` put lists of stores where others put claims."""
    h, drawn = F.coalesce(F.col("highlights"), F.lit("")), F.coalesce(F.col("has_lottery"), F.lit(False))
    has = lambda *words: reduce(or_, [h.contains(w) for w in words])
    unsaid = drawn & (h != "") & ~has(*LOTTERY_WORDS, *LINEUPS)
    return {
        "lottery_prize_claim": h.rlike(PRIZE_CLAIM) & ~h.contains(LINEUPS[0]),
        "lottery_flag": ~F.col("source").isin(*store_lists) & (unsaid | (~drawn & has(*LOTTERY_CLAIMS))),
        "news_post": reduce(or_, [F.col("title").startswith(tag) for tag in NEWS_TAGS]),
    }
