"""Prices read from free text, and what a market price makes of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_RATIO, MIN_RATIO = 10.0, 0.05
#: The counter of draws, the unit of yen, and its signs (fixed values).
TIMES, YEN, YEN_SIGNS = "回", "円", "¥￥"


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity (Spark's round goes away from zero)."""
    return F.floor(x + F.lit(0.5))


def parse_yen(text: Column) -> Column:
    """The largest run of 2 to 9 digits that no digit touches, commas aside; null if there is none above 0."""
    runs = F.regexp_extract_all(F.regexp_replace(text, "[，,]", ""), F.lit(r"(?<!\d)(\d{2,9})(?!\d)"), F.lit(1))
    most = F.array_max(F.transform(runs, lambda x: x.cast("long")))
    return F.when(most > 0, most)


def is_per_draw_fee(text: Column) -> Column:
    """A price for drawing lots: an amount of yen right after a number of times, or a single time at the beginning.

    A price is read as tokens: amounts (digits and commas), and all other characters one by one, white space aside.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\d，,]+|[^\s\u3000\u00A0])"), F.lit(1))

    def fee(t: Column) -> Column:
        token = lambda k: F.coalesce(F.get(t, k), F.lit(""))

        def counted(_: Column, k: Column) -> Column:
            sign = F.when(token(k + 1).isin(*YEN_SIGNS), 1).otherwise(0)
            return (token(k) == TIMES) & token(k - 1).rlike(r"\d$") & (k > 0) & token(k + 1 + sign).rlike(r"^[\d，,]") & (token(k + 2 + sign) == YEN)

        once = (token(F.lit(0)) == "1") & (token(F.lit(1)) == TIMES)
        return F.exists(F.transform(t, counted), lambda x: x) | once

    return F.transform(F.array(tokens), fee)[0]


def margin_of(list_price: Column, market: Column) -> Column:
    """struct(list_price, market, diff, pct, is_premium); null where the two can't be compared."""
    ratio, diff = market / list_price, market - list_price
    fine = (list_price > 0) & (market > 0) & (ratio <= MAX_RATIO) & (ratio >= MIN_RATIO)
    return F.when(fine, F.struct(list_price.alias("list_price"), market.alias("market"), diff.alias("diff"), half_up(diff / list_price * 100).cast("long").alias("pct"), (diff > 0).alias("is_premium")))


def margin(price: Column, market: Column) -> Column:
    return F.when(~is_per_draw_fee(F.coalesce(price, F.lit(""))), margin_of(parse_yen(price), market))


def display_price(text: Column) -> Column:
    yen = F.regexp_replace(F.trim(text), r"¥\s*([\d，,]+)", "$1円")
    return F.nullif(F.regexp_replace(yen, r"\(税(込|抜|別)\)", "（税$1）"), F.lit(""))


def format_pct(pct: Column) -> Column:
    return F.concat(F.when(pct >= 0, "+").otherwise(""), pct.cast("string"), F.lit("%"))


def format_diff(diff: Column) -> Column:
    return F.concat(F.when(diff >= 0, "+").otherwise("-"), F.lit("¥"), F.format_number(F.abs(diff), 0))


def is_suspect_pack_price(genre: Column, title: Column, price: Column) -> Column:
    """A single pack at the price of a box."""
    y = parse_yen(F.split(price, " / ")[0])
    return F.coalesce((y >= 3000) & genre.isin("トレカ", "ポケモン") & title.contains("パック") & ~title.rlike("BOX|ＢＯＸ|box|箱|入り|カートン|セット"), F.lit(False))


def first_number(text: Column) -> Column:
    """The first number of a price, commas aside; what a product's units are ordered by, nulls last."""
    return F.nullif(F.regexp_extract(F.replace(text, F.lit(",")), r"\d+", 0), F.lit("")).try_cast("long")
