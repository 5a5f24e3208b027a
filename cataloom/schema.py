"""Schemas of the catalog: items, stores, prizes, events and snapshots. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _TS, _L, _B = T.StringType(), T.DateType(), T.TimestampType(), T.LongType(), T.BooleanType()

STORE = T.StructType([T.StructField(x, _S) for x in ("name", "url", "form", "when", "note", "at", "kind")])
PRIZE = T.StructType(
    [T.StructField(x, _S) for x in ("label", "name", "image")]
    + [T.StructField("variants", T.DoubleType()), T.StructField("choosable", _B), T.StructField("size", _S), T.StructField("resalePrice", T.DoubleType())]
    + [T.StructField(x, _S) for x in ("resaleText", "resaleUrl", "resaleSource")]
)

#: What a connector hands in: an item without the columns that the engine itself gives.
SCRAPED = T.StructType(
    [T.StructField(x, _S, False) for x in ("source", "source_id", "title", "genre", "event_type", "url")]
    + [T.StructField(x, _S) for x in ("sub_genre", "price", "image_url", "event_date_text", "sales_channel", "highlights", "official_url")]
    + [T.StructField("event_date", _D), T.StructField("has_lottery", _B), T.StructField("prizes", _S), T.StructField("stores", _S), T.StructField("scope", _S), T.StructField("store_listed_at", _TS)]
)

ITEM = T.StructType(
    [T.StructField("id", _L, False)]
    + SCRAPED.fields
    + [T.StructField("scraped_at", _TS), T.StructField("market_price", _L), T.StructField("market_price_text", _S), T.StructField("market_url", _S), T.StructField("market_source", _S), T.StructField("market_checked_at", _TS)]
)

EVENT = T.StructType([T.StructField("id", _L, False)] + [T.StructField(x, _S) for x in ("name", "value", "data", "path")] + [T.StructField("created_at", _TS)])

#: The closed genre vocabulary, in the order of display (fixed values).
GENRES = ("フィギュア", "トレカ", "スニーカー", "プラモ", "一番くじ", "くじ", "コラボ", "ポケモン", "キャラグッズ", "玩具", "ソフビ・アートトイ", "家電・ゲーム機", "酒・ウイスキー", "その他")


def conform(df, schema: T.StructType):
    """`df` with exactly the schema's columns, in order: missing ones null, others cast. Extra columns go."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
