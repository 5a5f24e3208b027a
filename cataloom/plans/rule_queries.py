"""Queries of single rules and checks over the driver's tables, with DuckDB SQL; texts with the defects that a rule looks for are made of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, labels, predicates, price, stores, text, urls
from ..operators import analytics, attribution, findings, ingest, places, search
from ..schema import ITEM, conform
from . import views
from .catalog_queries import ITEMS, SHOWN, TODAY, items, query, table

DAY = f"DATE '{TODAY}'"
DOW = "['日', '月', '火', '水', '木', '金', '土'][dayofweek(event_date) + 1]"


# --- views --------------------------------------------------------------------------------------------------------------


@query(
    "catalog_filters",
    f"""{ITEMS}, s AS (SELECT * FROM items WHERE {SHOWN})
  SELECT 'genre' AS filter, id FROM s WHERE genre = '1-URGENT' UNION ALL SELECT 'source', id FROM s WHERE source = 'src3'
  UNION ALL SELECT 'title', id FROM s WHERE contains(lower(title), 'lottery') UNION ALL SELECT 'dated', id FROM s WHERE event_date IS NOT NULL
  UNION ALL SELECT 'month', id FROM s WHERE event_date < DATE '1998-09-01' UNION ALL SELECT 'all', id FROM s WHERE genre = '5-LOW' AND source = 'src2' AND event_date IS NOT NULL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    x = items(spark, sf)
    chosen = {"genre": {"genre": "1-URGENT"}, "source": {"source": "src3"}, "title": {"query": "LOTTERY"}, "dated": {"dated_only": True}, "month": {"when": "month"}, "all": {"genre": "5-LOW", "source": "src2", "dated_only": True}}
    parts = [views.filtered(x, TODAY, **f).select(F.lit(name).alias("filter"), "id") for name, f in chosen.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("abroad_rows", f"{ITEMS} SELECT id, event_date AS listed FROM items WHERE scope = 'en' AND source = 'src3' ORDER BY event_date DESC NULLS LAST, id DESC LIMIT 25")
def _(spark, sf):
    x = items(spark, sf).withColumn("store_listed_at", F.col("event_date"))
    return views.abroad_rows(x, "src3", raw_limit=25).select("id", F.col("store_listed_at").alias("listed"))


@query("all_pages", f"{ITEMS}, a AS (SELECT id FROM items WHERE {SHOWN}), b AS (SELECT id FROM items WHERE scope = 'en'), c AS (SELECT id FROM items WHERE event_date >= {DAY} AND event_date < DATE '1998-09-01') SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM c")
def _(spark, sf):
    x = items(spark, sf)
    return views.all_pages(views.filtered(x, TODAY), x.where(F.col("scope") == "en"), x.where(predicates.this_month(F.col("event_date"), TODAY)))


@query("browser_cards", f"{ITEMS} SELECT id, title, event_type, event_type = '抽選' OR coalesce(has_lottery, FALSE) OR (source <> 'snkrdunk' AND contains(title, '抽選')) AS lottery FROM items")
def _(spark, sf):
    return views.card(items(spark, sf)).select("id", "title", "event_type", "lottery")


# --- days ---------------------------------------------------------------------------------------------------------------


@query(
    "date_labels",
    f"""{ITEMS} SELECT id, CASE WHEN event_date IS NULL THEN '近日' WHEN id % 3 = 0 THEN CAST(year(event_date) AS VARCHAR) || '年' || CAST(month(event_date) AS VARCHAR) || '月'
  ELSE CASE WHEN year(event_date) = 1998 THEN '' ELSE CAST(year(event_date) AS VARCHAR) || '/' END || CAST(month(event_date) AS VARCHAR) || '/' || CAST(day(event_date) AS VARCHAR) || '(' || {DOW} || ')' END AS label FROM items""",
)
def _(spark, sf):
    month = F.concat(F.month("event_date").cast("string"), F.lit("月発売"))
    given = F.when(F.col("event_date").isNull(), "近日").when(F.col("id") % 3 == 0, month)
    return items(spark, sf).select("id", clock.date_label(F.col("event_date"), given, TODAY).alias("label"))


@query("long_dates", f"{ITEMS} SELECT id, CAST(year(event_date) AS VARCHAR) || '年' || CAST(month(event_date) AS VARCHAR) || '月' || CAST(day(event_date) AS VARCHAR) || '日(' || {DOW} || ')' AS label, strftime(event_date, '%b ') || CAST(day(event_date) AS VARCHAR) || CASE WHEN year(event_date) = 1998 THEN '' ELSE ', ' || CAST(year(event_date) AS VARCHAR) END || strftime(event_date, ' (%a)') AS abroad FROM items WHERE event_date IS NOT NULL")
def _(spark, sf):
    d = F.col("event_date")
    return items(spark, sf).where(d.isNotNull()).select("id", clock.format_long(d).alias("label"), clock.format_short_en(d, TODAY).alias("abroad"))


@query("past_years", f"{ITEMS}, t AS (SELECT id, make_date(1998, CAST(month(event_date) AS INTEGER), 1) + CAST(day(event_date) - 1 AS INTEGER) AS this, make_date(1997, CAST(month(event_date) AS INTEGER), 1) + CAST(day(event_date) - 1 AS INTEGER) AS last FROM items WHERE event_date IS NOT NULL) SELECT id, CASE WHEN this <= {DAY} THEN this ELSE last END AS resolved FROM t")
def _(spark, sf):
    x = items(spark, sf).where("event_date is not null")
    return x.select("id", clock.past_year(F.month("event_date"), F.dayofmonth("event_date"), TODAY).alias("resolved"))


TYPES = "CASE id % 4 WHEN 0 THEN '予約受付中' WHEN 1 THEN '登場予定' WHEN 2 THEN '予約' ELSE '発売' END"


@query("past_labels", f"{ITEMS} SELECT id, CASE WHEN event_date < {DAY} THEN CASE id % 4 WHEN 0 THEN '予約終了' WHEN 1 THEN '登場済み' WHEN 2 THEN '予約終了' ELSE '発売' END ELSE {TYPES} END AS label FROM items")
def _(spark, sf):
    x = items(spark, sf)
    return x.select("id", clock.display_event_type(F.expr(TYPES), F.col("event_date"), F.lit(None).cast("string"), TODAY).alias("label"))


@query("days_in_japan", "SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(clock.jst_day(F.col("ts").cast("timestamp")).alias("day")).agg(F.count("*").alias("n"))


@query("rollovers", "SELECT user_id, CASE WHEN date_diff('second', max(ts), TIMESTAMP '2024-01-31 00:00:00') / 3600 > 26 THEN 'error' END AS level FROM events GROUP BY user_id")
def _(spark, sf):
    x = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last"))
    hours = F.timestamp_diff("SECOND", F.col("last"), F.lit("2024-01-31 00:00:00").cast("timestamp")) / 3600
    return x.select("user_id", clock.rollover_level(hours).alias("level"))


# --- titles, prices, addresses ------------------------------------------------------------------------------------------


@query("price_labels", "SELECT p_partkey AS id, CASE WHEN p_size >= 25 THEN '+' ELSE '' END || CAST(p_size - 25 AS VARCHAR) || '%' AS pct, CASE WHEN floor(p_retailprice) >= 1500 THEN '+' ELSE '-' END || '¥' || format('{:,}', CAST(abs(floor(p_retailprice) - 1500) AS BIGINT)) AS diff, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) || '円 （税込）' AS shown FROM part")
def _(spark, sf):
    yen = F.floor("p_retailprice")
    label = F.concat(F.lit(" ¥ "), yen.cast("string"), F.lit(" (税込) "))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), price.format_pct(F.col("p_size") - 25).alias("pct"), price.format_diff(yen - 1500).alias("diff"), price.display_price(label).alias("shown"))


@query("sale_units", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN '1BOX' WHEN 1 THEN '12パック入' END AS unit, CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END AS rank, CASE WHEN p_size % 3 = 2 THEN p_name || ' カートン' ELSE p_name END AS base FROM part WHERE length(p_name) >= 8")
def _(spark, sf):
    k = F.col("p_size") % 3
    title = F.concat("p_name", F.when(k == 0, "【1BOX】").when(k == 1, " （12パック入）").otherwise(" カートン"))
    x = table(spark, sf, "part").where(F.length("p_name") >= 8)
    return x.select(F.col("p_partkey").alias("id"), text.sale_unit(title).alias("unit"), text.pack_unit(title).alias("rank"), text.without_sale_unit(title).alias("base"))


@query("model_codes", "SELECT p_partkey AS id, 'OP' || CAST(p_size AS VARCHAR) AS codes FROM part")
def _(spark, sf):
    title = F.concat("p_name", F.lit(" op-"), F.col("p_size").cast("string"), F.lit(" vol2 x9"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.model_codes(title), " ").alias("codes"))


@query("post_lengths", f"{ITEMS} SELECT id, length(title) + 2 * (id % 5) AS weight FROM items")
def _(spark, sf):
    title = F.concat("title", F.repeat(F.lit("抽"), (F.col("id") % 5).cast("int")))
    return items(spark, sf).select("id", text.weighted_length(title).cast("long").alias("weight"))


@query("title_segments", "SELECT p_partkey AS id, '[' || p_name || '！|' || p_type || '。|' || p_brand || ']' AS segments FROM part")
def _(spark, sf):
    made = text.segments(F.concat("p_name", F.lit("！"), "p_type", F.lit("。"), "p_brand"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("["), F.array_join(made, "|"), F.lit("]")).alias("segments"))


@query("title_collisions", "SELECT p_partkey AS id, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || ' ' || p_brand ELSE p_name END AS title FROM part")
def _(spark, sf):
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_brand")
    return analytics.distinct_titles(x, "title", "p_brand").select("id", "title")


@query("discarded_fragments", "SELECT f AS fragment, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS f FROM documents) WHERE length(f) BETWEEN 3 AND 30 GROUP BY f ORDER BY n DESC, fragment LIMIT 15")
def _(spark, sf):
    return analytics.frequent_fragments(table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("fragment")))


@query("genre_rules", "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN '一番くじ' WHEN 1 THEN 'スニーカー' WHEN 2 THEN 'ポケモン' WHEN 3 THEN 'フィギュア' ELSE 'その他' END AS genre FROM part")
def _(spark, sf):
    word = F.element_at(F.array(*map(F.lit, ("一番くじ Nike", "NIKE Dunk", "ポケカ ブースター", "figma", "things"))), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.classify_genre(F.concat(F.lit("- "), word)).alias("genre"))


@query("clean_addresses", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://a.example/x?id=' || page_id WHEN 1 THEN 'https://a.example/x' ELSE 'https://a.example/x?id=' || page_id END AS url, '4901234' || lpad(CAST(page_id AS VARCHAR), 6, '0') AS code, page_id % 3 <> 2 AS secure FROM pages")
def _(spark, sf):
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    base = F.lit("https://a.example/x")
    u = F.when(k == 0, F.concat(base, F.lit("?utm_source=z&id="), n, F.lit("&gclid=1#utm_x"))).when(k == 1, F.concat(base, F.lit("?utm_medium=q"))).otherwise(F.concat(base, F.lit("?id="), n, F.lit("?more=1")))
    image = F.concat(F.lit("https://img.example/4901234"), F.lpad(n, 6, "0"), F.lit("_1.jpg"))
    return table(spark, sf, "pages").select("page_id", urls.cleaned(u).alias("url"), urls.image_code(image).alias("code"), urls.is_secure(F.when(k == 2, "http://a.example/").otherwise(u)).alias("secure"))


@query("substance", f"{ITEMS} SELECT id, id % 6 <> 0 AS substance, id % 10 = 5 AS dead_end, id % 7 = 0 AS generic FROM items")
def _(spark, sf):
    k = F.col("id")
    has = predicates.has_substance(F.when(k % 2 == 1, "x"), F.when(k % 3 != 0, "y").otherwise("  "), F.lit(None).cast("string"))
    dead = predicates.is_dead_end(F.when(k % 2 == 0, "https://a.example"), k % 5 != 0, F.array().cast("array<string>"))
    image = F.when(k % 7 == 0, "https://a.example/img/No-Image.png").otherwise("https://a.example/img/12.png")
    return items(spark, sf).select("id", has.alias("substance"), dead.alias("dead_end"), predicates.is_generic_image(image).alias("generic"))


# --- prizes, stores, work queues ----------------------------------------------------------------------------------------


@query("prizes_carried", "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a, 5.0 AS b, p_size % 2 = 0 AS named FROM part")
def _(spark, sf):
    n = F.col("p_size").cast("string")
    old = stores.parse_prizes(F.concat(F.lit('[{"label":"A","name":"x","resalePrice":'), n, F.lit('},{"label":"B","name":"y","resalePrice":9}]')))
    new = stores.parse_prizes(F.concat(F.lit('[{"label":"A","name":"x"},{"label":"B","name":"y","resalePrice":5},{"label":"C","name":"'), F.when(F.col("p_size") % 2 == 0, "z").otherwise(" "), F.lit('"}]')))
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), stores.merge_prizes(old, new).alias("m"))
    return x.select("id", F.col("m")[0]["resalePrice"].alias("a"), F.col("m")[1]["resalePrice"].alias("b"), (F.size("m") == 3).alias("named"))


@query("store_addresses", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'https://shop.example/1' WHEN 1 THEN 'https://forms.gle/a' ELSE 'https://x.com/s' END AS url, CASE p_size % 3 WHEN 0 THEN 'S（抽選・2口）、T、U 他1店' ELSE 'S（抽選・2口）、T' END AS summary FROM part")
def _(spark, sf):
    k = F.col("p_size") % 3
    one = lambda name, url, form=None: F.struct(F.lit(name).alias("name"), F.lit(url).alias("url"), F.lit(form).cast("string").alias("form"), *[F.lit(None).cast("string").alias(x) for x in ("when", "note", "at", "kind")])
    base = [one("S", "https://x.com/s", "抽選"), one("S", "https://x.com/t", "抽選")]
    s = F.when(k == 0, F.array(*base, one("T", "https://forms.gle/a"), one("U", "https://shop.example/1"), one("V", "https://shop.example/2"))).when(k == 1, F.array(*base, one("T", "https://forms.gle/a"))).otherwise(F.array(*base, one("T", None)))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), stores.preferred_url(s).alias("url"), stores.summary(s).alias("summary"))


@query("detail_rotation", "WITH s AS (SELECT l_partkey AS id, max(l_shipdate) AS fetched_at FROM lineitem WHERE l_partkey % 40 <> 7 GROUP BY 1) SELECT p_partkey AS id, fetched_at FROM part LEFT JOIN s ON p_partkey = s.id ORDER BY fetched_at NULLS FIRST, id LIMIT 80")
def _(spark, sf):
    seen = table(spark, sf, "lineitem").where("l_partkey % 40 <> 7").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_shipdate").alias("fetched_at"))
    return ingest.rotation(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), seen, 80)


@query("accumulated_losses", "SELECT page, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_orderpriority AS page, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) GROUP BY page")
def _(spark, sf):
    x = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "page")
    n = lambda df: df.groupBy("page").agg(F.count("*").alias("n"))
    return attribution.accumulate(n(x), n(x.where("o_orderstatus = 'F'")), accepted=False)


@query("fingerprints", f"{ITEMS} SELECT CAST(count(*) AS VARCHAR) || ':' || CAST(max(event_date) AS VARCHAR) AS fingerprint FROM items")
def _(spark, sf):
    return attribution.fingerprint(items(spark, sf), "event_date")


# --- findings -----------------------------------------------------------------------------------------------------------


def checked(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as items with defects."""
    k, d = F.col("id"), F.col("event_date")
    full = lambda x: F.concat(F.year(x).cast("string"), F.lit("年"), F.month(x).cast("string"), F.lit("月"), F.dayofmonth(x).cast("string"), F.lit("日発売予定"))
    words = {0: full(d), 1: full(F.date_add(d, 1)), 2: F.lit("投稿日 1998/8/1"), 3: F.lit("1997年3月第2週登場予定"), 4: F.lit("〜本日")}
    t = F.lit(None).cast("string")
    for n, w in words.items():
        t = F.when(k % 6 == n, w).otherwise(t)
    json = lambda n: F.when(k % n == 0, "broken{").when(k % n == 1, '[{"label":"A","name":""}]').when(k % n > 3, '[{"label":"A","name":"x"}]')
    x = items(spark, sf).withColumns(
        {
            "event_type": F.expr(TYPES), "event_date_text": t, "price": F.when(k % 9 == 0, "1,000円").otherwise("9,000円"), "market_price": F.when(k % 10 == 0, 25000).otherwise(1500),
            "prizes": json(11), "stores": json(13), "title": F.when(k % 14 == 0, F.concat("title", F.lit("​"))).otherwise(F.concat("title", F.lit("パック"))), "genre": F.when(k % 2 == 0, "トレカ").otherwise("くじ"),
            "image_url": F.when(k % 8 != 0, F.concat(F.lit("https://img.example/"), (k % 500).cast("string"))), "url": F.concat(F.lit("https://shop.example/"), (k % 700).cast("string")),
        }
    )
    return conform(x, ITEM)


@query(
    "row_findings",
    f"""{ITEMS}, c AS (SELECT id, event_date AS d, id % 6 AS t, {TYPES} AS type FROM items),
  p AS (SELECT *, CASE t WHEN 0 THEN d WHEN 1 THEN d + 1 WHEN 3 THEN DATE '1997-03-08' END AS planned FROM c)
  SELECT 'market_ratio' AS finding, id FROM c WHERE id % 9 = 0 AND id % 10 = 0
  UNION ALL SELECT 'date_text_mismatch', id FROM c WHERE d IS NOT NULL AND (t = 1 OR t = 2 AND d <> DATE '1998-08-01')
  UNION ALL SELECT 'date_text_not_event', id FROM c WHERE t = 2
  UNION ALL SELECT 'date_text_past', id FROM p WHERE planned < {DAY}
  UNION ALL SELECT 'stale_promise', id FROM p WHERE type <> '発売' AND coalesce(planned, d) < {DAY}
  UNION ALL SELECT 'prizes_broken', id FROM c WHERE id % 11 IN (0, 1) UNION ALL SELECT 'stores_broken', id FROM c WHERE id % 13 IN (0, 1)
  UNION ALL SELECT 'frozen_relative_date', id FROM c WHERE t = 4 UNION ALL SELECT 'text_invisible', id FROM c WHERE id % 14 = 0
  UNION ALL SELECT 'image_missing', id FROM c WHERE id % 8 = 0 UNION ALL SELECT 'price_pack', id FROM c WHERE id % 2 = 0 AND id % 14 <> 0 AND id % 9 <> 0""",
)
def _(spark, sf):
    return findings.of_rows(checked(spark, sf), findings.row_checks(TODAY))


@query(
    "shared_findings",
    f"""{ITEMS}, c AS (SELECT id, id % 700 AS url, CASE WHEN id % 8 <> 0 THEN id % 500 END AS image FROM items)
  SELECT 'shared_url' AS finding, id FROM c WHERE url IN (SELECT url FROM c GROUP BY url HAVING count(*) >= 2)
  UNION ALL SELECT 'image_shared', id FROM c WHERE image IN (SELECT image FROM c WHERE image IS NOT NULL GROUP BY image HAVING count(*) >= 3)""",
)
def _(spark, sf):
    x = checked(spark, sf)
    return findings.shared(x, "shared_url", F.col("url"), 2).unionByName(findings.shared(x, "image_shared", F.col("image_url"), 3))


@query("image_rate_findings", f"{ITEMS}, n AS (SELECT source, avg(CASE WHEN id % 8 <> 0 AND source <> 'src1' AND (source <> 'src2' OR id % 3 = 0) THEN 1.0 ELSE 0.0 END) AS now, count(*) AS n FROM items GROUP BY source) SELECT source, CASE WHEN now = 0 THEN 'image_source_zero' ELSE 'image_rate_dropped' END AS finding FROM n WHERE n >= 10 AND (now = 0 OR now < 0.45)")
def _(spark, sf):
    x = checked(spark, sf).withColumn("image_url", F.when((F.col("source") != "src1") & ((F.col("source") != "src2") | (F.col("id") % 3 == 0)), F.col("image_url")))
    return findings.image_rates(x, x.select("source", F.lit(0.9).alias("rate")).distinct())


@query(
    "page_findings",
    """WITH b AS (SELECT p_type AS page, count(*) AS prev FROM part GROUP BY 1), a AS (SELECT p_type AS page, count(*) AS n FROM part WHERE p_size > 30 AND p_type <> 'LARGE BRASS' GROUP BY 1)
  SELECT page, CASE WHEN n IS NULL THEN 'page_vanished' ELSE 'page_count_drop' END AS finding FROM b LEFT JOIN a USING (page) WHERE n IS NULL OR prev >= 10 AND n * 2 < prev""",
)
def _(spark, sf):
    x = table(spark, sf, "part").withColumnRenamed("p_type", "page")
    n = lambda df: df.groupBy("page").agg(F.count("*").alias("n"))
    return findings.page_counts(n(x), n(x.where("p_size > 30 and page <> 'LARGE BRASS'")), x.select("page", F.lit(1).alias("lost")).distinct())


CODED = "WITH r AS (SELECT p_partkey AS id, {} AS code, list_filter(string_split(p_name, ' '), lambda x: len(x) >= {}) AS words FROM part)"


@query("code_conflicts", f"{CODED.format('p_size', 5)} SELECT DISTINCT a.code FROM r a JOIN r b ON a.code = b.code AND a.id <> b.id AND NOT list_has_any(a.words, b.words)")
def _(spark, sf):
    return findings.code_conflicts(table(spark, sf, "part"), F.col("p_size"), F.split("p_name", " "), letters=5)


@query(
    "same_product",
    f"""{CODED.format("(p_retailprice * 100)::BIGINT % 601", 1)}, g AS (SELECT code, list_distinct(flatten(list(words))) AS every, bool_and(len(words) >= 0) FROM r GROUP BY code),
  hub AS (SELECT DISTINCT r.code FROM r JOIN g ON r.code = g.code AND len(list_distinct(r.words)) = len(g.every)),
  apart AS (SELECT DISTINCT a.code FROM r a JOIN r b ON a.code = b.code AND NOT list_has_all(a.words, b.words) AND NOT list_has_all(b.words, a.words))
  SELECT id, code IN (SELECT code FROM hub) AND code NOT IN (SELECT code FROM apart) AS keepable FROM r""",
)
def _(spark, sf):
    x = table(spark, sf, "part").withColumn("id", F.col("p_partkey"))
    return findings.same_product(x, F.round(F.col("p_retailprice") * 100).cast("long") % 601, F.split("p_name", " "), F.array().cast("array<string>"))


@query(
    "zero_adoption",
    """SELECT source, CASE WHEN n > 0 THEN 'ok' WHEN crawled = 0 THEN 'nothing_crawled' WHEN crawled > 0 THEN 'nothing_adopted' END AS verdict FROM (
  SELECT source, count(*) FILTER (n_chars > 19000) AS n, CASE WHEN min(doc_id) % 3 <> 0 THEN count(*) FILTER (n_chars > 9000) END AS crawled FROM documents GROUP BY source)""",
)
def _(spark, sf):
    n = F.col("n_chars")
    crawled = F.when(F.min("doc_id") % 3 != 0, F.count_if(n > 9000))
    return table(spark, sf, "documents").groupBy("source").agg(findings.zero_adoption(F.count_if(n > 19000), crawled).alias("verdict"))


# --- days, titles and prizes in words -----------------------------------------------------------------------------------


@query(
    "day_texts",
    """WITH t AS (SELECT p_partkey AS id, CAST(p_size % 14 AS INTEGER) AS m, CAST(p_size % 33 AS INTEGER) AS d, CAST(p_size % 12 + 1 AS INTEGER) AS s FROM part)
  SELECT id, CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN make_date(1998, m, 1) + (d - 1) END AS compact,
  make_date(CASE WHEN s < 10 THEN 1999 ELSE 1998 END, s, 1) + d AS slash, CASE WHEN s >= 9 THEN make_date(1998, s, 1) END AS planned FROM t""",
)
def _(spark, sf):
    m, d, s = F.col("p_size") % 14, F.col("p_size") % 33, F.col("p_size") % 12 + 1
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    compact = clock.compact_day(F.concat(F.lit("1998"), two(m), two(d)))
    slash = clock.slash_day(F.concat(s.cast("string"), F.lit("/"), (d + 1).cast("string"), F.lit(" (木)")), 1998, 11)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), compact.alias("compact"), slash.alias("slash"), clock.month_plan(F.lit(1998), s, TODAY).alias("planned"))


@query(
    "repaired_years",
    """WITH t AS (SELECT p_partkey AS id, DATE '1998-06-01' AS a, DATE '1998-06-01' + CAST(p_size - 25 AS INTEGER) AS b, DATE '1998-05-22' AS c FROM part),
  u AS (SELECT id, a, c, CASE WHEN b > a THEN CAST(b - INTERVAL 1 YEAR AS DATE) ELSE b END AS b FROM t)
  SELECT id, a, b, CASE WHEN c > b THEN CAST(c - INTERVAL 1 YEAR AS DATE) ELSE c END AS c FROM u""",
)
def _(spark, sf):
    first = F.lit("1998-06-01").cast("date")
    days = F.array(first, F.lit(None).cast("date"), F.date_add(first, F.col("p_size") - 25), F.date_sub(first, 10))
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), clock.repaired_years(days).alias("k"))
    return x.select("id", F.col("k")[0].alias("a"), F.col("k")[2].alias("b"), F.col("k")[3].alias("c"))


@query("balanced_titles", "SELECT p_partkey AS id, p_name || CASE p_size % 4 WHEN 0 THEN ' A' WHEN 1 THEN ' B(x)' WHEN 2 THEN ' 「ok」' ELSE ' (c)' END AS title FROM part")
def _(spark, sf):
    k = F.col("p_size") % 4
    tail = F.when(k == 0, " 【A").when(k == 1, " B】】(x)").when(k == 2, " 「ok」 ").otherwise(" ((c)")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.without_unmatched(F.concat("p_name", tail)).alias("title"))


@query("truncated_titles", "SELECT p_partkey AS id, p_size % 4 = 0 AS truncated FROM part")
def _(spark, sf):
    k = F.col("p_size") % 4
    title = F.when(k == 2, "名前の").otherwise(F.concat("p_name", F.when(k == 0, " 名前の").when(k == 1, " たきもの").otherwise(" x")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.looks_truncated(title).alias("truncated"))


@query("stale_numbers", "SELECT p_partkey AS id, concat_ws(' ', CASE WHEN p_size NOT IN (10, 20) THEN CAST(p_size AS VARCHAR) || ',000件' END, CASE WHEN p_size % 7 <> 3 THEN CAST(p_size % 7 AS VARCHAR) || 'ジャンル' END) AS stale FROM part")
def _(spark, sf):
    n = F.col("p_size")
    said = F.concat(n.cast("string"), F.lit(",000件 / "), (n % 7).cast("string"), F.lit("ジャンル"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.stale_claims(said, {"件": [10000, 20000], "ジャンル": [3]}), " ").alias("stale"))


@query("identity_words", "WITH t AS (SELECT p_partkey AS id, list_filter(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' '), lambda x: length(x) >= 3) AS l FROM part) SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:6], ' ') AS words FROM t")
def _(spark, sf):
    title = F.concat("p_name", F.lit("【"), "p_type", F.lit("】限定 Box "), "p_brand")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.identity_words(title), " ").alias("words"))


@query("kuji_lineups", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'A賞|ラストワン賞|B賞' END AS labels, CASE WHEN p_size % 2 = 0 THEN p_name || '|' || p_type || '|' END AS names, CASE WHEN p_size % 2 = 0 THEN 'A賞|ラストワン賞' END AS hot FROM part")
def _(spark, sf):
    body = F.concat(F.lit("：A賞 "), "p_name", F.lit("／ラストワン賞 "), "p_type", F.lit("／ B賞／（全5種）"))
    made = stores.lineup(F.concat(F.when(F.col("p_size") % 2 == 0, "各賞ラインナップ").otherwise("賞"), body))
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), made.alias("p"))
    return x.select("id", F.array_join("p.label", "|").alias("labels"), F.array_join("p.name", "|").alias("names"), F.array_join(stores.notable(F.col("p"))["label"], "|").alias("hot"))


@query(
    "ended_stores",
    f"""WITH t AS (SELECT p_partkey AS id, p_size AS n, {DAY} - CAST(p_size AS INTEGER) AS a, {DAY} - CAST(p_size + 20 AS INTEGER) AS b FROM part)
  SELECT id, 'S（' || month(a) || '/' || day(a) || '）' || CASE WHEN n <= 40 THEN '・T（' || month(b) || '/' || day(b) || '）' ELSE '' END AS summary,
  CASE WHEN n <= 40 THEN 'https://shop.example/t' ELSE 'https://forms.gle/s' END AS url FROM t WHERE n % 2 = 0""",
)
def _(spark, sf):
    n = F.col("p_size")
    ago = lambda k: F.date_format(F.date_sub(clock.day(TODAY), k), "yyyy-MM-dd")
    one = lambda name, url, form, at: F.struct(F.lit(name).alias("name"), F.lit(url).alias("url"), form.alias("form"), at.alias("at"))
    closed = F.array(one("S", "https://forms.gle/s", F.when(n % 2 == 0, "抽選販売").otherwise("先着"), ago(n)), one("T", "https://shop.example/t", F.lit("先着"), ago(n + 20)))
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), stores.ended_summary(closed, TODAY).alias("e")).where("e is not null")
    return x.select("id", "e.summary", "e.url")


@query("unit_order", "SELECT p_partkey AS id, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size * 1000 AS BIGINT) END AS yen FROM part ORDER BY yen NULLS LAST, id LIMIT 50")
def _(spark, sf):
    shown = F.when(F.col("p_size") % 5 == 0, "未定").otherwise(F.concat(F.lit("¥"), F.col("p_size").cast("string"), F.lit(",000 x 2")))
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), price.first_number(shown).alias("yen"))
    return x.orderBy(F.asc_nulls_last("yen"), "id").limit(50)


@query("seeded_sample", "SELECT p_partkey AS id FROM part ORDER BY md5('20240120:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 30")
def _(spark, sf):
    return analytics.seeded_sample(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), "id", 20240120, 30)


@query("baseline_gate", "SELECT source, count(*) FILTER (n_chars < 200) <= 0.2 * count(*) AS writable FROM documents GROUP BY source")
def _(spark, sf):
    short = F.count_if(F.col("n_chars") < 200)
    return table(spark, sf, "documents").groupBy("source").agg(analytics.baseline_gate(F.count("*") - short, short).alias("writable"))


# --- findings of what is shown, and of days to come ---------------------------------------------------------------------


@query(
    "label_findings",
    f"""{ITEMS} SELECT 'lottery_no_evidence' AS finding, id FROM items WHERE has_lottery AND id % 6 > 1
  UNION ALL SELECT 'dangling_particle', id FROM items WHERE id % 10 = 0 UNION ALL SELECT 'stores_indistinguishable', id FROM items WHERE id % 6 = 0
  UNION ALL SELECT 'undated_month_in_title', id FROM items WHERE id % 10 = 1 AND event_date IS NULL
  UNION ALL SELECT 'recent_window_overrun', id FROM items WHERE source = 'src3' AND event_date < {DAY} - 44""",
)
def _(spark, sf):
    k = F.col("id")
    title = F.concat("title", F.when(k % 10 == 0, " 名前の").when(k % 10 == 1, " 9月発売").otherwise(""))
    x = items(spark, sf).withColumns({"title": title, "highlights": F.when(k % 6 == 0, "受付中ストア：S、S").when(k % 6 == 1, "受付中ストア：S、T")})
    return findings.of_rows(conform(x, ITEM), findings.label_checks(TODAY, ("src3",)))


@query("month_page_findings", f"{ITEMS} SELECT 'month_page_out_of_range' AS finding, id FROM items WHERE (event_date IS NULL OR event_date < DATE '1998-08-01' OR event_date >= DATE '1998-09-01') AND NOT (id % 4 = 0 AND (event_date IS NULL OR event_date < DATE '1998-09-01' + 62))")
def _(spark, sf):
    x = items(spark, sf).withColumn("stores", F.when(F.col("id") % 4 == 0, '[{"name":"S","at":"1998-08-10","kind":"締切"}]'))
    return findings.out_of_month(conform(x, ITEM), F.lit("1998-08-01").cast("date"), F.lit("1998-09-01").cast("date"))


@query(
    "findings_to_come",
    f"""{ITEMS}, p AS (SELECT id, event_date AS d, {TYPES} AS type, CASE id % 6 WHEN 0 THEN event_date WHEN 1 THEN event_date + 1 WHEN 3 THEN DATE '1997-03-08' END AS planned FROM items)
  SELECT 'date_text_past' AS finding, id FROM p WHERE planned >= {DAY} AND planned < {DAY} + 7
  UNION ALL SELECT 'stale_promise', id FROM p WHERE type <> '発売' AND coalesce(planned, d) >= {DAY} AND coalesce(planned, d) < {DAY} + 7""",
)
def _(spark, sf):
    return findings.appearing(checked(spark, sf), TODAY, "1998-08-09")


# --- findings of kept values, faces and routes --------------------------------------------------------------------------


def kept_values(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as items whose prices, labels, addresses and deadlines are wrong by key."""
    k, day = F.col("id"), F.col("event_date")
    prize = F.concat(F.lit('[{"label":"A","name":"x","resalePrice":'), F.when(k % 7 == 0, "40000").otherwise("900"), F.lit(',"resaleText":"'), F.when(k % 7 == 1, "?").otherwise("中古"), F.lit('"},{"label":"B","name":"y"}]'))
    shop = F.concat(F.lit('[{"name":"S","kind":"締切","at":"1998-08-10","url":"'), F.when(k % 8 == 0, "https://hb.afl.rakuten.co.jp/x").when(k % 8 == 4, "https://a.example/?a=1&amp;b=2").otherwise("https://a.example/"), F.lit('"}]'))
    x = items(spark, sf).withColumns(
        {
            "price": F.when(k % 50 == 0, "4,000,000円 / BOX").otherwise("1,000円 / 2回"), "market_price": F.when(k % 3 == 0, 500), "market_price_text": F.when(k % 6 == 0, "中古 500円"),
            "event_date_text": F.when(k % 5 == 0, F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"))).otherwise("近日"),
            "title": F.when(k % 9 == 0, F.concat("title", F.lit("�"))).when(k % 9 == 1, F.concat("title", F.lit("\u0002"))).otherwise(F.concat("title", F.lit("\t"))),
            "prizes": F.when(k % 2 == 0, prize), "stores": F.when(k % 4 == 0, shop), "official_url": F.when(k % 10 == 1, "https://b.example/?x=&#39;").when(k % 10 == 2, "HTTPS://hb.afl.rakuten.co.jp/y").when(k % 10 == 3, "https://b.example/"),
        }
    )
    return conform(x, ITEM)


@query(
    "value_findings",
    f"""{ITEMS} SELECT 'price_absurd' AS finding, id FROM items WHERE id % 50 = 0 UNION ALL SELECT 'market_label', id FROM items WHERE id % 6 = 3
  UNION ALL SELECT 'date_year_guessed', id FROM items WHERE event_date > {DAY} - 365 + INTERVAL 1 YEAR AND id % 5 <> 0
  UNION ALL SELECT 'text_broken_char', id FROM items WHERE id % 9 < 2
  UNION ALL SELECT 'prizes_resale_suspect', id FROM items WHERE id % 2 = 0 AND (id % 7 = 1 OR id % 7 = 0 AND id % 50 <> 0)
  UNION ALL SELECT 'eventdate_not_recomputable', id FROM items WHERE id % 4 = 0 AND event_date IS DISTINCT FROM DATE '1998-08-10'
  UNION ALL SELECT 'own_affiliate_stored', id FROM items WHERE id % 8 = 0 OR id % 10 = 2
  UNION ALL SELECT 'official_url_entity', id FROM items WHERE id % 8 = 4 OR id % 10 = 1""",
)
def _(spark, sf):
    return findings.of_rows(kept_values(spark, sf), findings.value_checks("1997-08-02"))


@query("foreign_on_pages", f"{ITEMS} SELECT genre AS page, id FROM items WHERE scope = 'en' AND genre NOT IN ('1-URGENT', '5-LOW')")
def _(spark, sf):
    return findings.scope_leaks(items(spark, sf).withColumnRenamed("genre", "page"), ["1-URGENT", "5-LOW"])


@query(
    "open_but_hidden",
    f"""{ITEMS} SELECT 'stores_open_but_hidden' AS finding, id FROM items WHERE id % 4 = 0 AND id % 3 <> 0
  AND cust NOT IN (SELECT cust FROM items WHERE id % 3 = 0)""",
)
def _(spark, sf):
    x = kept_values(spark, sf).join(items(spark, sf).select("id", "cust"), "id")
    return findings.open_but_hidden(x, x.where("id % 3 = 0"), F.col("cust"), TODAY)


@query(
    "prize_price_findings",
    f"""{ITEMS}, n AS (SELECT count(*) FILTER (event_date < {DAY} - 14) AS ripe FROM items WHERE id % 2 = 0)
  SELECT 'prizes_resale_missing' AS finding FROM n WHERE ripe >= 5 UNION ALL SELECT 'prizes_resale_lost'""",
)
def _(spark, sf):
    bare = F.when(F.col("id") % 2 == 0, '[{"label":"A","name":"x"}]').when(F.col("id") % 4 == 1, "broken{")
    return findings.prize_prices(kept_values(spark, sf).withColumn("prizes", bare), 12, TODAY)


@query(
    "dead_faces",
    """SELECT face, was FROM (VALUES ('urgent', 9), ('never', 7), ('few', 3)) t(face, was)
  WHERE was >= 5 AND (face <> 'urgent' OR NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT'))""",
)
def _(spark, sf):
    g = F.col("genre")
    before = spark.createDataFrame([("urgent", 9), ("never", 7), ("few", 3)], "face string, n long")
    return findings.dead_faces(items(spark, sf), {"urgent": g == "1-URGENT", "never": g == "no such", "few": g == "none"}, before)


@query(
    "lost_routes",
    f"""{ITEMS}, n AS (SELECT source, count(*) AS n, avg(CASE WHEN source = 'src1' OR id % 4 = 0 OR id % 10 IN (1, 2, 3) THEN 1.0 ELSE 0.0 END) AS now FROM items GROUP BY source)
  SELECT source, round(now, 4) AS now FROM n WHERE n >= 20 AND now < 0.5 AND source <> 'src2'""",
)
def _(spark, sf):
    before = items(spark, sf).select("source", F.when(F.col("source") == "src2", 0.4).otherwise(1.0).alias("rate")).distinct()
    return findings.lost_routes(kept_values(spark, sf), ["src1"], before)


@query(
    "past_notices",
    f"""{ITEMS} SELECT id, CASE id % 4 WHEN 0 THEN 'ended' WHEN 1 THEN 'passed' WHEN 2 THEN 'ended' ELSE 'unknown' END AS kind,
  CASE id % 4 WHEN 0 THEN '予約の受付は終了しました' WHEN 1 THEN '登場日は過ぎています' WHEN 2 THEN '応募の受付は終了しました' ELSE '掲載している日付は過ぎています' END AS headline FROM items WHERE event_date < {DAY}""",
)
def _(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("予約受付中", "登場予定", "抽選", "開催"))), (F.col("id") % 4 + 1).cast("int"))
    notice = clock.past_notice(kind, F.col("event_date"), F.lit(None).cast("string"), TODAY)
    return items(spark, sf).select("id", notice.alias("n")).where("n is not null").select("id", "n.kind", "n.headline")


@query("instants_in_japan", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y/%-m/%-d %H:%M') AS at, strftime(ts + INTERVAL 9 HOUR, '%b %-d, %Y') AS seen FROM events")
def _(spark, sf):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", clock.format_instant_jst(at).alias("at"), clock.seen_on_store_en(at).alias("seen"))


@query("half_widths", "SELECT p_partkey AS id, p_name || ' Ab9／1' AS name, CAST(p_size AS VARCHAR) || '/05-1.2' AS day FROM part")
def _(spark, sf):
    n = F.col("p_size").cast("string")
    wide = F.translate(n, "0123456789", "０１２３４５６７８９")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.half_width(F.concat("p_name", F.lit(" Ａｂ９／1"))).alias("name"), text.half_width(F.concat(wide, F.lit("／０５―1．２")), marks=True).alias("day"))


@query("production_hosts", "SELECT page_id, page_id % 4 = 0 AS production FROM pages")
def _(spark, sf):
    k = F.col("page_id") % 4
    name = F.when(k == 0, "Shop.example").when(k == 1, "App.LOCALHOST").when(k == 2, "[::1]").otherwise("x.vercel.app")
    return table(spark, sf, "pages").select("page_id", urls.is_production_host(name).alias("production"))


# --- what is said of stores, shops that were checked, varied picks ------------------------------------------------------


@query(
    "store_times",
    """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '〜本日 23:59' WHEN 1 THEN '〜明日 23:59' ELSE '〜8/9 23:59' END || CASE WHEN p_size % 4 = 3 OR p_size % 4 = 1 AND p_size % 3 = 0 THEN '（受付前）' ELSE '' END AS shown,
  '〜8/9 23:59' || CASE WHEN p_size % 4 = 3 OR p_size % 4 = 1 AND p_size % 3 = 0 THEN ' (not open yet)' ELSE '' END AS abroad FROM part""",
)
def _(spark, sf):
    k = F.col("p_size") % 4
    at = F.when(k == 0, TODAY).when(k == 1, "1998-08-03").when(k == 3, "1998-08-09")
    s = F.struct(F.lit("〜8/9 23:59").alias("when"), at.alias("at"), F.when((k == 3) | (F.col("p_size") % 3 == 0), "開始").otherwise("締切").alias("kind"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), stores.when_label(s, TODAY).alias("shown"), stores.when_label(s, TODAY, abroad=True).alias("abroad"))


@query(
    "lottery_days",
    f"""{ITEMS} SELECT id, CASE WHEN event_date = DATE '1998-08-10' AND id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN '応募締切' ELSE '受付開始' END
  WHEN source = 'src1' THEN '応募締切' WHEN source = 'src2' THEN '告知の日付' END AS meaning FROM items""",
)
def _(spark, sf):
    k = F.col("id")
    shops = F.when(k % 8 == 0, '[{"name":"S","at":"1998-08-10","kind":"開始"},{"name":"T","at":"1998-08-10","kind":"締切"}]').when(k % 4 == 0, '[{"name":"S","at":"1998-08-10","kind":"開始"}]')
    meaning = stores.lottery_day(F.col("event_date"), stores.parse_stores(shops), F.col("source"), closing=("src1",), unsure=("src2",))
    return items(spark, sf).select("id", meaning.alias("meaning"))


@query("verified_shops", f"{ITEMS} SELECT id, source = 'src1' AND id % 3 < 2 OR source = 'src2' AND id % 3 = 2 AS online FROM items")
def _(spark, sf):
    k = F.col("id") % 3
    url = F.when(k == 0, "https://www.a.example/x").when(k == 1, "https://b.example/").otherwise("https://c.example/name/dp/1")
    official = F.when(k == 1, "https://A.example/y")
    pairs = [("src1", "a.example", ""), ("src2", "c.example", "^(/[^/]+)?/dp/"), ("src3", "c.example", "^/other/")]
    return items(spark, sf).select("id", urls.is_verified_shop(F.col("source"), [url, official], pairs).alias("online"))


@query("varied_picks")
def _(spark, sf):
    x = table(spark, sf, "part").select("p_size", "p_partkey", "p_name", "p_brand")
    return analytics.varied(x, F.col("p_name"), F.col("p_brand"), ["p_size", "p_partkey"], 40, head=5).select("place", F.col("p_partkey").alias("id"))


@query(
    "claim_findings",
    f"""{ITEMS} SELECT 'lottery_prize_claim' AS finding, id FROM items WHERE id % 6 = 0
  UNION ALL SELECT 'lottery_flag', id FROM items WHERE source <> 'src3' AND (coalesce(has_lottery, FALSE) AND id % 6 IN (0, 3) OR NOT coalesce(has_lottery, FALSE) AND id % 6 = 2)
  UNION ALL SELECT 'news_post', id FROM items WHERE id % 7 < 2""",
)
def _(spark, sf):
    k = F.col("id") % 6
    said = F.when(k == 0, "賞品：x").when(k == 1, "各賞ラインナップ：賞品:y").when(k == 2, "抽選賞品あり").when(k == 3, "受付中").when(k == 4, "")
    n = F.col("id") % 7
    x = items(spark, sf).withColumns({"highlights": said, "title": F.concat(F.when(n == 0, "【速報】").when(n == 1, "【ニュース】").when(n == 2, "【告知】").otherwise(""), "title")})
    return findings.of_rows(conform(x, ITEM), findings.claim_checks(("src3",)))


@query("words_found", "SELECT p_partkey AS id, concat_ws(' ', CASE WHEN contains(p_name, 'a') THEN 'a' END, CASE WHEN contains(p_type, 'BRASS') THEN 'brass' END, CASE WHEN contains(p_type, 'TIN') THEN 'tin' END) AS words FROM part")
def _(spark, sf):
    found = text.words_found(F.concat("p_name", F.lit(" / "), "p_type"), ["a", "Brass"], ["brass", "tin"])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(found, " ").alias("words"))


@query("title_residuals", "SELECT p_partkey AS id, replace(lower(p_type), ' ', '') || CAST(p_size AS VARCHAR) AS residual FROM part")
def _(spark, sf):
    title = F.concat(F.lit("Work ブースターパック「"), "p_type", F.lit("」TCG "), F.col("p_size").cast("string"), F.lit("！"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.residual(title, ("WORK",)).alias("residual"))


@query(
    "contrasts",
    """WITH t AS (SELECT p_partkey AS id, (p_size * 5) / 255.0 AS c FROM part), l AS (SELECT id, CASE WHEN c <= 0.03928 THEN c / 12.92 ELSE pow((c + 0.055) / 1.055, 2.4) END AS y FROM t)
  SELECT id, round(1.05 / (y + 0.05), 6) AS on_white FROM l""",
)
def _(spark, sf):
    gray = F.lpad(F.hex(F.col("p_size").cast("long") * 5), 2, "0")
    color = F.concat(F.lit("#"), gray, gray, gray)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(text.contrast(color, F.lit("#ffffff")), 6).alias("on_white"))


@query("recent_goods", f"{ITEMS} SELECT id, event_date IS NULL OR id % 5 = 0 OR event_date >= {DAY} - 30 AS recent FROM items")
def _(spark, sf):
    d = F.col("event_date")
    said = F.when(F.col("id") % 5 == 0, "1998/02/30").otherwise(F.concat(F.lit("掲載日 "), F.date_format(d, "yyyy/M/d")))
    return items(spark, sf).select("id", clock.is_recent(said, TODAY).alias("recent"))


NEAREST = """CASE WHEN abs(date_diff('day', {d}, {t})) <= abs(date_diff('day', {d} - INTERVAL 1 YEAR, {t})) AND abs(date_diff('day', {d}, {t})) <= abs(date_diff('day', {d} + INTERVAL 1 YEAR, {t})) THEN {d}
  WHEN abs(date_diff('day', {d} - INTERVAL 1 YEAR, {t})) <= abs(date_diff('day', {d} + INTERVAL 1 YEAR, {t})) THEN {d} - INTERVAL 1 YEAR ELSE {d} + INTERVAL 1 YEAR END"""


@query("displayed_days", f"{ITEMS} SELECT id, event_date AS long, CAST(CASE WHEN year(event_date) = 1998 THEN {NEAREST.format(d='event_date', t=DAY)} ELSE event_date END AS DATE) AS short FROM items WHERE event_date IS NOT NULL")
def _(spark, sf):
    """Labels of days as they are shown, read back: those with a year are the day itself, others the nearest to today."""
    d = F.col("event_date")
    back = lambda label: labels.displayed_day(label, TODAY)
    return items(spark, sf).where(d.isNotNull()).select("id", back(clock.format_long(d)).alias("long"), back(clock.format_short_en(d, TODAY)).alias("short"))


@query(
    "search_hits",
    """WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS word FROM part UNION SELECT DISTINCT substr(p_name, 2, 3) FROM part UNION SELECT DISTINCT lower(substr(p_brand, 6)) FROM part)
  SELECT word, count(*) AS n FROM w JOIN (SELECT lower(p_name || ' ' || p_brand) AS title FROM part) ON contains(title, word) GROUP BY word""",
)
def _(spark, sf):
    """Words found in titles by an index of their runs of characters, each word by its rarest run."""
    p = table(spark, sf, "part")
    words = p.select(F.explode(F.split(F.lower("p_type"), " ")).alias("word")).union(p.select(F.substring("p_name", 2, 3))).union(p.select(F.lower(F.substr("p_brand", F.lit(6))))).distinct()
    index = search.index(p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("title")))
    return search.found(search.forms(words, ()).withColumnRenamed("word", "key"), index).groupBy(F.col("key").alias("word")).agg(F.count("*").alias("n"))


@query(
    "page_domains",
    """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages), t AS (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)[.]', '') AS key FROM h),
  j AS (SELECT page_id, key FROM h JOIN t ON host = key OR ends_with(host, '.' || key)) SELECT page_id, arg_max(key, length(key)) AS domain FROM j GROUP BY page_id""",
)
def _(spark, sf):
    """The most exact of the table's own domains that a page's host is under."""
    h = table(spark, sf, "pages").select(F.col("page_id").alias("id"), urls.host(F.col("url")).alias("host"))
    domains = h.select(F.regexp_replace("host", r"^(www|m|blog)\.", "").alias("key")).distinct().withColumn("value", F.col("key"))
    return places.by_host(h, domains).select(F.col("id").alias("page_id"), F.col("key").alias("domain"))
