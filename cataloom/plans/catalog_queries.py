"""Queries over the driver's tables, each with DuckDB SQL for the same rows.

The tables play the catalog's roles: orders are items (with nulls and scopes put in by key), documents are titles of many
sources, parts are names, events the log, pages landed HTML. `today` is a literal everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, names, predicates, price, stores, text, urls
from ..operators import analytics, attribution, ingest, matching, quality
from ..operators import resolve as r
from ..sources import landed, sinks
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TODAY = "1998-08-02"
LOG_TODAY = "2024-01-20"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as items."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("id"),
        F.concat(F.lit("src"), (F.col("o_custkey") % 7).cast("string")).alias("source"),
        F.col("o_orderpriority").alias("genre"),
        F.when(F.col("o_orderstatus") == "F", "release").when(F.col("o_orderstatus") == "O", "reserve").otherwise("lottery").alias("event_type"),
        F.when(k % 11 != 0, F.to_date("o_orderdate")).alias("event_date"),
        F.when(k % 13 == 0, "en").when(k % 13 == 1, "jp").alias("scope"),
        F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("has_lottery"),
        F.concat(F.lit("Order "), k.cast("string"), F.when(k % 17 == 0, " lottery").otherwise("")).alias("title"),
        F.col("o_totalprice").alias("total"),
        F.col("o_custkey").alias("cust"),
    )


ITEMS = """WITH items AS (SELECT o_orderkey AS id, 'src' || CAST(o_custkey % 7 AS VARCHAR) AS source, o_orderpriority AS genre,
  CASE o_orderstatus WHEN 'F' THEN 'release' WHEN 'O' THEN 'reserve' ELSE 'lottery' END AS event_type,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS event_date,
  CASE WHEN o_orderkey % 13 = 0 THEN 'en' WHEN o_orderkey % 13 = 1 THEN 'jp' END AS scope,
  CASE WHEN o_orderkey % 5 = 0 THEN TRUE WHEN o_orderkey % 5 = 1 THEN FALSE END AS has_lottery,
  'Order ' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 17 = 0 THEN ' lottery' ELSE '' END AS title,
  o_totalprice AS total, o_custkey AS cust FROM orders)
"""
SHOWN = "scope IS DISTINCT FROM 'en' AND (event_date IS NULL OR event_date >= DATE '1998-08-02')"
ORDER = "ORDER BY event_date ASC NULLS LAST, id DESC"


@query("catalog_upcoming", f"{ITEMS} SELECT id, genre, event_type, event_date FROM items WHERE {SHOWN} {ORDER} LIMIT 5000")
def _(spark, sf):
    x = views.filtered(items(spark, sf), TODAY)
    return views.by_day(x).limit(5000).select("id", "genre", "event_type", "event_date")


KINDS = {"reserve": ("reserve",), "release": ("release",)}


@query(
    "catalog_status_filter",
    f"""{ITEMS}, s AS (SELECT * FROM items WHERE scope IS DISTINCT FROM 'en')
  SELECT 'now' AS status, id FROM s WHERE event_date IS NULL AND event_type NOT IN ('release')
  UNION ALL SELECT 'lottery', id FROM s WHERE (event_type = 'lottery' OR coalesce(has_lottery, FALSE) OR (source <> 'snkrdunk' AND contains(title, 'lottery'))) AND (event_date IS NULL OR event_date >= DATE '1998-08-02')
  UNION ALL SELECT 'reserve', id FROM s WHERE event_type = 'reserve' AND (event_date IS NULL OR event_date >= DATE '1998-08-02')
  UNION ALL SELECT 'release', id FROM s WHERE event_type = 'release' AND (event_date IS NULL OR event_date >= DATE '1998-08-02')""",
)
def _(spark, sf):
    x = items(spark, sf).where(predicates.in_scope(F.col("scope")))
    d, kind = F.col("event_date"), F.col("event_type")
    up = predicates.upcoming(d, TODAY)
    flags = {
        "now": predicates.is_now(d, kind, ("release",)),
        "lottery": up & predicates.is_lottery(kind, F.col("has_lottery"), F.col("title"), F.col("source"), "lottery", "lottery"),
        **{s: up & predicates.has_type(kind, s, KINDS) for s in KINDS},
    }
    return x.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in flags.items()]))).alias("status"), "id")


@query("catalog_week_window", f"{ITEMS} SELECT day, id, event_date FROM items, (SELECT unnest(['1998-08-02', '1998-08-03']) AS day) WHERE event_date >= DATE '1998-08-02' AND event_date < DATE '1998-08-03' AND day = '1998-08-02' OR event_date >= DATE '1998-08-03' AND event_date < DATE '1998-08-10' AND day = '1998-08-03'")
def _(spark, sf):
    """The weeks of a Sunday and of the Monday after it, each whole."""
    days = ("1998-08-02", "1998-08-03")
    week = F.array_compact(F.array(*[F.when(predicates.this_week(F.col("event_date"), d), F.lit(d)) for d in days]))
    return items(spark, sf).select(F.explode(week).alias("day"), "id", "event_date")


@query("catalog_month_window", f"{ITEMS} SELECT id, event_date FROM items WHERE event_date >= DATE '1998-08-02' AND event_date < DATE '1998-09-01'")
def _(spark, sf):
    return items(spark, sf).where(predicates.this_month(F.col("event_date"), TODAY)).select("id", "event_date")


@query("catalog_recent", f"{ITEMS} SELECT id, genre FROM items WHERE scope IS DISTINCT FROM 'en' ORDER BY id DESC LIMIT 100")
def _(spark, sf):
    return items(spark, sf).where(predicates.in_scope(F.col("scope"))).orderBy(F.desc("id")).limit(100).select("id", "genre")


@query("catalog_page_slice", f"{ITEMS}, n AS (SELECT id, row_number() OVER ({ORDER}) AS rn FROM (SELECT * FROM items WHERE {SHOWN} {ORDER} LIMIT 5000)) SELECT id, rn FROM n WHERE rn BETWEEN 61 AND 120")
def _(spark, sf):
    x = views.by_day(views.filtered(items(spark, sf), TODAY)).limit(5000)
    # the limit bounds the window to one view's rows
    w = Window.orderBy(F.col("event_date").asc_nulls_last(), F.col("id").desc())
    return x.select("id", F.row_number().over(w).cast("long").alias("rn")).where(F.col("rn").between(61, 120))


@query("catalog_point_lookup", f"{ITEMS} SELECT id, title, genre FROM items WHERE id IN (1, 7, 4242)")
def _(spark, sf):
    return items(spark, sf).where(F.col("id").isin(1, 7, 4242)).select("id", "title", "genre")


@query("genre_counts", f"{ITEMS} SELECT genre, count(*) AS n FROM items GROUP BY genre")
def _(spark, sf):
    return items(spark, sf).groupBy("genre").agg(F.count("*").alias("n"))


@query("source_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("source_min_seen", f"{ITEMS} SELECT source, count(*) AS n, min(event_date) AS first_seen FROM items GROUP BY source")
def _(spark, sf):
    return items(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.min("event_date").alias("first_seen"))


@query("last_updated", "SELECT max(ts) AS last_updated, min(ts) AS oldest_seen FROM events")
def _(spark, sf):
    return table(spark, sf, "events").agg(F.max("ts").alias("last_updated"), F.min("ts").alias("oldest_seen"))


@query("facet_counts", f"{ITEMS}, v AS (SELECT unnest({PRIORITIES}) AS genre) SELECT v.genre, coalesce(n, 0) AS n FROM v LEFT JOIN (SELECT genre, count(*) AS n FROM items WHERE {SHOWN} AND event_type = 'reserve' GROUP BY genre) c ON v.genre = c.genre")
def _(spark, sf):
    x = items(spark, sf).where(F.col("event_type") == "reserve")
    return views.facets(x, TODAY, PRIORITIES)


VOCABULARY = ["fr", "en", "es"]


@query("genre_vocab_order", "SELECT lang AS genre, count(*) AS n, CAST(coalesce(nullif(list_position(['fr', 'en', 'es'], lang), 0), 99) AS INTEGER) AS place FROM documents GROUP BY lang")
def _(spark, sf):
    return views.genres_in_order(table(spark, sf, "documents").withColumnRenamed("lang", "genre"), VOCABULARY)


@query(
    "date_buckets",
    """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN d IS NULL THEN '日付未定' WHEN d < DATE '2024-01-18' THEN '今日' WHEN d < DATE '2024-01-19' THEN '明日'
    WHEN d < DATE '2024-01-22' THEN '今週' ELSE 'それ以降' END AS bucket FROM (SELECT CASE WHEN event_id % 10 <> 0 THEN CAST(ts AS DATE) END AS d FROM events)) GROUP BY bucket""",
)
def _(spark, sf):
    x = table(spark, sf, "events").select(F.when(F.col("event_id") % 10 != 0, F.to_date("ts")).alias("event_date"))
    return views.buckets(x, "2024-01-17").groupBy("bucket").agg(F.count("*").alias("n"))


PERIODS = """p AS (SELECT id, greatest(least(event_date, event_date - CAST(id % 90 AS INTEGER)), event_date - 62) AS s, event_date AS e FROM items WHERE event_date IS NOT NULL)"""


def _with_days(spark, sf):
    return items(spark, sf).withColumn("days", F.array(F.date_sub("event_date", (F.col("id") % 90).cast("int"))))


@query("month_membership", f"{ITEMS}, {PERIODS} SELECT id, s AS start, e AS \"end\" FROM p WHERE s < DATE '1998-09-01' AND e >= DATE '1998-08-01'")
def _(spark, sf):
    p = clock.period(F.col("event_date"), F.when(F.col("event_date").isNotNull(), F.col("days")))
    x = _with_days(spark, sf).select("id", p.alias("p"))
    return x.where(clock.overlaps(F.col("p"), F.lit("1998-08-01").cast("date"), F.lit("1998-09-01").cast("date"))).select("id", "p.start", "p.end")


@query("month_list", f"{ITEMS}, {PERIODS}, m AS (SELECT unnest(generate_series(date_trunc('month', s), date_trunc('month', e), INTERVAL 1 MONTH)) AS month FROM p) SELECT CAST(month AS DATE) AS month, count(*) AS n FROM m WHERE month >= DATE '1998-08-01' GROUP BY month")
def _(spark, sf):
    x = _with_days(spark, sf)
    return views.months(x, TODAY, F.when(F.col("event_date").isNotNull(), F.col("days"))).select(F.col("month").cast("date").alias("month"), "n")


@query("month_calendar", f"{ITEMS}, d AS (SELECT CAST(unnest(generate_series(DATE '1998-07-26', DATE '1998-09-05', INTERVAL 1 DAY)) AS DATE) AS day) SELECT d.day, d.day BETWEEN DATE '1998-08-01' AND DATE '1998-08-31' AS in_month, CASE WHEN d.day BETWEEN DATE '1998-08-01' AND DATE '1998-08-31' THEN count(id) ELSE 0 END AS n FROM d LEFT JOIN items ON event_date = d.day GROUP BY d.day")
def _(spark, sf):
    return views.calendar(items(spark, sf), "1998-08")


# --- entity resolution -------------------------------------------------------------------------------------------------

TITLES = """WITH t AS (SELECT doc_id AS id, source, lang AS genre, text AS title, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k,
  CAST(CASE WHEN n_chars % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN doc_id % 3 <> 0 THEN 4 ELSE 0 END AS INTEGER) AS worth FROM documents)
"""


def titles(spark, sf):
    x = table(spark, sf, "documents")
    worth = F.when(F.col("n_chars") % 2 == 0, 8).otherwise(0) + F.when(F.col("doc_id") % 3 != 0, 4).otherwise(0)
    return x.select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("genre"), F.col("text").alias("title"), text.ascii_key(F.col("text")).alias("k"), worth.alias("worth"))


@query("representative_pick", f"{TITLES} SELECT id, k_hash FROM (SELECT id, md5(k) AS k_hash, row_number() OVER (PARTITION BY k ORDER BY worth DESC, id) AS rn FROM t) WHERE rn = 1")
def _(spark, sf):
    x = titles(spark, sf).withColumn("k_hash", F.md5("k"))
    return x.groupBy("k_hash").agg(F.min(F.struct(-F.col("worth"), F.col("id").alias("id"))).alias("best")).select("best.id", "k_hash")


@query(
    "dedupe_cross_source",
    f"""{TITLES}, g AS (SELECT k FROM t WHERE length(k) >= 6 GROUP BY k HAVING count(DISTINCT source) > 1),
  b AS (SELECT id, row_number() OVER (PARTITION BY k ORDER BY worth DESC, id) AS rn FROM t JOIN g USING (k))
  SELECT id, source FROM t WHERE id NOT IN (SELECT id FROM b WHERE rn > 1)""",
)
def _(spark, sf):
    x = titles(spark, sf)
    gone = r.targets(x, F.when(F.length("k") >= 6, F.md5("k")), r.best_first(), sources=2)
    return x.join(gone, "id", "left_anti").select("id", "source")


PARTS = """WITH p AS (SELECT p_partkey AS id, p_brand AS source, CASE WHEN p_partkey % 2 = 1 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) ELSE p_name END AS title, p_retailprice AS price, p_size, p_type FROM part),
 q AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS k FROM p)
"""


def parts(spark, sf):
    words = F.split("p_name", " ")
    title = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.coalesce(F.get(words, F.lit(1)), F.lit("")), F.lit(" "), words[0])).otherwise(F.col("p_name"))
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("source"), title.alias("title"), F.col("p_retailprice").alias("price"), "p_size", "p_type")
    return x.withColumn("k", text.ascii_key(F.col("title")))


@query(
    "dedupe_anagram",
    f"""{PARTS}, a AS (SELECT *, array_to_string(list_sort(string_split(k, '')), '') AS ak FROM q WHERE length(k) >= 10),
  g AS (SELECT ak FROM a GROUP BY ak HAVING count(DISTINCT source) > 1),
  b AS (SELECT id, first_value(id) OVER (PARTITION BY ak ORDER BY price DESC, id) AS into_id FROM a JOIN g USING (ak)) SELECT id, into_id FROM b WHERE id <> into_id""",
)
def _(spark, sf):
    x = parts(spark, sf)
    key = F.when(F.length("k") >= 10, text.anagram_key(F.col("k")))
    return r.targets(x, key, [-F.col("price")], sources=2).select("id", F.col("into").alias("into_id"))


@query("dedupe_same_source_exact", f"{ITEMS}, g AS (SELECT *, first_value(id) OVER (PARTITION BY source, cust, coalesce(CAST(event_date AS VARCHAR), 'none') ORDER BY total DESC, id) AS into_id FROM items) SELECT id, into_id FROM g WHERE id <> into_id")
def _(spark, sf):
    x = items(spark, sf)
    key = F.concat_ws("|", "source", F.col("cust").cast("string"), F.coalesce(F.col("event_date").cast("string"), F.lit("none")))
    return r.targets(x, key, [-F.col("total")]).select("id", F.col("into").alias("into_id"))


@query(
    "dedupe_contained_name",
    """WITH n AS (SELECT replace(p_name, ' ', '') AS name, min(p_partkey) AS id FROM part GROUP BY 1 UNION ALL SELECT substr(replace(p_name, ' ', ''), 3, 9), min(p_partkey) + 1000000 FROM part GROUP BY 1)
  SELECT id FROM n b WHERE NOT EXISTS (SELECT 1 FROM n a WHERE a.name <> b.name AND contains(a.name, b.name) AND length(a.name) >= 8)""",
)
def _(spark, sf):
    """Names of one page, and pieces of them."""
    from ..schema import ITEM, conform

    plain = F.replace("p_name", F.lit(" "), F.lit(""))
    names = lambda c, more: table(spark, sf, "part").groupBy(c.alias("title")).agg((F.min("p_partkey") + more).alias("id"))
    x = names(plain, 0).unionByName(names(F.substring(plain, 3, 9), 1_000_000))
    x = r.with_order(conform(x.withColumns({"source": F.lit("s"), "url": F.lit("https://shop.example/list")}), ITEM))
    return r.contained_names(x, F.col("title")).select("id")


@query(
    "dedupe_nearest_move",
    """WITH m AS (SELECT o_custkey, o_orderkey AS id, o_totalprice, min(abs(date_diff('day', DATE '1998-08-02', CAST(l_shipdate AS DATE)))) AS near FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
  SELECT o_custkey AS cust, id, near FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY near, o_totalprice DESC, id) AS rn FROM m) WHERE rn = 1""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.abs(F.datediff(F.to_date("l_shipdate"), F.lit(TODAY).cast("date")))).cast("long").alias("near"))
    x = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("id"), "o_totalprice").join(lines, "id")
    best = x.groupBy("cust").agg(F.min(F.struct("near", (-F.col("o_totalprice")).alias("p"), "id")).alias("b"))
    return best.select("cust", "b.id", "b.near")


@query(
    "dedupe_sneaker_anti",
    """SELECT o_orderkey AS id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE CAST(l.l_shipdate AS DATE) = CAST(o.o_orderdate AS DATE)
  AND CAST(floor(l.l_extendedprice / 2000) AS BIGINT) = CAST(floor(o.o_totalprice / 2000) AS BIGINT) AND l.l_suppkey % 3 = 0)""",
)
def _(spark, sf):
    strong = table(spark, sf, "lineitem").where(F.col("l_suppkey") % 3 == 0).select(F.to_date("l_shipdate").alias("d"), F.floor(F.col("l_extendedprice") / 2000).alias("y")).distinct()
    x = table(spark, sf, "orders")
    return x.join(strong, (F.to_date("o_orderdate") == F.col("d")) & (F.floor(F.col("o_totalprice") / 2000) == F.col("y")), "left_anti").select(F.col("o_orderkey").alias("id"))


@query(
    "dedupe_identical_title",
    f"""{ITEMS}, g AS (SELECT id, first_value(id) OVER (PARTITION BY source, cust ORDER BY CASE WHEN event_date IS NULL THEN 1 ELSE 0 END, event_date, id DESC) AS head,
  min(CASE WHEN event_date IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY source, cust) AS rank, event_date FROM items)
  SELECT id, head AS into_id FROM g WHERE rank = 0 AND event_date IS NULL""",
)
def _(spark, sf):
    x = items(spark, sf)
    first = F.struct(F.col("event_date").isNull().alias("none"), "event_date", (-F.col("id")).alias("o"))
    heads = x.groupBy("source", "cust").agg(F.min(first).alias("h")).where(~F.col("h.none"))
    return x.where("event_date is null").join(heads, ["source", "cust"]).select("id", (-F.col("h.o")).alias("into_id"))


@query(
    "enrichment_inherit",
    f"""{TITLES}, g AS (SELECT t.*, q.quality, first_value(t.id) OVER (PARTITION BY k ORDER BY worth DESC, t.id) AS head FROM t LEFT JOIN labels q ON q.doc_id = t.id),
  f AS (SELECT head AS id, arg_min(quality, id) FILTER (WHERE id <> head AND quality IS NOT NULL) AS got FROM g GROUP BY head)
  SELECT g.id, coalesce(g.quality, f.got) AS quality FROM g JOIN f ON g.id = f.id""",
)
def _(spark, sf):
    x = titles(spark, sf).withColumn("k", F.md5("k"))
    known = x.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    heads = known.groupBy("k").agg(F.min(F.struct(-F.col("worth"), F.col("id").alias("id"))).alias("b")).select("k", F.col("b.id").alias("head"))
    own = known.join(heads, "k")
    got = own.groupBy("head").agg(F.min(F.when((F.col("id") != F.col("head")) & F.col("quality").isNotNull(), F.struct("id", "quality"))).alias("g"))
    return own.where("id = head").drop("head").join(got, F.col("id") == F.col("head")).select("id", F.coalesce("quality", "g.quality").alias("quality"))


@query("url_key", r"SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1), '^(www|m)\.', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS page_key FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.page_key(F.col("url")).alias("page_key"))


@query(
    "product_key",
    r"""WITH u AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1) AS h, list_filter(string_split(regexp_extract(lower(url), '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)
  SELECT page_id, h || '/' || p[1] || '/' || p[2] AS product_key FROM u WHERE len(p) = 2 AND regexp_full_match(p[1], '[a-z]{2,8}')""",
)
def _(spark, sf):
    key = urls.product_key(F.col("url"), kinds="[a-z]{2,8}")
    return table(spark, sf, "pages").select("page_id", key.alias("product_key")).where("product_key is not null")


# --- landing -----------------------------------------------------------------------------------------------------------


@query("reconcile_missing", f"{ITEMS} SELECT id, source FROM items WHERE NOT (source IN ('src0', 'src1') AND id % 3 = 0)")
def _(spark, sf):
    x = items(spark, sf).withColumn("source_id", F.col("id"))
    done = spark.createDataFrame([("src0",), ("src1",)], "source string")
    return ingest.reconcile(x, x.where(F.col("id") % 3 != 0), done).select("id", "source")


@query(
    "upsert_merge",
    f"""{ITEMS}, o AS (SELECT id, genre, event_date, total FROM items WHERE id % 3 <> 0), n AS (SELECT id, 'new' AS genre, CASE WHEN id % 2 = 0 THEN event_date END AS event_date, CASE WHEN id % 4 = 0 THEN total + 1 END AS total FROM items WHERE id % 5 <> 0)
  SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.genre ELSE o.genre END AS genre, CASE WHEN n.id IS NOT NULL THEN n.event_date ELSE o.event_date END AS event_date, coalesce(n.total, o.total) AS total FROM o FULL JOIN n ON o.id = n.id""",
)
def _(spark, sf):
    x = items(spark, sf)
    old = x.where(F.col("id") % 3 != 0).select("id", "genre", "event_date", "total")
    new = x.where(F.col("id") % 5 != 0).select("id", F.lit("new").alias("genre"), F.when(F.col("id") % 2 == 0, F.col("event_date")).alias("event_date"), F.when(F.col("id") % 4 == 0, F.col("total") + 1).alias("total"))
    return ingest.upsert(old, new, ("id",), overwrite=("genre", "event_date"), keep=("total",))


@query("rename_vocabulary", f"{ITEMS} SELECT id, CASE genre WHEN '5-LOW' THEN 'low' WHEN '1-URGENT' THEN 'urgent' ELSE genre END AS genre FROM items")
def _(spark, sf):
    return ingest.rename(items(spark, sf).select("id", "genre"), "genre", {"5-LOW": "low", "1-URGENT": "urgent"})


@query("window_expiry", f"{ITEMS} SELECT id FROM items WHERE coalesce(date_diff('day', event_date, DATE '1998-08-02') <= 30, TRUE)")
def _(spark, sf):
    return ingest.expire(items(spark, sf), F.col("event_date"), TODAY).select("id")


CRAWL = """WITH c AS (SELECT event_type AS source, CAST(event_id // 500 AS BIGINT) AS page, user_id % 97 AS key, CAST(ts AS DATE) AS day, event_id AS pos FROM events),
 f AS (SELECT source, key, min(page) AS page FROM c GROUP BY ALL), a AS (SELECT source, page, count(*) AS added FROM f GROUP BY ALL),
 l AS (SELECT source, page, arg_max(day, pos) < DATE '2024-01-10' AS old FROM c GROUP BY ALL), x AS (SELECT l.source, l.page, coalesce(added, 0) AS added, old FROM l LEFT JOIN a ON l.source = a.source AND l.page = a.page)
 SELECT *, CASE WHEN old OR added = 0 THEN 'stop' WHEN page >= 15 THEN 'overrun' ELSE 'continue' END AS decision FROM x"""


@query("crawl_pages", CRAWL)
def _(spark, sf):
    e = table(spark, sf, "events")
    x = e.select(F.col("event_type").alias("source"), F.floor(F.col("event_id") / 500).alias("page"), (F.col("user_id") % 97).alias("key"), F.to_date("ts").alias("day"), F.col("event_id").alias("pos"))
    return ingest.pages_to_read(x, "2024-01-10", 15)


@query("market_work_queue", f"{ITEMS} SELECT id, event_date FROM items ORDER BY event_date ASC NULLS FIRST, id DESC LIMIT 50")
def _(spark, sf):
    return items(spark, sf).orderBy(F.col("event_date").asc_nulls_first(), F.desc("id")).limit(50).select("id", "event_date")


@query(
    "group_offers",
    """WITH o AS (SELECT p_name AS title, regexp_replace(lower(p_name), '[aeiou ]', '', 'g') AS k, p_brand AS store, DATE '2024-01-01' + CAST(p_size AS INTEGER) AS d FROM part),
 t AS (SELECT k, title, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, length(title), title) AS rn FROM o GROUP BY k, title)
 SELECT o.k, t.title, count(DISTINCT store) AS n_stores, max(d) AS event_date, min(d) AS soonest FROM o JOIN t ON o.k = t.k AND rn = 1 GROUP BY o.k, t.title""",
)
def _(spark, sf):
    x = table(spark, sf, "part").select(F.col("p_name").alias("title"), F.col("p_brand").alias("store"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("deadline"))
    return ingest.group_offers(x, F.regexp_replace(F.lower("title"), "[aeiou ]", ""))


# --- attribution and drift ---------------------------------------------------------------------------------------------

LOSS = f"""{ITEMS}, b AS (SELECT CASE WHEN id % 4 = 0 THEN '/release/1998-08' ELSE '/genre/' || genre END AS page, id FROM items WHERE event_date IS NULL OR event_date >= DATE '1998-06-01'),
 n AS (SELECT CASE WHEN id % 4 = 0 THEN '/release/1998-08' ELSE '/genre/' || genre END AS page, id FROM items WHERE (event_date IS NULL OR event_date >= DATE '1998-08-02') AND id % 7 <> 0 UNION SELECT '/premium', id FROM items WHERE id % 28 = 0),
 f AS (SELECT id, event_date, cust % 400 AS merge_key FROM items WHERE id % 19 <> 0),
 r AS (SELECT * FROM b EXCEPT SELECT * FROM n),
 c AS (SELECT r.page, r.id, CASE WHEN f.id IS NULL THEN 'gone' WHEN r.page <> '/premium' AND NOT starts_with(r.page, '/release/') AND f.event_date < DATE '1998-08-02' THEN 'expired'
   WHEN EXISTS (SELECT 1 FROM n JOIN f g ON n.id = g.id WHERE n.page = r.page AND g.merge_key = f.merge_key) THEN 'merged' WHEN r.id IN (SELECT id FROM n) THEN 'moved' ELSE 'unexplained' END AS cause FROM r LEFT JOIN f ON r.id = f.id)
"""


def _pages(spark, sf):
    x = items(spark, sf)
    page = F.when(F.col("id") % 4 == 0, "/release/1998-08").otherwise(F.concat(F.lit("/genre/"), F.col("genre")))
    before = x.where(F.col("event_date").isNull() | (F.col("event_date") >= "1998-06-01")).select(page.alias("page"), "id")
    now = x.where(predicates.upcoming(F.col("event_date"), TODAY) & (F.col("id") % 7 != 0)).select(page.alias("page"), "id").unionByName(x.where(F.col("id") % 28 == 0).select(F.lit("/premium").alias("page"), "id"))
    facts = x.where(F.col("id") % 19 != 0).select("id", "event_date", F.lit(None).cast("string").alias("event_date_text"), (F.col("cust") % 400).alias("merge_key"))
    return before, now, facts


@query("page_loss_attribution", LOSS + " SELECT * FROM c")
def _(spark, sf):
    return attribution.classify_losses(*_pages(spark, sf), TODAY)


@query(
    "page_loss_report",
    LOSS
    + """, s AS (SELECT coalesce(b.page, n.page) AS page, coalesce(b.k, 0) AS prev, coalesce(n.k, 0) AS cur FROM (SELECT page, count(*) AS k FROM b GROUP BY page) b FULL JOIN (SELECT page, count(*) AS k FROM n GROUP BY page) n ON b.page = n.page),
 w AS (SELECT page, count(*) FILTER (cause = 'unexplained') AS un FROM c GROUP BY page)
 SELECT s.page, prev, cur, coalesce(un, 0) AS unexplained, CASE WHEN least(coalesce(un, 0), prev - cur) >= 3 AND least(coalesce(un, 0), prev - cur) >= prev * 0.05 THEN least(coalesce(un, 0), prev - cur) ELSE 0 END AS report FROM s LEFT JOIN w ON s.page = w.page""",
)
def _(spark, sf):
    return attribution.page_report(*_pages(spark, sf), TODAY).select("page", "prev", "cur", "unexplained", "report")


PROFILE = """WITH d AS (SELECT source, doc_id, n_chars, text FROM documents), o AS (SELECT source, count(*) AS n, avg(CASE WHEN doc_id % 3 <> 0 THEN 1.0 ELSE 0.0 END) AS dated, avg(length(text)) AS len FROM d WHERE doc_id % 2 = 0 GROUP BY source),
 w AS (SELECT source, count(*) AS n, avg(CASE WHEN doc_id % 5 <> 0 THEN 1.0 ELSE 0.0 END) AS dated, avg(length(text)) AS len FROM d WHERE doc_id % 2 = 1 OR doc_id % 10 = 4 GROUP BY source)
"""


def _profiles(spark, sf):
    x = table(spark, sf, "documents").select("source", F.col("doc_id").alias("id"), F.col("text").alias("title"), F.lit("i").alias("image_url"))
    day = lambda k: F.when(F.col("id") % k != 0, F.lit(TODAY).cast("date")).alias("event_date")
    old = x.where(F.col("id") % 2 == 0).select("*", day(3))
    new = x.where((F.col("id") % 2 == 1) | (F.col("id") % 10 == 4)).select("*", day(5))
    return attribution.profile(old), attribution.profile(new)


@query("source_profile", PROFILE + " SELECT source, n, round(dated, 6) AS dated, round(len, 6) AS title_len FROM o")
def _(spark, sf):
    return _profiles(spark, sf)[0].select("source", "n", F.round("dated", 6).alias("dated"), F.round("title_len", 6).alias("title_len"))


@query(
    "drift_compare",
    PROFILE
    + """, j AS (SELECT coalesce(o.source, w.source) AS source, o.n AS a, w.n AS b, o.dated AS da, w.dated AS db, o.len AS la, w.len AS lb FROM o FULL JOIN w ON o.source = w.source)
 SELECT source, 'appeared' AS what FROM j WHERE a IS NULL UNION ALL SELECT source, 'vanished' FROM j WHERE b IS NULL UNION ALL SELECT source, 'count' FROM j WHERE a >= 5 AND abs(b - a) / a > 0.3
 UNION ALL SELECT source, 'dated' FROM j WHERE a >= 5 AND abs(db - da) > 0.2 UNION ALL SELECT source, 'title_len' FROM j WHERE a >= 5 AND abs(lb - la) / la > 0.25""",
)
def _(spark, sf):
    return attribution.drift(*_profiles(spark, sf))


@query("health_check", PROFILE + " SELECT o.source, CASE WHEN o.n >= 5 AND coalesce(w.n, 0) = 0 THEN 'zero' WHEN o.n >= 5 AND w.n < o.n * 0.5 THEN 'halved' WHEN o.dated >= 0.5 AND o.dated - w.dated > 0.4 THEN 'dates' ELSE 'fine' END AS problem FROM o LEFT JOIN w ON o.source = w.source")
def _(spark, sf):
    old, new = (p.select("source", "n", F.col("dated").alias("date_rate")) for p in _profiles(spark, sf))
    return old.select("source").join(attribution.health(old, new), "source", "left").na.fill("fine", ["problem"])


# --- the event log -----------------------------------------------------------------------------------------------------


@query("event_top_values", "SELECT coalesce(nullif(trim(json_extract_string(props, '$.k')), ''), '(不明)') AS value, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def _(spark, sf):
    return analytics.top_values(table(spark, sf, "events"), "view", F.get_json_object("props", "$.k"))


@query("daily_series", "SELECT CAST(ts AS DATE) AS day, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1")
def _(spark, sf):
    return analytics.daily(table(spark, sf, "events"))


@query("dimension_top", "SELECT event_type AS dimension, count(*) AS n, count(DISTINCT user_id) AS visitors FROM events WHERE user_id % 2 = 0 GROUP BY 1 ORDER BY n DESC, dimension LIMIT 3")
def _(spark, sf):
    return analytics.top_dimension(table(spark, sf, "events"), F.col("event_type"), 3, F.col("user_id") % 2 == 0)


@query("crawler_days", "SELECT event_type AS grp, CAST(ts AS DATE) AS day, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events GROUP BY ALL HAVING count(*) >= 7 AND count(*) >= count(DISTINCT user_id) * 1.05")
def _(spark, sf):
    return analytics.heavy_days(table(spark, sf, "events"), F.col("event_type"), 7, 1.05)


@query(
    "ratio_breakdown",
    """SELECT event_type, CAST(floor(count(*) FILTER (user_id % 3 = 0) * 100 / count(*) + 0.5) AS BIGINT) AS pct_direct, count(*) FILTER (value > 50) AS clicks,
  round(count(*) FILTER (value > 50) * 100.0 / count(*), 6) AS ctr FROM events GROUP BY event_type""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(analytics.share(F.col("user_id") % 3 == 0).alias("pct_direct"), F.count_if(F.col("value") > 50).alias("clicks"), F.round(F.count_if(F.col("value") > 50) * 100.0 / F.count("*"), 6).alias("ctr"))


@query("query_page_grouping", "SELECT event_type AS q, user_id % 10 AS page, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("q"), (F.col("user_id") % 10).alias("page")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("optout_alert", "SELECT count(*) FILTER (event_type = 'error') AS n, count(*) FILTER (event_type = 'error') > 5 AS alert FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20'")
def _(spark, sf):
    e = table(spark, sf, "events").where(F.col("ts") >= F.lit(LOG_TODAY).cast("timestamp"))
    n = F.count_if(F.col("event_type") == "error")
    return e.agg(n.alias("n"), (n > 5).alias("alert"))


@query("freshness_stale", "SELECT event_type || CAST(user_id % 40 AS VARCHAR) AS source, count(*) AS n, max(ts) AS newest, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS idle_days FROM events GROUP BY 1 HAVING date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') >= 3")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("source", F.concat("event_type", (F.col("user_id") % 40).cast("string")))
    return analytics.stale(e, "ts", "2024-02-01").withColumn("idle_days", F.col("idle_days").cast("long"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "struct<k: long>")["k"].alias("k")).where(F.col("k") % 2 == 0)


@query("event_log_append", "SELECT event_id AS id, event_type AS name, substr(props, 1, 200) AS value FROM events WHERE event_type IN ('click', 'view')")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.col("props").alias("value"))
    return sinks.prepared(e, ["click", "view"])


@query(
    "log_decision",
    """SELECT event_id, CASE WHEN user_id % 9 = 0 OR user_id % 4 = 0 OR event_type IN ('error', 'signup') THEN 'skip' ELSE 'store' END AS action,
  CASE WHEN user_id % 9 = 0 THEN 'opted_out' WHEN user_id % 4 = 0 THEN 'not_production' WHEN event_type = 'error' THEN 'automation' WHEN event_type = 'signup' THEN 'crawler' END AS reason FROM events""",
)
def _(spark, sf):
    agent = F.when(F.col("event_type") == "error", "Mozilla HeadlessChrome").when(F.col("event_type") == "signup", "Googlebot/2.1").otherwise("Mozilla/5.0")
    d = urls.log_decision(F.col("user_id") % 9 == 0, F.col("user_id") % 4 != 0, agent)
    return table(spark, sf, "events").select("event_id", d.alias("d")).select("event_id", "d.action", "d.reason")


# --- prices ------------------------------------------------------------------------------------------------------------

YEN = "CAST(floor(p_retailprice) AS BIGINT)"


@query(
    "margin",
    f"""WITH m AS (SELECT p_partkey AS id, {YEN} AS list_price, {YEN} * (p_size % 25) // 10 AS market FROM part WHERE p_partkey % 10 <> 3)
  SELECT id, list_price, market, market - list_price AS diff, CAST(floor((market - list_price) / list_price * 100 + 0.5) AS BIGINT) AS pct, market > list_price AS is_premium FROM m WHERE market > 0 AND list_price BETWEEN 10 AND 999999999 AND market / list_price BETWEEN 0.05 AND 10""",
)
def _(spark, sf):
    yen = F.floor("p_retailprice")
    label = F.when(F.col("p_partkey") % 10 == 3, F.concat(F.lit("1回 "), yen.cast("string"), F.lit("円"))).otherwise(F.concat(F.format_number(yen, 0), F.lit("円（税込）")))
    m = price.margin(label, F.floor(yen * (F.col("p_size") % 25) / 10))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), m.alias("m")).where("m is not null").select("id", "m.*")


@query("price_buckets", "SELECT split_part(p_type, ' ', 1) AS noun, min(p_retailprice) AS low, max(p_retailprice) AS high, min(p_partkey) AS first_pos FROM part GROUP BY 1 ORDER BY first_pos LIMIT 6")
def _(spark, sf):
    return analytics.price_buckets(table(spark, sf, "part"), F.split("p_type", " ")[0], F.col("p_retailprice"), F.col("p_partkey"))


@query("premium_order", f"SELECT p_partkey AS id, {YEN} AS market, CASE WHEN p_partkey % 6 <> 0 THEN p_size END AS pct FROM part ORDER BY market DESC, pct DESC NULLS LAST, id LIMIT 200")
def _(spark, sf):
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.floor("p_retailprice").alias("market"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_size")).alias("pct"))
    return x.orderBy(F.desc("market"), F.col("pct").desc_nulls_last(), "id").limit(200)


@query(
    "same_url_best",
    """SELECT p_brand || '/' || p_name AS url, arg_min(p_partkey, {'a': CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END, 'b': p_partkey}) AS id FROM part GROUP BY 1""",
)
def _(spark, sf):
    x = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_name").alias("url"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 == 0).alias("no_price"))
    return x.groupBy("url").agg(F.min(F.struct("no_price", "id")).alias("b")).select("url", "b.id")


@query("countdown", f"{ITEMS} SELECT id, date_diff('day', DATE '1998-08-02', event_date) AS days, CASE date_diff('day', DATE '1998-08-02', event_date) WHEN 0 THEN '本日' WHEN 1 THEN '明日' ELSE 'あと' || CAST(date_diff('day', DATE '1998-08-02', event_date) AS VARCHAR) || '日' END AS text, CASE WHEN date_diff('day', DATE '1998-08-02', event_date) <= 1 THEN 'urgent' WHEN date_diff('day', DATE '1998-08-02', event_date) <= 3 THEN 'soon' ELSE 'week' END AS tone FROM items WHERE event_date BETWEEN DATE '1998-08-02' AND DATE '1998-08-09'")
def _(spark, sf):
    x = items(spark, sf).select("id", clock.countdown(F.col("event_date"), TODAY).alias("c")).where("c is not null")
    return x.select("id", F.col("c.days").cast("long").alias("days"), "c.text", "c.tone")


@query(
    "planned_dates",
    f"""{ITEMS}, w AS (SELECT id, CAST(year(event_date) AS INTEGER) AS y, CAST(month(event_date) AS INTEGER) AS m, CAST(id % 5 + 1 AS INTEGER) AS wk, id % 4 AS form, day(event_date) AS dd FROM items WHERE event_date IS NOT NULL)
  SELECT id, CASE form WHEN 0 THEN make_date(y, m, 1) + (wk - 1) * 7 WHEN 1 THEN make_date(y, m, dd) WHEN 2 THEN CAST(make_date(y, m, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) END AS planned FROM w""",
)
def _(spark, sf):
    x = items(spark, sf).where("event_date is not null")
    d, k = F.col("event_date"), F.col("id") % 4
    y, m = F.year(d).cast("string"), F.month(d).cast("string")
    week = F.concat(y, F.lit("年"), m, F.lit("月第"), (F.col("id") % 5 + 1).cast("string"), F.lit("週登場予定"))
    label = F.when(k == 0, week).when(k == 1, F.concat(y, F.lit("/"), m, F.lit("/"), F.dayofmonth(d).cast("string"), F.lit(" 受付開始"))).when(k == 2, F.concat(y, F.lit("年"), m, F.lit("月発売予定"))).otherwise(F.concat(y, F.lit("年"), m, F.lit("月号")))
    return x.select("id", clock.planned_date(label).alias("planned"))


@query("nearest_year", f"{ITEMS}, c AS (SELECT id, event_date, unnest([make_date(1998, month(event_date), 1) + (day(event_date) - 1)::INTEGER, make_date(1997, month(event_date), 1) + (day(event_date) - 1)::INTEGER, make_date(1999, month(event_date), 1) + (day(event_date) - 1)::INTEGER]) AS d, unnest([0, 1, 2]) AS k FROM items WHERE event_date IS NOT NULL) SELECT id, arg_min(d, {{'o': abs(date_diff('day', DATE '1998-08-02', d)), 'k': k}}) AS resolved FROM c GROUP BY id")
def _(spark, sf):
    x = items(spark, sf).where("event_date is not null")
    return x.select("id", clock.nearest_year(F.month("event_date"), F.dayofmonth("event_date"), TODAY).alias("resolved"))


STORES = """s AS (SELECT o_orderkey AS id, min(CAST(l_shipdate AS DATE)) FILTER (l_linenumber % 2 = 1 AND l_shipdate >= DATE '1998-08-02') AS soonest, max(CAST(l_shipdate AS DATE)) FILTER (l_linenumber % 2 = 1) AS latest,
  count(*) FILTER (NOT (l_linenumber % 2 = 1 AND l_shipdate < DATE '1998-08-02')) AS n_open, count(*) FILTER (l_linenumber % 2 = 1 AND l_shipdate < DATE '1998-08-02') AS n_closed FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"""


@query("store_deadlines", f"WITH {STORES} SELECT * FROM s")
def _(spark, sf):
    entry = F.struct(F.concat(F.lit("shop"), F.col("l_suppkey").cast("string")).alias("name"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"), F.when(F.col("l_linenumber") % 2 == 1, stores.DEADLINE).otherwise(stores.OPENING).alias("kind"))
    # an order has few lines: the array is an item's own stores column
    x = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.collect_list(entry)).alias("json")).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id")
    s = x.select("id", stores.parse_stores(F.col("json")).alias("s"))
    n = lambda c: F.size(c).cast("long")
    return s.select("id", stores.soonest_open(F.col("s"), TODAY).alias("soonest"), stores.last_deadline(F.col("s")).alias("latest"), n(stores.open_stores(F.col("s"), TODAY)).alias("n_open"), n(stores.closed_stores(F.col("s"), TODAY)).alias("n_closed"))


# --- text, matching ----------------------------------------------------------------------------------------------------


@query("df_tokens", "WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS token FROM documents) SELECT token, count(*) AS df FROM w WHERE length(token) >= 4 GROUP BY token HAVING count(*) <= (SELECT count(*) FROM documents) * 0.5")
def _(spark, sf):
    x = table(spark, sf, "documents")
    pairs = x.select("doc_id", F.explode(text.distinct_tokens(F.col("text"), 4)).alias("token"))
    total = x.agg(F.count("*").alias("total"))
    return pairs.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).where(F.col("df") <= F.col("total") * 0.5).select("token", "df")  # one row


BIGRAMS = "list_distinct(list_transform(generate_series(1, length({0}) - 1), lambda i: substr({0}, CAST(i AS INTEGER), 2)))"


@query("bigram_overlap", "WITH n AS (SELECT DISTINCT replace(p_name, ' ', '') AS a FROM part), p AS (SELECT x.a, y.a AS b FROM n x JOIN n y ON x.a < y.a) SELECT * FROM (SELECT a, b, round(len(list_intersect(" + BIGRAMS.format("a") + ", " + BIGRAMS.format("b") + ")) / least(len(" + BIGRAMS.format("a") + "), len(" + BIGRAMS.format("b") + ")), 9) AS overlap FROM p) WHERE overlap >= 0.3")
def _(spark, sf):
    n = table(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("id")).distinct()
    sets = n.select("id", F.array_distinct(text.bigrams(F.col("id"))).alias("grams"))
    return matching.containing_sets(sets, 0.3).select("a", "b", F.round("overlap", 9).alias("overlap"))


FUZZY = """WITH c AS (SELECT min(p_partkey) AS id, p_name || ' ' || replace(p_brand, '#', '') AS title, p_brand AS code FROM part GROUP BY ALL),
  q AS (SELECT p_partkey AS id, p_type || ' ' || p_name || ' ' || replace(p_brand, '#', '') AS title, p_brand AS code FROM part),
  f AS (SELECT q.id AS query_id, c.id AS item_id, lower(replace(q.title, ' ', '')) AS a, lower(replace(c.title, ' ', '')) AS b FROM q JOIN c ON q.code = c.code),
  g AS (SELECT *, list_transform(range(1, length(a)), lambda i: substr(a, i, 2)) AS x, list_transform(range(1, length(b)), lambda i: substr(b, i, 2)) AS y FROM f),
  s AS (SELECT query_id, item_id, greatest(0.85, 2.0 * list_sum(list_transform(list_distinct(x), lambda v: least(len(list_filter(x, lambda w: w = v)), len(list_filter(y, lambda w: w = v))))) / (len(x) + len(y))) AS score FROM g)
  SELECT query_id, item_id, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) = 1"""


@query("fuzzy_match", FUZZY)
def _(spark, sf):
    """Brands are codes here (RAND13 of Brand#13): other ones hold a likeness at 0.35, under the threshold."""
    p = table(spark, sf, "part")
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    c = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("k"))
    catalog = matching.titled(c, F.col("k"), F.concat_ws(" ", "p_name", brand))
    asked = F.concat_ws(" ", "p_type", "p_name", brand)
    return matching.best_of_rows(p, F.col("p_partkey"), asked, catalog, threshold=0.4).withColumn("score", F.round("score", 9))


@query(
    "name_hits",
    """WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM benchmark), n AS (SELECT name FROM w WHERE length(name) >= 9)
  SELECT doc_id, n FROM (SELECT doc_id, count(name) AS n FROM documents LEFT JOIN n ON contains(text, name) GROUP BY doc_id)""",
)
def _(spark, sf):
    """How many of the benchmark's long words a document holds, anywhere: thousands of names in one pass over each text."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where(F.length("w") >= 9).distinct().orderBy("w").limit(names.MOST + 1).collect()  # one more is an error
    table_ = names.table_of(r.w for r in words)
    return table(spark, sf, "documents").select("doc_id", F.size(names.found(F.col("text"), table_)).cast("long").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))


@query("dictionary_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'pokemon') OR contains(lower(text), 'thand') OR contains(lower(text), 'ereas')")
def _(spark, sf):
    synonyms = (("pokemon", ("thand", "ereas")),)
    return table(spark, sf, "documents").where(text.matches_query(F.lower("text"), "Pokemon", synonyms)).select("doc_id")


@query("watchlist_hits", "SELECT w.word, count(doc_id) AS n FROM (SELECT unnest(['Released', 'ereas', 'zzz', 'thand']) AS word) w LEFT JOIN documents ON contains(text, w.word) GROUP BY w.word")
def _(spark, sf):
    return analytics.hit_counts(table(spark, sf, "documents"), F.col("text"), ["Released", "ereas", "zzz", "thand"])


@query("median_title_length", "SELECT source, list_sort(list(n_chars))[CAST(count(*) // 2 AS INTEGER) + 1] AS median FROM documents GROUP BY source")
def _(spark, sf):
    return analytics.upper_median(table(spark, sf, "documents"), F.col("n_chars"), "source")


@query("html_extract", r"SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) AS INTEGER) AS links FROM pages")
def _(spark, sf):
    return landed.extracted(table(spark, sf, "pages")).select("page_id", "title", "links")


@query("html_text")
def _(spark, sf):
    return landed.extracted(table(spark, sf, "pages")).select("page_id", "description", "body")


@query("genre_classify")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.classify_genre(F.col("text")).alias("genre"))


@query("conversation_turns", "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations")
def _(spark, sf):
    w = Window.partitionBy("conv_id")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w.orderBy("turn")).alias("before"), F.count("*").over(w).alias("turns"))


@query("stride_sample", "WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, greatest(1, count(*) OVER (PARTITION BY source) // 5) AS step FROM documents) SELECT source, doc_id FROM n WHERE (rn - 1) % step = 0 AND (rn - 1) // step < 5")
def _(spark, sf):
    return analytics.stride_sample(table(spark, sf, "documents"), "source", "doc_id", 5).select("source", "doc_id")


@query("feed_newest", f"{ITEMS} SELECT id, '<item><title>' || title || '</title><link>https://catalog.example/item/' || CAST(id AS VARCHAR) || '</link><guid>https://catalog.example/item/' || CAST(id AS VARCHAR) || '</guid></item>' AS xml FROM items ORDER BY id DESC LIMIT 50")
def _(spark, sf):
    return sinks.feed_items(items(spark, sf), "https://catalog.example")


@query("text_dump", f"{ITEMS} SELECT source, id, CAST(id AS VARCHAR) || ' | ' || source || ' | ' || title || ' | ' || coalesce(CAST(event_date AS VARCHAR), '-') AS line FROM items")
def _(spark, sf):
    return sinks.dump_lines(items(spark, sf))


@query("post_facts", f"{ITEMS} SELECT count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (event_date BETWEEN DATE '1998-08-02' AND DATE '1998-08-09') AS within7, count(*) FILTER (event_type = 'lottery') AS lottery, count(DISTINCT genre) AS genres FROM items WHERE {SHOWN}")
def _(spark, sf):
    x = views.filtered(items(spark, sf), TODAY)
    return x.agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.count_if(clock.days_until(F.col("event_date"), TODAY).between(0, 7)).alias("within7"), F.count_if(F.col("event_type") == "lottery").alias("lottery"), F.countDistinct("genre").alias("genres"))


@query("shared_attributes", f"{ITEMS} SELECT cust, CASE WHEN count(DISTINCT event_type) = 1 AND count(event_type) = count(*) THEN min(event_type) END AS type, CASE WHEN count(DISTINCT event_date) = 1 AND count(event_date) = count(*) THEN min(event_date) END AS date FROM items GROUP BY cust")
def _(spark, sf):
    one = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c))
    return items(spark, sf).groupBy("cust").agg(one("event_type").alias("type"), one("event_date").alias("date"))


@query("overlapping_predicates", "SELECT k AS title, count(*) AS n FROM (SELECT unnest([CASE WHEN contains(p_name, 'a') THEN 'a' END, CASE WHEN contains(p_type, 'STEEL') THEN 'steel' END, CASE WHEN p_size > 25 THEN 'large' END]) AS k FROM part) WHERE k IS NOT NULL GROUP BY k")
def _(spark, sf):
    tests = {"a": F.col("p_name").contains("a"), "steel": F.col("p_type").contains("STEEL"), "large": F.col("p_size") > 25}
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    return table(spark, sf, "part").select(F.explode(found).alias("title")).groupBy("title").agg(F.count("*").alias("n"))


@query("zero_contribution", f"{ITEMS} SELECT d.source, count(*) AS db, count(*) FILTER (scope = 'jp' AND id % 500 = 1) AS shown, max(event_date) AS newest FROM items d GROUP BY d.source")
def _(spark, sf):
    x = items(spark, sf)
    shown = x.where((F.col("scope") == "jp") & (F.col("id") % 500 == 1)).groupBy("source").agg(F.count("*").alias("shown"))
    return x.groupBy("source").agg(F.count("*").alias("db"), F.max("event_date").alias("newest")).join(shown, "source", "left").na.fill(0, ["shown"])


@query("offset_histogram", f"{ITEMS} SELECT date_diff('day', event_date, CAST(o_orderdate AS DATE) + CAST(id % 3 AS INTEGER) - 1) AS off, count(*) AS n FROM items JOIN orders ON id = o_orderkey WHERE event_date IS NOT NULL GROUP BY 1")
def _(spark, sf):
    x = items(spark, sf).where("event_date is not null").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), "id")
    off = F.datediff(F.date_add(F.to_date("o_orderdate"), (F.col("id") % 3 - 1).cast("int")), F.col("event_date")).cast("long")
    return x.groupBy(off.alias("off")).agg(F.count("*").alias("n"))


@query("fill_rates", f"{ITEMS} SELECT genre, round(avg(CASE WHEN event_date IS NOT NULL THEN 1.0 ELSE 0 END), 9) AS dated, round(avg(CASE WHEN scope IS NOT NULL THEN 1.0 ELSE 0 END), 9) AS scoped FROM items GROUP BY genre")
def _(spark, sf):
    rate = lambda c: F.round(F.avg(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)), 9)
    return items(spark, sf).groupBy("genre").agg(rate("event_date").alias("dated"), rate("scope").alias("scoped"))


# --- quality -----------------------------------------------------------------------------------------------------------


@query("quality_dup_exact", "SELECT 'dup_exact' AS key, CAST(min(doc_id) AS VARCHAR) AS id, CAST(count(*) AS VARCHAR) AS detail FROM documents GROUP BY source, text HAVING count(*) > 1")
def _(spark, sf):
    x = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.sha2("text", 256).alias("h"))
    return quality.repeated(x, "dup_exact", ["source", "h"])


@query("quality_dup_cross", "SELECT 'dup_cross' AS key, CAST(min(doc_id) AS VARCHAR) AS id, CAST(count(*) AS VARCHAR) AS detail FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def _(spark, sf):
    x = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.sha2("text", 256).alias("h"))
    return quality.repeated(x, "dup_cross", ["h"], sources=2)


@query(
    "quality_text",
    r"""WITH f AS (SELECT doc_id, text, unnest(['text_spacing', 'unbalanced_bracket', 'title_pipe_residue']) AS key FROM documents)
  SELECT key, CAST(doc_id AS VARCHAR) AS id, '' AS detail FROM f WHERE (key = 'text_spacing' AND regexp_matches(text, '^[\s　]|[\s　]$|　{3}')) OR (key = 'title_pipe_residue' AND contains(text, '|'))
  OR (key = 'unbalanced_bracket' AND length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', '')))""",
)
def _(spark, sf):
    return quality.text_checks(table(spark, sf, "documents"), "text", "doc_id")


@query("quality_vocabulary", "SELECT 'genre_vocab' AS key, CAST(doc_id AS VARCHAR) AS id, lang AS detail FROM documents WHERE lang NOT IN ('en', 'de', 'fr')")
def _(spark, sf):
    return quality.outside(table(spark, sf, "documents"), "genre_vocab", "lang", ["en", "de", "fr"], "doc_id")


@query("quality_genre_split", f"{TITLES} SELECT 'genre_split' AS key, CAST(min(id) AS VARCHAR) AS id, CAST(count(DISTINCT source) AS VARCHAR) AS detail FROM t WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT source) > 1")
def _(spark, sf):
    return quality.split_groups(titles(spark, sf), "genre_split", F.when(F.length("k") >= 10, F.md5("k")), "source")


@query("quality_date_sanity", f"{ITEMS} SELECT 'date_sanity' AS key, CAST(id AS VARCHAR) AS id, CAST(event_date AS VARCHAR) AS detail FROM items WHERE event_date < DATE '1995-02-01' OR event_date > DATE '2000-08-02'")
def _(spark, sf):
    d = F.col("event_date")
    bad = F.coalesce((d < "1995-02-01") | (d > F.add_months(clock.day(TODAY), 24)), F.lit(False))
    return quality.finding(items(spark, sf), "date_sanity", bad, detail=d)


@query(
    "quality_ratchet",
    """WITH f AS (SELECT 'dup' AS key FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) UNION ALL SELECT 'pipe' FROM documents WHERE contains(text, '|')), n AS (SELECT key, count(*) AS n FROM f GROUP BY key),
  b AS (SELECT * FROM (VALUES ('dup', 3, 'warn', TRUE), ('pipe', 1000000, 'warn', TRUE), ('gone', 5, 'error', TRUE)) v(key, baseline, level, ratchet))
  SELECT coalesce(n.key, b.key) AS key, coalesce(n, 0) AS n, CAST(coalesce(baseline, 0) AS BIGINT) AS baseline, CASE WHEN coalesce(n, 0) > coalesce(baseline, 0) THEN 'error' WHEN coalesce(n, 0) > 0 THEN coalesce(level, 'warn') ELSE 'ok' END AS level FROM n FULL JOIN b ON n.key = b.key""",
)
def _(spark, sf):
    x = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text", F.sha2("text", 256).alias("h"))
    found = quality.repeated(x, "dup", ["h"]).unionByName(quality.finding(x, "pipe", F.col("text").contains("|")))
    base = spark.createDataFrame([("dup", 3, "warn", True), ("pipe", 1000000, "warn", True), ("gone", 5, "error", True)], "key string, baseline long, level string, ratchet boolean")
    return quality.report(found, base)


@query("quality_coverage", f"{ITEMS}, e AS (SELECT source AS key, count(*) FILTER (id % 3 = 0 AND source <> 'src5') AS e, count(*) AS w FROM items GROUP BY source) SELECT key, CASE WHEN e = 0 THEN 'check_coverage_lost' ELSE 'check_coverage_shrunk' END AS problem FROM e WHERE e = 0 OR (w >= 20 AND e < w * 0.5)")
def _(spark, sf):
    x = items(spark, sf).withColumnRenamed("source", "key")
    return quality.coverage(x.where((F.col("id") % 3 == 0) & (F.col("key") != "src5")).groupBy("key").agg(F.count("*").alias("examined")), x.groupBy("key").agg(F.count("*").alias("examined")))


@query("sitemap_drift", f"{ITEMS} SELECT id, event_date FROM items WHERE id % 2 = 0 AND NOT (scope IS DISTINCT FROM 'en' AND id % 3 = 0) AND (event_date IS NULL OR event_date >= DATE '1998-08-02')")
def _(spark, sf):
    x = items(spark, sf)
    shown = x.where(predicates.in_scope(F.col("scope")) & (F.col("id") % 3 == 0)).select("id")
    listed = x.where(F.col("id") % 2 == 0)
    return listed.join(shown, "id", "left_anti").where(predicates.upcoming(F.col("event_date"), TODAY)).select("id", "event_date")


@query("resolve_catalog")
def _(spark, sf):
    """The whole resolution over documents as items."""
    from ..schema import ITEM, conform

    d = table(spark, sf, "documents")
    x = d.select(F.col("doc_id").alias("id"), "source", F.col("text").alias("title"), F.col("lang").alias("genre"), F.lit("発売").alias("event_type"), F.when(F.col("doc_id") % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int"))).alias("event_date"), F.concat(F.lit("https://"), "source", F.lit(".example/goods/"), (F.col("doc_id") % 900).cast("string")).alias("url"))
    return r.resolve(conform(x, ITEM), LOG_TODAY).select("id", "source", "event_date")
