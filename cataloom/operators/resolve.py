"""Entity resolution: rows that are one thing collapse into one, which takes over what the others know.

Every step is a grouped aggregate on a derived key and a join back, so that a hot key is summed up in the tasks first; no
group is gathered. `pos` is a row's place in the order of input and decides whatever order decides.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import clock, predicates, stores, text, urls
from ..functions.price import parse_yen
from ..sources.shared import cut, release

MARKET = ("market_price", "market_price_text", "market_url", "market_source")


def blank(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def worth(url: Column, event_date: Column, price: Column, image: Column) -> Column:
    """How good a row is as the one that stays: a page of its own, a day, a price, an image."""
    has = lambda c, n: F.when(c, n).otherwise(0)
    return has(blank(url).isNotNull() & ~url.contains("#"), 8) + has(event_date.isNotNull(), 4) + has(blank(price).isNotNull(), 2) + has(blank(image).isNotNull(), 1)


def with_order(items: DataFrame) -> DataFrame:
    """`pos` by day (none last), then the newest first; and each row's worth.

    `pos` is a text that sorts, not a row number: numbering all rows would take one task.
    """
    key = F.concat(F.coalesce(F.date_format("event_date", "yyyyMMdd"), F.lit("99999999")), F.lpad((F.lit(10**18) - F.col("id")).cast("string"), 19, "0"))
    return items.withColumn("pos", key).withColumn("worth", worth(F.col("url"), F.col("event_date"), F.col("price"), F.col("image_url")))


def targets(items: DataFrame, key: Column, order: list[Column], sources: int = 1) -> DataFrame:
    """(id, into): rows with the same key go into the one first in `order`; groups need two rows and so many sources."""
    rows = items.select("id", "source", key.alias("k"), F.struct(*order, F.col("id").alias("first_id")).alias("o")).where(F.col("k").isNotNull())
    best = rows.groupBy("k").agg(F.min("o").alias("best"), F.count("*").alias("n"), F.min("source").alias("s1"), F.max("source").alias("s2"))
    best = best.where((F.col("n") > 1) & ((F.lit(sources) < 2) | (F.col("s1") != F.col("s2"))))
    return rows.join(best, "k").select("id", F.col("best.first_id").alias("into")).where("id <> into")


def fold(items: DataFrame, into: DataFrame) -> DataFrame:
    """`items` without the rows of `into`; what stays takes over market facts, lottery and highlights it lacks, in order of pos.

    The market facts go as one: from the first row with a price, where none is there; a text alone only where no price is.
    The result's lineage is cut: a fold reads its input several times, and a chain of them would grow as a power.
    """
    into = cut(into, "fold-into")
    lost = items.join(into, "id").select("into", "pos", *MARKET, "has_lottery", "highlights")
    priced, texted = F.col("market_price").isNotNull(), F.col("market_price").isNull() & blank(F.col("market_price_text")).isNotNull()
    facts = F.struct("pos", *MARKET)
    got = lost.groupBy(F.col("into").alias("id")).agg(
        F.min(F.when(priced, facts)).alias("p"),
        F.min(F.when(texted, facts)).alias("t"),
        F.min(F.when(blank(F.col("highlights")).isNotNull(), F.struct("pos", "highlights"))).alias("h"),
        F.max(F.when(F.col("has_lottery") & blank(F.col("highlights")).isNotNull(), True)).alias("l"),
    )
    kept = items.join(into.select("id"), "id", "left_anti").join(got, "id", "left")
    take = F.col("market_price").isNull() & F.col("p").isNotNull()
    early = blank(F.col("market_price_text")).isNull() & F.col("t").isNotNull() & (~take | (F.col("t.pos") < F.col("p.pos")))
    text_ = F.when(early, F.col("t.market_price_text")).otherwise(F.col("market_price_text"))
    url_ = F.when(early, F.coalesce("market_url", "t.market_url")).otherwise(F.col("market_url"))
    source_ = F.when(early, F.coalesce("market_source", "t.market_source")).otherwise(F.col("market_source"))
    new = {
        "market_price": F.when(take, F.col("p.market_price")).otherwise(F.col("market_price")),
        "market_price_text": F.when(take, F.coalesce(F.col("p.market_price_text"), text_)).otherwise(text_),
        "market_url": F.when(take, F.coalesce(F.col("p.market_url"), url_)).otherwise(url_),
        "market_source": F.when(take, F.coalesce(F.col("p.market_source"), source_)).otherwise(source_),
        "has_lottery": F.when(~F.coalesce("has_lottery", F.lit(False)) & F.coalesce("l", F.lit(False)), True).otherwise(F.col("has_lottery")),
        "highlights": F.coalesce(blank(F.col("highlights")), F.col("h.highlights"), F.col("highlights")),
    }
    out = cut(kept.select(*[new.get(c, F.col(c)).alias(c) for c in items.columns]), "fold")
    release(into)
    return out


def collapse(items: DataFrame, key: Column, order: list[Column], sources: int = 1) -> DataFrame:
    return fold(items, targets(items, key, order, sources))


def then(items: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Steps one after another that each end in a fold; the table that a step has read is deleted."""
    for step in steps:
        before, items = items, step(items)
        release(before)
    return items


def best_first() -> list[Column]:
    return [-F.col("worth")]


def live_deadlines(items: DataFrame, today: str) -> DataFrame:
    """An item with stores moves to their soonest open deadline, and lists the open ones."""
    s = stores.parse_stores(F.col("stores"))
    x = items.withColumn("_stores", s)
    x = x.withColumn("event_date", F.coalesce(stores.soonest_open(F.col("_stores"), today), F.col("event_date")))
    x = x.withColumn("highlights", F.when(F.col("_stores").isNull(), F.col("highlights")).otherwise(stores.live_summary(F.col("highlights"), F.col("_stores"), today)))
    return x.drop("_stores")


def identical_titles(items: DataFrame) -> DataFrame:
    """Within a source and title: equal days collapse; rows without a day of their own join the first dated row, else the month's."""
    month = clock.is_month_precision(F.col("event_date_text"))
    exact = F.col("event_date").isNotNull() & ~month
    named = F.col("title").isNotNull()
    mark = F.when(named, F.struct("source", "title"))
    same = F.when(named, F.struct("source", "title", exact.alias("exact"), "event_date"))
    x = collapse(items, same, best_first())
    rank = F.when(exact, 0).when(F.col("event_date").isNotNull(), 1).otherwise(2)
    firsts = x.select(mark.alias("k"), rank.alias("rank"), "pos", "id").groupBy("k").agg(F.min(F.struct("rank", "pos", "id")).alias("first"))
    pairs = x.select("id", mark.alias("k"), rank.alias("rank")).join(firsts, "k")
    goes = ((F.col("first.rank") == 0) & (F.col("rank") > 0)) | ((F.col("first.rank") == 1) & (F.col("rank") == 2))
    return then(x, lambda x: fold(x, pairs.where(goes).select("id", F.col("first.id").alias("into"))))


def same_product_page(items: DataFrame) -> DataFrame:
    """Rows of several sources that point to one product page on one day. A row's two addresses count one after the other."""
    page = lambda column: urls.product_key(F.col(column))
    key = lambda p: F.when(F.col("event_date").isNotNull() & p.isNotNull(), F.struct(p.alias("page"), "event_date"))
    return then(collapse(items, key(page("url")), best_first(), sources=2), lambda x: collapse(x, key(page("official_url")), best_first(), sources=2))


def across_sources(items: DataFrame, key: Column, least: int = 6) -> DataFrame:
    return collapse(items, F.when(F.length(key) >= least, key), best_first(), sources=2)


#: The columns of a page's rows of one day, within a source and with equal stores.
PAGE = ("source", "url", "stores", "event_date")
#: Names of up to HEAD characters are told apart as they stand, longer ones by their SHA-256 (as in `brief`).
HEAD = 64
#: A page of more bytes, or rows, is dealt over several tasks, SHARES at most: all of them get the page's short records.
PAGE_BYTES, PAGE_ROWS, SHARES = 64 << 20, 20_000, 64
#: Hashes are sums of characters times powers of an odd number, modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of BASE, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 14), x, np.uint64)])) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers


def sums(name: str) -> np.ndarray:
    """At i the sum over the first i characters: a run's hash is the difference at its ends times the inverse power of its start."""
    codes = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers(len(codes))[0][: len(codes)], dtype=np.uint64)])


@F.arrow_udf(StructType([StructField("head", LongType()), StructField("whole", LongType())]))
def _marks(names: pa.Array) -> pa.Array:
    """Of names longer than HEAD, the hashes of the first HEAD characters and of all."""
    out = []
    for x in names.to_pylist():
        at = sums(x) if x is not None and len(x) > HEAD else None
        out.append(None if at is None else dict(zip(("head", "whole"), at[[HEAD, -1]].view(np.int64).tolist(), strict=True)))
    return pa.array(out, pa.struct([("head", pa.int64()), ("whole", pa.int64())]))


class _Page:
    """One page's names that are looked for, until a name is found that contains them: names come longest first."""

    def __init__(self) -> None:
        self.sizes: dict[int, int] = {}
        self.short: dict[str, list[int]] = {}
        self.long: dict[int, dict[int, dict[int, list[tuple[str, int]]]]] = {}
        self.table: np.ndarray | None = None

    def add(self, id_: int, size: int, name: str, head: int | None, whole: int | None) -> None:
        self.sizes[id_] = size
        if size <= HEAD:
            self.short.setdefault(name, []).append(id_)
        else:
            self.long.setdefault(head, {}).setdefault(size, {}).setdefault(whole, []).append((name, id_))

    def inside(self, name: str) -> Iterator[int]:
        """Ids of names that this one contains, each once and no longer looked for."""
        names, size = self.short, len(name)
        lengths = {len(x) for x in names}
        # each name in turn, or all pieces of their lengths, whichever is less to do
        if len(names) * (300 + size) <= 300 * size * len(lengths):
            hits = [x for x in names if len(x) < size and x in name]
        else:
            hits = [x for n in lengths if n < size for x in {name[i : i + n] for i in range(size - n + 1)} if x in names]
        for x in hits:
            yield from names.pop(x)
        if self.long and size > HEAD:
            yield from self._long_inside(name, size)

    def _long_inside(self, name: str, size: int) -> Iterator[int]:
        if self.table is None:  # which 16-bit values the hashes of beginnings have
            self.table = np.zeros(1 << 16, bool)
            self.table[self._slots(np.array(list(self.long), np.int64).view(np.uint64))] = True
        at, back = sums(name), powers(size)[1]
        run = lambda start, n: (at[start + n] - at[start]) * back[start]
        heads = (at[HEAD:] - at[:-HEAD]) * back[: size - HEAD + 1]
        places = np.flatnonzero(self.table[self._slots(heads)])
        found = heads[places].view(np.int64)
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        values, first = np.unique(found, return_index=True)
        for head, starts in zip(values.tolist(), np.split(places, first[1:]), strict=True):
            for n, known in list(self.long.get(head, {}).items()):
                starts_n = starts[starts + n <= size] if n < size else starts[:0]
                wholes = run(starts_n, n).view(np.int64)
                for whole in set(wholes.tolist()) & known.keys():
                    texts = {base64.b64encode(hashlib.sha256(name[p : p + n].encode("utf-8", "surrogatepass")).digest()).decode() for p in starts_n[wholes == whole][:1].tolist()}
                    hit = [id_ for sha, id_ in known[whole] if sha in texts]
                    known[whole] = [(sha, id_) for sha, id_ in known[whole] if sha not in texts]
                    if not known[whole]:
                        del known[whole]
                    yield from hit
                if not known:
                    del self.long[head][n]
            if head in self.long and not self.long[head]:
                del self.long[head]

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)


def _into_longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages whose records come first (kind 0), then the names, longest first: which name each goes into."""
    at, page = None, _Page()
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            out: list[tuple[int, int, int]] = []
            for r in batch.slice(low, 512).to_pylist():
                if at != (r["page"], r["share"]):
                    at, page = (r["page"], r["share"]), _Page()
                if r["kind"] == 0:
                    page.add(r["id"], r["size"], r["name"], r["head"], r["whole"])
                elif page.sizes.get(r["id"]) == r["size"]:  # else a row that is no longer there
                    out += [(id_, r["id"], r["size"]) for id_ in page.inside(r["name"])]
            ids, into, sizes = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, into, sizes)], ["id", "into", "size"])


def contained_names(items: DataFrame, key: Column, names: DataFrame | None = None) -> DataFrame:
    """Within a source, page, stores and day the name that another of at least 8 characters contains goes into the longest such.

    Only rows with a page: a group is one page's rows of one day. Names are dealt out once, by page, and none is repeated or
    written for its pieces: short records of all rows (`brief` names and hashes) come first, and are looked up in one name
    after another. `names`: (id, name), and PAGE if it has that at hand, where `key` only tells names apart.
    """
    paged = lambda x: x.where(blank(F.col("url")).isNotNull()).withColumn("page", brief(F.to_json(F.struct(*PAGE))))
    names = items.select("id", *PAGE, key.alias("name")) if names is None else names
    if not set(PAGE) <= set(names.columns):
        names = names.join(items.select("id", *PAGE), "id")
    names = paged(names).select("page", "id", F.length("name").alias("size"), "name").where("size > 0")
    marks = names.select("id", "size", brief(F.col("name")).alias("name"), _marks("name").alias("m")).select("id", "size", "name", "m.*")
    x = cut(paged(items).select("id", "page").join(marks, "id"), "contained-marks")
    shares = F.least(F.lit(SHARES), F.greatest(F.ceil(F.sum("size") / PAGE_BYTES), F.ceil(F.count("*") / PAGE_ROWS)))
    pages = x.groupBy("page").agg(F.min("size").alias("least"), F.max("size").alias("most"), shares.cast("int").alias("shares")).where("least < most and most >= 8").select("page", "shares")
    records = x.join(pages, "page").select("page", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), "id", "size", "name", "head", "whole")
    large = F.broadcast(pages.where("shares > 1"))  # few: a page in PAGE_BYTES or PAGE_ROWS of the input at most
    share = F.coalesce(F.pmod(F.hash("id"), F.col("shares")), F.lit(0))
    whole = names.where("size >= 8").join(large, "page", "left").select("page", share.alias("share"), F.lit(1).alias("kind"), "id", "size", "name", *[F.lit(None).cast("bigint").alias(c) for c in ("head", "whole")])
    met = records.unionByName(whole).repartition("page", "share").sortWithinPartitions("page", "share", "kind", F.desc("size"), "id")
    found = met.mapInArrow(_into_longest, "id long, into long, size long")
    longest = found.groupBy("id").agg(F.min(F.struct(-F.col("size"), F.col("into").alias("id"))).alias("o"))
    out = fold(items, longest.select("id", F.col("o")["id"].alias("into")))
    release(x)
    return out


def already_listed(items: DataFrame, weaker: str, stronger: str) -> DataFrame:
    """Rows of the weaker source go where the stronger has the same day and price."""
    yen = parse_yen(F.col("price"))
    strong = items.where((F.col("source") == stronger) & F.col("event_date").isNotNull() & yen.isNotNull()).select(F.col("event_date").alias("d"), yen.alias("y")).distinct()
    weak = items.where((F.col("source") == weaker) & F.col("event_date").isNotNull())
    gone = weak.join(strong, (F.col("event_date") == F.col("d")) & (yen == F.col("y")), "left_semi").select("id")
    return items.join(gone, "id", "left_anti")


def sale_units(items: DataFrame, unit: Column | None = None, base: Column | None = None) -> DataFrame:
    """Boxes and cartons of one product: if all units differ, the plain row stays, else a dated one. Unit and base are the title's."""
    unit, base = text.sale_unit(F.col("title")) if unit is None else unit, text.unit_base(F.col("title")) if base is None else base
    x = items.select("id", "source", "worth", "event_date", unit.alias("unit"), F.when(F.length(base) >= 8, F.struct("source", base.alias("base"))).alias("b"), F.coalesce(F.col("event_date").cast("string"), F.col("event_date_text")).alias("d")).where("b is not null")
    days = x.groupBy("b").agg(F.min("d").alias("d1"), F.max("d").alias("d2"))
    x = x.join(days, "b").withColumn("many", F.coalesce(F.col("d1") != F.col("d2"), F.lit(False))).where(~F.col("many") | F.col("d").isNotNull())
    x = x.withColumn("g", F.struct("b", F.when(F.col("many"), F.col("d")).alias("day")))
    group = x.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("unit", F.lit(""))).alias("labels"), F.count("unit").alias("labelled"), F.min(F.struct(F.col("unit").isNotNull().alias("u"), F.col("event_date").isNull().alias("e"), -F.col("worth"), F.col("id").alias("first_id"))).alias("best"))
    fine = group.where((F.col("n") > 1) & (F.col("labelled") > 0) & (F.col("labels") == F.col("n")))
    return fold(items, x.join(fine, "g").select("id", F.col("best.first_id").alias("into")).where("id <> into"))


def same_name_with_stores(items: DataFrame, key: Column, today: str) -> DataFrame:
    """Of rows with stores and one name in a source the one whose stores move soonest stays."""
    near = F.coalesce(stores.nearest_move(stores.parse_stores(F.col("stores")), today), F.lit(1 << 30))
    k = F.when(F.col("stores").isNotNull() & (F.length(key) >= 8), F.struct("source", key.alias("name")))
    return collapse(items, k, [near, -F.col("worth")])


def brief(text_: Column) -> Column:
    """A text to tell apart from others, and to ask for a length of up to HEAD characters, or 44: longer ones are their hash."""
    return F.when(F.length(text_) > HEAD, F.base64(F.unhex(F.sha2(text_, 256)))).otherwise(text_)


def resolve(items: DataFrame, today: str, weaker: str = "snkrdunk", stronger: str = "nike_snkrs") -> DataFrame:
    """All steps, in their order; `items` has the columns of schema.ITEM. Names are keyed once, for all steps.

    Titles may be long: steps carry what tells them apart, and those that are left are joined to their titles at the end.
    """
    keyed = cut(with_order(live_deadlines(items, today)).withColumn("_row", F.monotonically_increasing_id()), "resolve-keyed")
    key, source, title, name = F.col("name_key"), F.col("source"), F.col("title"), F.col("name")
    letters = F.when(F.length(name) >= 10, text.anagram_key(name))
    said = {"title": title, "name_key": name, "_letters": letters, "_unit": text.sale_unit(title), "_base": text.unit_base(title)}
    named = keyed.withColumn("name", text.name_key(title))
    named = cut(named.withColumns({c: brief(t) for c, t in said.items()}), "contained-names")
    x = cut(named.drop("name"), "resolve-brief")
    x = then(
        x,
        identical_titles,
        lambda x: same_product_page(x.drop("title")),
        lambda x: across_sources(x, key),
        lambda x: across_sources(x, F.col("_letters"), 10),
        lambda x: collapse(x.drop("_letters"), F.when(F.length(key) >= 8, F.struct("source", key.alias("name"), "event_date")), best_first()),
        lambda x: contained_names(x, key, named.select("id", *PAGE, "name")),
        lambda x: sale_units(already_listed(x, weaker, stronger), F.col("_unit"), F.col("_base")),
        lambda x: same_name_with_stores(x.drop("_unit", "_base"), key, today),
    )
    release(named)
    planned = clock.planned_date(F.col("event_date_text"))
    x = x.where(~clock.is_stale_plan(F.col("event_date"), F.col("event_date_text"), today) & ~predicates.is_mirror_without_day(source, F.col("event_date"), planned))
    titles = keyed.select("_row", "title")
    return x.join(titles.hint("merge"), "_row").select(*items.columns)
