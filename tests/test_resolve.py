"""The whole resolution beside a plain version that goes through a small catalog step by step, with dictionaries and loops."""

from __future__ import annotations

import datetime
import json
import random
import re

import pytest

from cataloom.operators import resolve
from cataloom.schema import ITEM, conform

TODAY = datetime.date(2026, 8, 16)
FIELDS = ("id", "source", "title", "event_date", "event_date_text", "url", "official_url", "stores", "price", "image_url", "market_price", "market_price_text", "market_url", "market_source", "has_lottery", "highlights")
SCHEMA = "id long, source string, title string, event_date date, event_date_text string, url string, official_url string, stores string, price string, image_url string, market_price long, market_price_text string, market_url string, market_source string, has_lottery boolean, highlights string"
SHOWN = ("id", "event_date", "market_price", "market_price_text", "market_url", "has_lottery", "highlights")


def days_of(row):
    return [(datetime.date.fromisoformat(s["at"]), s["kind"]) for s in json.loads(row["stores"] or "[]")]


def key_of(title):
    return re.sub("[^a-z0-9]", "", (title or "").lower())


def unit_of(title):
    found = re.search(r"【([^】]*BOX[^】]*)】", title or "")
    return found[1].strip() if found else None


def base_of(title):
    cut = re.sub(" +", " ", re.sub(r"【[^】]*BOX[^】]*】", " ", title or "")).strip()
    return key_of(cut if len(cut) >= 8 else title)


def page_of(url):
    parts = re.sub("^https://", "", url or "").split("/")
    return "/".join(parts).lower() if len(parts) == 3 and parts[1] in ("goods", "items") else None


def yen_of(price):
    found = [int(x) for x in re.findall(r"\d+", price or "")]
    return max(found, default=None)


class Plain:
    def __init__(self, rows):
        self.rows = [dict(r) for r in rows]
        for r in self.rows:
            soon = min((d for d, kind in days_of(r) if kind == "締切" and d >= TODAY), default=None)
            r["event_date"] = soon or r["event_date"]
            r["pos"] = (f"{r['event_date']:%Y%m%d}" if r["event_date"] else "99999999", 10**18 - r["id"])
            r["worth"] = 8 * bool(r["url"] and "#" not in r["url"]) + 4 * (r["event_date"] is not None) + 2 * bool(r["price"]) + bool(r["image_url"])

    def fold(self, into):
        for keeper in [r for r in self.rows if r["id"] not in into]:
            lost = sorted((r for r in self.rows if into.get(r["id"]) == keeper["id"]), key=lambda r: r["pos"])
            price = next((r for r in lost if r["market_price"] is not None), None) if keeper["market_price"] is None else None
            said = next((r for r in lost if r["market_price"] is None and r["market_price_text"]), None) if not keeper["market_price_text"] else None
            if said and (not price or said["pos"] < price["pos"]):
                keeper["market_price_text"] = said["market_price_text"]
                for f in ("market_url", "market_source"):
                    keeper[f] = keeper[f] if keeper[f] is not None else said[f]
            if price:
                for f in ("market_price_text", "market_url", "market_source"):
                    keeper[f] = price[f] if price[f] is not None else keeper[f]
                keeper["market_price"] = price["market_price"]
            if any(r["has_lottery"] and r["highlights"] for r in lost) and not keeper["has_lottery"]:
                keeper["has_lottery"] = True
            keeper["highlights"] = keeper["highlights"] or next((r["highlights"] for r in lost if r["highlights"]), keeper["highlights"])
        self.rows = [r for r in self.rows if r["id"] not in into]

    def collapse(self, key, order=lambda r: (-r["worth"],), sources=1):
        groups = {}
        for r in self.rows:
            if (k := key(r)) is not None:
                groups.setdefault(k, []).append(r)
        into = {}
        for g in groups.values():
            if len(g) > 1 and (sources < 2 or len({r["source"] for r in g}) > 1):
                best = min(g, key=lambda r: (*order(r), r["id"]))
                into |= {r["id"]: best["id"] for r in g if r is not best}
        self.fold(into)

    def identical_titles(self):
        exact = lambda r: r["event_date"] is not None and "月" not in (r["event_date_text"] or "")
        self.collapse(lambda r: (r["source"], r["title"], exact(r), r["event_date"]) if r["title"] is not None else None)
        rank = lambda r: 0 if exact(r) else 1 if r["event_date"] else 2
        into = {}
        for k in {(r["source"], r["title"]) for r in self.rows if r["title"] is not None}:
            g = [r for r in self.rows if (r["source"], r["title"]) == k]
            first = min(g, key=lambda r: (rank(r), r["pos"], r["id"]))
            into |= {r["id"]: first["id"] for r in g if (rank(first) == 0 and rank(r) > 0) or (rank(first) == 1 and rank(r) == 2)}
        self.fold(into)

    def contained_names(self):
        into = {}
        for b in self.rows:
            g = lambda r: (r["source"], r["url"], r["stores"], r["event_date"])
            inside = [a for a in self.rows if b["url"] and g(a) == g(b) and len(key_of(a["title"])) >= 8 and key_of(b["title"]) and key_of(a["title"]) != key_of(b["title"]) and key_of(b["title"]) in key_of(a["title"])]
            if inside:
                into[b["id"]] = min(inside, key=lambda a: (-len(key_of(a["title"])), a["id"]))["id"]
        self.fold(into)

    def sale_units(self):
        groups, into = {}, {}
        for r in self.rows:
            if len(base_of(r["title"])) >= 8:
                groups.setdefault((r["source"], base_of(r["title"])), []).append(r)
        for g in groups.values():
            day = lambda r: str(r["event_date"]) if r["event_date"] else r["event_date_text"]
            known = {day(r) for r in g if day(r) is not None}
            parts = [[r for r in g if day(r) == d] for d in known] if len(known) > 1 else [g]
            for part in parts:
                units = [unit_of(r["title"]) for r in part]
                if len(part) > 1 and any(units) and len({u or "" for u in units}) == len(part):
                    best = min(part, key=lambda r: (unit_of(r["title"]) is not None, r["event_date"] is None, -r["worth"], r["id"]))
                    into |= {r["id"]: best["id"] for r in part if r is not best}
        self.fold(into)

    def run(self):
        key = lambda r: key_of(r["title"])
        self.identical_titles()
        for column in ("url", "official_url"):
            self.collapse(lambda r: (page_of(r[column]), r["event_date"]) if r["event_date"] and page_of(r[column]) else None, sources=2)  # noqa: B023
        self.collapse(lambda r: key(r) if len(key(r)) >= 6 else None, sources=2)
        self.collapse(lambda r: "".join(sorted(key(r))) if len(key(r)) >= 10 else None, sources=2)
        self.collapse(lambda r: (r["source"], key(r), r["event_date"]) if len(key(r)) >= 8 else None)
        self.contained_names()
        strong = {(r["event_date"], yen_of(r["price"])) for r in self.rows if r["source"] == "nike_snkrs" and r["event_date"] and yen_of(r["price"])}
        self.rows = [r for r in self.rows if not (r["source"] == "snkrdunk" and r["event_date"] and (r["event_date"], yen_of(r["price"])) in strong)]
        self.sale_units()
        near = lambda r: min((abs((d - TODAY).days) for d, _ in days_of(r)), default=1 << 30)
        self.collapse(lambda r: (r["source"], key(r)) if r["stores"] is not None and len(key(r)) >= 8 else None, order=lambda r: (near(r), -r["worth"]))
        planned = lambda r: datetime.date(2026, 7, 31) if r["event_date_text"] == "2026年7月発売予定" else None
        self.rows = [r for r in self.rows if not (r["event_date"] is None and planned(r) and planned(r) < TODAY) and not (r["source"] in ("channeltono", "rarecheck") and r["event_date"] is None and planned(r) is None)]
        return self.rows


def made(rng, n):
    names = ["red dragon figure", "figure red dragon", "blue knight", "blue knight special set", "short", "nike air max", "red dragon figure 【BOX】", "green box toy"]
    out = []
    for k in range(1, n + 1):
        day = rng.choice([None, TODAY, TODAY + datetime.timedelta(days=3)])
        store = rng.choice([None] * 6 + [json.dumps([{"name": "A", "at": str(TODAY + datetime.timedelta(days=rng.choice([-2, 1, 5]))), "kind": "締切"}])])
        page = rng.choice(["https://shop.example/goods/a1", "https://shop.example/goods/b2", "https://shop.example/list", "https://shop.example/list#x", ""])
        out.append(
            dict(
                zip(
                    FIELDS,
                    (
                        k, rng.choice(["amiami", "hobby", "snkrdunk", "nike_snkrs", "channeltono"]), rng.choice(names), day, rng.choice([None, None, "9月予定", "2026年7月発売予定"]), page, rng.choice([None, "https://maker.example/items/z9"]), store,
                        rng.choice([None, "1200円", "3500円"]), rng.choice([None, "https://i/x.png"]), rng.choice([None, None, 900, 1500]), rng.choice([None, "", "中古 900円"]), rng.choice([None, "https://m/1"]), rng.choice([None, "m"]), rng.choice([None, True, False]), rng.choice([None, "", "抽選あり"]),
                    ),
                    strict=True,
                )
            )
        )
    return out


@pytest.mark.parametrize("seed, n", [(1, 12), (2, 40), (3, 90)])
def test_resolution_is_that_of_a_plain_version(spark, seed, n):
    rows = made(random.Random(seed), n)
    frame = conform(spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], SCHEMA), ITEM)
    got = sorted(tuple(r) for r in resolve.resolve(frame, str(TODAY)).select(*SHOWN).collect())
    want = sorted((tuple(r[f] for f in SHOWN) for r in Plain(rows).run()), key=lambda r: r[0])
    assert got == want and 0 < len(want) < n
