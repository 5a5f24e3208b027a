"""Names of works in titles: all of a table's names found in one pass over a title, by one automaton for all of them.

A table is a tuple of `Name`s. `found` reads each title once, whatever the number of names (Aho-Corasick, in Arrow batches);
what a name asks beyond its letters (its case, the borders of a word, a digit after it) is looked at where it was met.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from itertools import pairwise, product
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .text import INVISIBLE, PACKAGE_WORDS, SPACE, TITLE_MARKS


class Name(NamedTuple):
    """A text that stands for a group; `folded` in any case, `word` with no ASCII letter, digit or _ beside it, `numbered` before a digit."""

    group: str
    text: str
    folded: bool = False
    word: bool = False
    numbered: bool = False


#: Works and their names, the one to show first; a work is in a title if one of its names is, as written (fixed values).
WORKS: tuple[tuple[str, ...], ...] = (
    ("ワンピース", "ワンピース", "ONE PIECE", "ONEPIECE", "ONE PIECEカード"),
    ("NARUTO", "NARUTO", "ナルト", "BORUTO", "ボルト"),
    ("僕のヒーローアカデミア", "僕のヒーロー", "ヒロアカ"),
    ("魔法少女まどか☆マギカ", "まどか☆マギカ", "まどマギ", "まどか"),
    ("Re:ゼロから始める異世界生活", "Re:ゼロ", "Re：ゼロ", "リゼロ"),
    ("初音ミク", "初音ミク", "ミクダヨー"),
    ("ポケモン", "ポケモン", "ポケットモンスター", "ポケカ"),
    ("ガンダム", "ガンダム", "GUNDAM", "ガンプラ"),
    ("ドラゴンボール", "ドラゴンボール", "DRAGON BALL", "DRAGONBALL"),
    ("遊戯王", "遊戯王"),
    ("NIKKE", "NIKKE", "勝利の女神"),
    ("サンリオ", "サンリオ", "ハローキティ", "シナモロール", "マイメロディ", "クロミ", "ポムポムプリン"),
    ("葬送のフリーレン", "フリーレン"),
    ("ヴァイスシュヴァルツ", "ヴァイスシュヴァルツ"),
    ("鬼滅の刃", "鬼滅の刃", "鬼滅"),
    ("ウマ娘", "ウマ娘"),
    ("呪術廻戦", "呪術廻戦", "呪術"),
    ("東方Project", "東方Project", "東方project"),
    ("チェンソーマン", "チェンソーマン"),
    ("たまごっち", "たまごっち", "Tamagotchi"),
    ("デジモン", "デジモン", "デジタルモンスター", "DIGIMON"),
    ("ホロライブ", "ホロライブ", "hololive"),
    ("ジョジョの奇妙な冒険", "ジョジョ", "ジョジョの奇妙"),
    ("ちいかわ", "ちいかわ"),
    ("デュエル・マスターズ", "デュエル・マスターズ", "デュエマ", "デュエル・マスターズTCG"),
    ("アイドルマスター", "アイドルマスター", "アイマス", "学園アイドルマスター", "学マス", "シンデレラガールズ"),
    ("プリキュア", "プリキュア"),
    ("五等分の花嫁", "五等分の花嫁", "五等分"),
    ("キングダム", "キングダム"),
    ("ウルトラマン", "ウルトラマン"),
    ("仮面ライダー", "仮面ライダー"),
    ("名探偵コナン", "名探偵コナン", "コナン"),
    ("ハイキュー", "ハイキュー"),
    ("星のカービィ", "星のカービィ", "カービィ"),
    ("推しの子", "推しの子"),
    ("新世紀エヴァンゲリオン", "エヴァンゲリオン", "エヴァ", "EVANGELION"),
    ("ラブライブ", "ラブライブ"),
    ("進撃の巨人", "進撃の巨人"),
)


def spelled(*parts: str | tuple[str, ...]) -> tuple[str, ...]:
    """All texts of parts that are written in one of several ways."""
    return tuple("".join(x) for x in product(*((p,) if isinstance(p, str) else p for p in parts)))


_GAP, _DOT = ("", " ", "　"), ("", "・")
#: Card games in the order of display: the source that is theirs, names in titles, and names in kinds (fixed values).
CARD_GAMES: tuple[tuple[str, str | None, tuple[Name, ...], tuple[Name, ...]], ...] = tuple(
    (label, source, tuple(n._replace(group=label) for n in titles), tuple(n._replace(group=label) for n in kinds))
    for label, source, titles, kinds in (
        ("ポケカ", "pokemoncard", [Name("", x) for x in ("ポケモンカード", "ポケカ")], [Name("", x) for x in ("ポケモン", "ポケカ")]),
        ("ワンピースカード", None, [Name("", x, folded=True) for x in (*spelled("ワンピース", _GAP, "カード"), "ワンピカ", *spelled("ONE", _GAP, "PIECE", _GAP, "カード"))], [Name("", x, folded=True) for x in ("ワンピース", *spelled("ONE", _GAP, "PIECE"))]),
        ("ガンダムカード", None, [Name("", x, folded=True) for x in ("ガンダムカード", *spelled("GUNDAM", _GAP, "CARD"))], [Name("", "ガンダム")]),
        ("遊戯王", None, [Name("", x) for x in ("遊戯王", "遊☆戯☆王")], [Name("", "遊戯王")]),
        ("ドラゴンボールカード", None, [Name("", x, folded=True) for x in ("ドラゴンボール", "フュージョンワールド", *spelled("FUSION", _GAP, "WORLD"))], []),
        ("デュエマ", None, [*(Name("", x) for x in (*spelled("デュエル", _DOT, "マスターズ"), "デュエマ")), Name("", "DM", folded=True, word=True, numbered=True)], [Name("", "デュエ")]),
        ("ヴァイスシュヴァルツ", None, [Name("", "ヴァイス")], [Name("", "ヴァイス")]),
        ("MTG", None, [*(Name("", x) for x in spelled("マジック", ("", ":", "："), "ザ", _DOT, "ギャザリング")), Name("", "MTG", folded=True, word=True)], [Name("", "MTG", folded=True), Name("", "マジック")]),
        ("名探偵コナンカード", None, [Name("", x) for x in ("名探偵コナン", "コナンカード", "追憶の盟友")], [Name("", "コナン")]),
        ("デジモンカード", None, [Name("", "デジモン")], [Name("", "デジモン")]),
    )
)


def folded(text: str) -> str:
    """Lower case, of which each character has one."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Finder:
    """An automaton over the names of a table, in lower case."""

    def __init__(self, names: Iterable[Name]):
        self.names = tuple(n for n in names if n.text)
        self.groups = {g: k for k, g in enumerate(dict.fromkeys(n.group for n in self.names))}
        self.automaton = ahocorasick.Automaton()
        for n in self.names:
            key = folded(n.text)
            self.automaton.add_word(key, (len(key), (*self.automaton.get(key, (0, ()))[1], n)))
        if self.names:
            self.automaton.make_automaton()

    def found(self, text: str | None) -> set[int]:
        """Numbers of the groups of which a name is in the text."""
        out: set[int] = set()
        if not text or not self.names:
            return out
        beside = lambda c: c.isascii() and (c.isalnum() or c == "_")
        for end, (size, names) in self.automaton.iter(folded(text)):
            start, end = end + 1 - size, end + 1
            for n in names:
                group = self.groups[n.group]
                if group in out or not (n.folded or text[start:end] == n.text):
                    continue
                if n.word and (beside(text[start - 1 : start]) or (not n.numbered and beside(text[end : end + 1]))):
                    continue
                if n.numbered and not (text[end : end + 1].isascii() and text[end : end + 1].isdigit()):
                    continue
                out.add(group)
        return out


_FINDERS: dict[tuple[Name, ...], Finder] = {}


def finder(names: tuple[Name, ...]) -> Finder:
    """A table's automaton; one for each worker."""
    if names not in _FINDERS:
        _FINDERS[names] = Finder(names)
    return _FINDERS[names]


#: Most names of a table: it goes to every worker.
MOST = 200_000


def table_of(texts: Iterable[str]) -> tuple[Name, ...]:
    """Names that each are a group, as written. A table is sent to every worker: it has at most MOST names."""
    out = tuple(Name(t, t) for t in dict.fromkeys(texts))
    if len(out) > MOST:
        raise ValueError(f"{len(out)} names; take them in tables of {MOST}")
    return out


def found(text: Column, names: tuple[Name, ...]) -> Column:
    """The groups of which a name is in a text, in the table's order: array of strings, empty for null."""
    groups = list(dict.fromkeys(n.group for n in names if n.text))

    @F.arrow_udf(ArrayType(IntegerType()))
    def numbers(texts: pa.Array) -> pa.Array:
        look = finder(names).found
        return pa.array([sorted(look(t)) for t in texts.to_pylist()], pa.list_(pa.int32()))

    labels = F.array(*map(F.lit, groups)).cast("array<string>")
    return F.transform(numbers(text), lambda k: F.element_at(labels, k + 1))


WORK_NAMES = tuple(Name(work, name) for work, *names in WORKS for name in names)


def works_in(title: Column) -> Column:
    """The works that a title names."""
    return found(title, WORK_NAMES)


def all_names(works: Column) -> Column:
    """The names of works, to look for what is related: those to show and all others, each once."""
    table = F.create_map(*[x for group in WORKS for x in (F.lit(group[0]), F.array(*map(F.lit, group)))])
    return F.array_distinct(F.flatten(F.transform(works, lambda w: table[w])))


def card_games(source: Column, kind: Column, title: Column) -> Column:
    """The card games that a row belongs to: by its source, its kind or its title; a row may have several."""
    of = lambda k: tuple(n for game in CARD_GAMES for n in game[k])
    in_title, in_kind = found(title, of(2)), found(kind, of(3))

    def chosen(hits: Column) -> Column:
        its = lambda label, own: F.array_contains(hits["title"], label) | F.array_contains(hits["kind"], label) | (F.coalesce(source == own, F.lit(False)) if own else F.lit(False))
        return F.array_compact(F.array(*[F.when(its(label, own), F.lit(label)) for label, own, *_ in CARD_GAMES]))

    return F.transform(F.array(F.struct(in_title.alias("title"), in_kind.alias("kind"))), chosen)[0]


_SPACE, _MARKS, _INVISIBLE = (re.compile(x) for x in (SPACE.replace(r"\s", r" \t\n\x0b\f\r"), TITLE_MARKS, INVISIBLE))
_RAW_CODE = re.compile(r"[A-Z]{1,4}-?[0-9]{1,3}[A-Z]{0,2}")
TITLE_FACTS = "form string, works array<string>, codes array<string>, rest string, grams array<string>, rest_grams array<string>"
#: Letters before a number that make no code of a product (fixed values).
NO_CODES = frozenset(("VOL", "PART", "NO", "CH", "EP", "VER", "TYPE", "ROUND", "SET"))


def _form(text: str) -> str:
    return _MARKS.sub("", _SPACE.sub("", text))


def numbered_bigrams(form: str) -> list[str]:
    """Bigrams, each with how often it has occurred: sets of these meet as often as the bigrams with their repeats do."""
    seen: Counter = Counter()
    out = []
    for a, b in pairwise(form):
        seen[a + b] += 1
        out.append(f"{a}{b}{seen[a + b]}")
    return out


def facts_of(title: str | None, look: Finder) -> dict:
    """What matching asks of a title, folded once: its form, works, codes, and its form without works' names and words of packages."""
    title = title or ""
    wide = unicodedata.normalize("NFKC", title)
    low = rest = wide.lower()
    works = [WORKS[k] for k in sorted(look.found(title))]
    for name in dict.fromkeys(n for w in works for n in w):
        rest = rest.replace(name.lower(), " ")
    for word in PACKAGE_WORDS:
        rest = rest.replace(word, " ")
    codes = dict.fromkeys(c.replace("-", "") for c in _RAW_CODE.findall(wide.upper()))
    letters = lambda c: re.match("[A-Z]*", c)[0]
    form, rest = _form(low), _form(rest)
    codes = [c for c in codes if len(c) >= 3 and len(letters(c)) >= 2 and letters(c) not in NO_CODES]
    return {"form": form, "works": [w[0] for w in works], "codes": codes, "rest": rest, "grams": numbered_bigrams(form), "rest_grams": numbered_bigrams(rest)}


def title_facts(title: Column) -> Column:
    """struct of a title's form, works, codes, rest, and the numbered bigrams of form and rest."""
    kind = pa.struct([(n, pa.list_(pa.string()) if n in ("works", "codes", "grams", "rest_grams") else pa.string()) for n in ("form", "works", "codes", "rest", "grams", "rest_grams")])

    @F.arrow_udf(TITLE_FACTS)
    def facts(titles: pa.Array) -> pa.Array:
        look = finder(WORK_NAMES)
        return pa.array([facts_of(t, look) for t in titles.to_pylist()], kind)

    return facts(title)
