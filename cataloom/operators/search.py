"""An inverted index over titles, and probes of the search with it: what is offered as an example must be found, and so must each title.

A distinct search form is kept under each distinct run of one to three of its characters, and rows under their form. A text
is looked up by the rarest of its own runs, and only forms that have that one are looked at: no title is read once more for
each word, or for each row that has it too.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, text
from ..sources.shared import cut

GRAM = 3


def _grams(form: Column, size: int) -> Column:
    return F.when(F.length(form) >= size, F.transform(F.sequence(F.lit(1), F.length(form) - (size - 1)), lambda k: F.substring(form, k, F.lit(size)))).otherwise(F.array().cast("array<string>"))


class Index(NamedTuple):
    """rows (id, form); forms (form, f): each distinct form once, and a hash that stands for it among its runs."""

    rows: DataFrame
    forms: DataFrame

    def postings(self) -> DataFrame:
        """(gram, f): no form is repeated for each of its runs, and none for each row that has it."""
        every = F.array_distinct(F.concat(*[_grams(F.col("form"), k) for k in range(1, GRAM + 1)]))
        return self.forms.select("f", F.explode(every).alias("gram"))


def index(rows: DataFrame) -> Index:
    """Of rows (id, title); rows without a title are in no place of it."""
    formed = cut(rows.select("id", text.search_form(F.col("title")).alias("form")).where(F.length("form") > 0), "search-rows")
    return Index(formed, cut(formed.select("form").distinct().withColumn("f", F.xxhash64("form")), "search-forms"))


def forms(words: DataFrame, synonyms=text.SYNONYMS) -> DataFrame:
    """(word, form): a word's search form, and those of what it is another name for."""
    table = tuple(names.Name(str(k), text.expanded(alias, ())[0]) for k, (alias, _) in enumerate(synonyms))
    canon = F.create_map(*[x for k, (_, others) in enumerate(synonyms) for x in (F.lit(str(k)), F.array(*[F.lit(text.expanded(o, ())[0]) for o in others]))]) if synonyms else F.create_map().cast("map<string,array<string>>")
    own = words.select("word", text.search_form(F.col("word")).alias("form")).where(F.length("form") > 0)
    others = F.flatten(F.transform(names.found(F.col("form"), table), lambda k: canon[k])) if synonyms else F.array().cast("array<string>")
    return own.select("word", F.explode(F.array_distinct(F.concat(F.array("form"), others))).alias("form"))


def _hits(asked: DataFrame, index_: Index) -> DataFrame:
    """(asked, hit): which of the index's forms hold the distinct forms of `asked`. Forms that meet by their hash are compared."""
    size = F.least(F.length("form"), F.lit(GRAM))
    pick = F.when(size == GRAM, _grams(F.col("form"), GRAM)).otherwise(F.array("form"))
    grams = asked.select("form").distinct().select("form", F.explode(F.array_distinct(pick)).alias("gram"))
    df = index_.postings().join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    rarest = grams.join(df, "gram", "left").groupBy("form").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g"))
    looked = rarest.where("g.df > 0").select(F.col("form").alias("asked"), F.col("g.gram").alias("gram"))
    return looked.join(index_.postings(), "gram").select("asked", "f").join(index_.forms, "f").where(F.contains("form", "asked")).select("asked", F.col("form").alias("hit"))


def found(asked: DataFrame, index_: Index) -> DataFrame:
    """(key, id) of texts (key, form) and the rows whose form holds them, each once."""
    hits = asked.select("key", F.col("form").alias("asked")).join(_hits(asked, index_), "asked").select("key", F.col("hit").alias("form")).distinct()
    return hits.join(index_.rows.hint("merge"), "form").select("key", "id").distinct()


def broken(examples: DataFrame, shown: DataFrame, index_: Index, synonyms=text.SYNONYMS) -> DataFrame:
    """(finding, what): examples (word) that find nothing, and shown rows (id, title) that their own title doesn't find."""
    word_forms = forms(examples.distinct(), synonyms)
    hit = found(word_forms.select(F.col("word").alias("key"), "form"), index_).select(F.col("key").alias("word")).distinct()
    zero = examples.distinct().join(hit, "word", "left_anti").select(F.lit("example_finds_nothing").alias("finding"), F.col("word").alias("what"))
    own = shown.select(F.col("id").cast("string").alias("key"), text.search_form(F.col("title")).alias("form")).where(F.length("form") > 0)
    kept = index_.rows.select(F.col("id").cast("string").alias("key"), F.col("form").alias("kept"))
    met = own.join(kept, "key").join(_hits(own, index_), (F.col("asked") == own["form"]) & (F.col("kept") == F.col("hit")), "left_semi").select("key")
    lost = own.join(met, "key", "left_anti").select(F.lit("title_not_found").alias("finding"), F.col("key").alias("what"))
    return zero.unionByName(lost)
