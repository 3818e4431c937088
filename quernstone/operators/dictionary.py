"""Dictionary matching: where the aliases of entities stand in texts, word by word, with the sentence as evidence.

Aliases are posted under their first word; a text's words meet them by equi-join and the alias's other words are then compared at their places,
so the work is the texts' words plus the places where some alias begins, whatever the dictionary's size.

Defined results: matching is by whole words of letters and digits in lower case, so marks and line ends between words do not matter; an alias without
words matches nothing; repeated aliases count once; nulls are empty; matches may overlap; empty texts and dictionaries give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import let
from quernstone.plans.durable import durable, join_small

WORD = r"[\p{L}\p{N}]+"
SENTENCE = r"[^.!?\n]+[.!?]?"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def postings(aliases: DataFrame, entity: str, alias: str) -> DataFrame:
    """(entity, head, rest): every alias once, as its first word and the others."""
    w = aliases.select(F.col(entity).alias("entity"), words(F.col(alias)).alias("w")).where("size(w) > 0").distinct()
    return w.select("entity", F.col("w")[0].alias("head"), F.expr("slice(w, 2, size(w) - 1)").alias("rest"))


def matches(texts: DataFrame, id_: str, text: str, aliases: DataFrame, entity: str, alias: str) -> DataFrame:
    """(id, entity, alias, sentence_no, word, sentence): every place where an alias begins: the sentence (from 0, those without words do not count), the word in it, and the
    sentence as evidence. An alias may go on in the next sentences."""
    posted = durable(postings(aliases, entity, alias))
    longest = posted.agg(F.max(F.size("rest"))).first()[0] or 0
    parts = F.filter(F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: s.rlike(WORD))
    # each sentence with the words that follow it, as far as an alias could reach
    reach = lambda p: F.transform(p, lambda s, i: F.struct(i.alias("no"), s.alias("sentence"), F.concat_ws(" ", F.slice(p, i + 1, longest + 1)).alias("near")))
    own = texts.select(F.col(id_).alias("id_"), F.explode(let(parts, reach)).alias("s")).select("id_", "s.no", "s.sentence", words(F.col("s.near")).alias("near"), F.size(words(F.col("s.sentence"))).alias("n"))
    at = own.select("id_", "no", "sentence", F.slice("near", 1, F.col("n") + longest).alias("near"), F.posexplode(F.slice("near", 1, F.col("n"))).alias("k", "head"))
    met = join_small(at, posted, ["head"], "inner").where(F.slice("near", F.col("k") + 2, F.size("rest")) == F.col("rest"))
    return met.select(F.col("id_").alias(id_), "entity", F.concat_ws(" ", F.array("head"), "rest").alias("alias"), F.col("no").cast("long").alias("sentence_no"), F.col("k").cast("long").alias("word"), "sentence")
