"""Substring search by an inverted index of character grams.

A text that contains a word has all the word's grams, so the rarest of them, as
an equi-join key, gives every text that can contain it; `contains` then decides.
The join's rows grow with the postings of the rarest gram, not with texts times
words, and a gram that many texts have is an ordinary skewed key, which the
adaptive join splits. Words shorter than `SIZE` are grams of their own length,
the empty word is in every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SIZE = 3


def grams(text: Column, size: int) -> Column:
    """The distinct character grams of a size; none of a shorter text."""
    if size == 0:
        return F.array(F.lit(""))
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))


def word_grams(word: Column) -> Column:
    """The grams that a word is looked up by: of SIZE, or of its own length."""
    sizes = F.when(F.length(word) >= SIZE, grams(word, SIZE))
    return F.coalesce(sizes, F.array(word))


def postings(texts: DataFrame, text: str, least: int = SIZE) -> DataFrame:
    """The rows of `texts` once for each gram of their column `text`, if that isn't null; `least` is the length of the shortest word to be found."""
    sizes = range(min(least, SIZE), SIZE + 1)
    return texts.where(F.col(text).isNotNull()).withColumn("gram", F.explode(F.concat(*(grams(F.col(text), n) for n in sizes))))


def text_counts(posted: DataFrame, *keys: str) -> DataFrame:
    """How many texts have each gram."""
    return posted.groupBy(*keys, "gram").agg(F.count("*").alias("texts"))


def rarest(words: DataFrame, counts: DataFrame, word: str, *keys: str) -> DataFrame:
    """The rows of `words` with `gram`, the one that fewest texts of their keys have, and `texts`, how many; words with a gram that none has go."""
    asked = words.select(*keys, word).distinct().withColumn("gram", F.explode(word_grams(F.col(word))))
    counted = asked.join(counts, [*keys, "gram"], "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    best = counted.groupBy(*keys, word).agg(F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.min("texts").alias("texts")).where("texts > 0")
    return words.join(best, [*keys, word])


def containing(words: DataFrame, posted: DataFrame, counts: DataFrame, word: str, text: str, *keys: str) -> DataFrame:
    """Rows of `words` and of the texts that `postings` holds, with equal keys, where the text contains the word; other column names differ."""
    found = rarest(words, counts, word, *keys).drop("texts").join(posted, [*keys, "gram"])
    return found.where(F.contains(F.col(text), F.col(word))).drop("gram")


def _inside(words: DataFrame, texts: DataFrame, word: str, text: str, *keys: str) -> DataFrame:
    """`containing` over texts that aren't indexed yet; only grams that a word has are counted.

    Texts exploded into grams look as small as the texts to the planner, which would
    send them through the driver: all these joins are by sorting.
    """
    words = words.hint("merge")
    asked = words.select(*keys, F.explode(word_grams(F.col(word))).alias("gram")).distinct()
    posted = postings(texts, text, 0).join(asked, [*keys, "gram"], "left_semi").hint("merge")
    return containing(words, posted, text_counts(posted, *keys), word, text, *keys)


def either_containing(a: DataFrame, b: DataFrame, one: str, other: str, *keys: str) -> DataFrame:
    """Rows of `a` and of `b` with equal keys where one of two texts contains the other, once each.

    The shorter text is the word; of two equal lengths only equal texts match.
    """
    inside = _inside(a, b, one, other, *keys).where(F.length(one) <= F.length(other))
    around = _inside(b, a, other, one, *keys).where(F.length(other) < F.length(one))
    return inside.unionByName(around)
