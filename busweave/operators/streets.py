"""Which texts contain which names, through an inverted index of q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busweave.session import checkpointed

#: Length of the pieces under which texts are listed; shorter names are looked up by their whole text.
GRAM = 3


def _pieces(text: str, size: Column) -> Column:
    """Distinct pieces of ``size`` characters; none if the text is shorter, the empty piece for size 0."""
    last = F.length(text) - size + 1
    places = F.when(size == 0, F.array(F.lit(1))).when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda at: F.substring(F.col(text), at, size)))


def gram_index(texts: DataFrame, q: int = GRAM) -> DataFrame:
    """``(gram, text)``: every distinct piece of up to ``q`` characters of each distinct, known text."""
    known = texts.where("text IS NOT NULL").select("text").distinct()
    grams = [_pieces("text", F.lit(size)) for size in range(q + 1)]
    return known.select(F.explode(F.concat(*grams)).alias("gram"), "text")


def candidate_pairs(names: DataFrame, index: DataFrame, q: int = GRAM) -> DataFrame:
    """``(name, text)`` of every distinct name and the texts listed under its rarest piece.

    A name with a piece that no text has is in none of them and has no row.
    """
    known = names.where("name IS NOT NULL").select("name").distinct()
    size = F.least(F.length("name"), F.lit(q))
    pieces = known.select("name", F.explode(_pieces("name", size)).alias("gram"))
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    rarest = pieces.join(often, "gram", "left").groupBy("name").agg(F.min(rarity).alias("rarest"))
    return rarest.where("rarest.n > 0").select("name", F.col("rarest.gram").alias("gram")).join(index, "gram").select("name", "text")


def containing_pairs(names: DataFrame, texts: DataFrame, q: int = GRAM) -> DataFrame:
    """Distinct ``(name, text)`` with the name, of ``names.name``, somewhere in the text, of ``texts.text``.

    Each pair is met once: a name looks up its rarest piece of ``q`` characters, and what is listed there is compared
    in full. The empty name is in every text. Nulls are in no pair. Upper and lower case differ.
    """
    index = checkpointed(gram_index(texts, q), "grams")
    return candidate_pairs(names, index, q).where(F.contains("text", "name"))
