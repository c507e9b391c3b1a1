"""Which of many texts hold which of many words as substrings, by an equality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files

#: Characters of the piece by which a word is looked up.
PIECE = 4


def _pieces(text: Column, size: int) -> Column:
    """All runs of ``size`` characters; none in shorter texts."""
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """text, word: each distinct text of the column ``text`` with each distinct word of the column ``word`` that stands in it, case and all. Empty words stand in nothing; nulls are left out.

    A word is looked up by one of its pieces of ``PIECE`` characters, the one that fewest words have (a shorter word by itself), so a piece that many words share draws few of them. Texts
    are cut to pieces where they are, pieces are joined by equality, and what meets is compared whole: no text meets all words, however many there are of both.
    """
    w = words.select(F.col(word).alias("word")).where("word <> ''").distinct()
    cut = w.select("word", F.explode(F.when(F.length("word") < PIECE, F.array("word")).otherwise(F.array_distinct(_pieces(F.col("word"), PIECE)))).alias("piece"))
    common = cut.groupBy("piece").agg(F.count("*").alias("n"))
    rare = files.stored(cut.join(common, "piece").groupBy("word").agg(F.min(F.struct("n", "piece"))["piece"].alias("piece")))
    sizes = sorted(r.n for r in rare.select(F.length("piece").alias("n")).distinct().collect())  # PIECE numbers at most
    t = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    found = F.concat(*[_pieces(F.col("text"), n) for n in sizes]) if sizes else F.array().cast("array<string>")
    pieces = t.select("text", F.explode(F.array_distinct(found)).alias("piece"))
    return pieces.join(rare, "piece").where(F.contains("text", "word")).select("text", "word")
