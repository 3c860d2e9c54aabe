"""Lexicon keyword frequency over review text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaselens.functions.text import ascii_words


def keyword_frequency(df: DataFrame, text: str, lexicon, k: int | None = None,
                      word_col: str = "keyword", count_col: str = "frequency") -> DataFrame:
    """Count lexicon words in ``text`` (every occurrence, whole texts).

    Words are filtered against the lexicon inside each row's token array
    before ``explode``, so only lexicon hits leave the scan stage and reach
    the (partially aggregated) shuffle on the word. Ties in the top-k are
    broken alphabetically."""
    lex = sorted(set(lexicon))
    hits = F.filter(ascii_words(F.col(text)), lambda w: w.isin(lex))
    counts = (df.where(F.col(text).isNotNull())
              .select(F.explode(hits).alias(word_col))
              .groupBy(word_col).agg(F.count(F.lit(1)).alias(count_col)))
    if k is not None:
        counts = counts.orderBy(F.desc(count_col), F.asc(word_col)).limit(k)
    return counts
