"""Words as runs of characters that are not ASCII white space, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    plain = F.btrim(F.translate(F.coalesce(text, F.lit("")), "\t\n\v\f\r", "     "))
    spaced = F.size(F.split(plain, " +"))
    return F.when(plain == "", F.lit(0)).otherwise(spaced).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words, one space between them."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n.cast("int")), " ")
