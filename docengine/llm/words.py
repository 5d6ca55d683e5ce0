"""Words, as all operators of this subpackage take them, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def pieces(text: Column) -> Column:
    """``text`` (null: empty) split at white space; only the first and the last piece can be empty."""
    return F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1)


def n_pieces(cut: Column) -> Column:
    """Number of words in ``pieces``, long."""
    return (
        F.size(cut)
        - F.when(F.element_at(cut, 1) == "", 1).otherwise(0)
        - F.when((F.size(cut) > 1) & (F.element_at(cut, -1) == ""), 1).otherwise(0)
    ).cast("long")


def words_of(cut: Column) -> Column:
    """The words in ``pieces``."""
    first = F.when(F.element_at(cut, 1) == "", 2).otherwise(1)
    return F.slice(cut, first, n_pieces(cut).cast("int"))
