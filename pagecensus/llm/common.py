"""What the corpus operators share: the texts' alphabets, sizes of inputs, row keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The blanks that the operators' contracts name, as a character class body.
BLANK = r"\x20\x09-\x0D"


def whole(text: str | Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def squeezed(text: Column) -> Column:
    """The text without any blank."""
    return F.regexp_replace(text, f"[{BLANK}]+", "")


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-blanks, without an array of the words.

    Each run and the blanks around it become one character; a text without a run counts 0.
    """
    marks = F.regexp_replace(text, f"[{BLANK}]*[^{BLANK}]+[{BLANK}]*", "x")
    return F.when(text.rlike(f"[^{BLANK}]"), F.length(marks)).otherwise(0).cast("long")


def as_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of the input meets a name of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def shuffle_parts(df: DataFrame, total_bytes: int, part_bytes: int = 64 << 20) -> int:
    """Partitions for so many bytes: the session's number, or more where that would make large ones."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(session, -(-total_bytes // part_bytes))
