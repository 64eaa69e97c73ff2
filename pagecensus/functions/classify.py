"""Page types from whole words of a path, a query or a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V


def words(text: Column) -> Column:
    """Whole words, each hyphenated compound both as written and in parts."""
    plain = F.regexp_replace(F.lower(text), r"\.[a-z0-9]{1,8}\z", "")
    plain = F.translate(F.regexp_replace(plain, "%[0-9a-f]{2}", " "), "_", "-")
    return F.concat(F.split(plain, "[^a-z0-9-]+"), F.split(plain, "[^a-z0-9]+"))


def type_of_words(found: Column) -> Column:
    """The first page type, in declared order, one of whose words occurs; else null."""
    return F.coalesce(*[
        F.when(F.arrays_overlap(found, F.array(*[F.lit(w) for w in vocabulary])), page_type)
        for page_type, vocabulary in V.PAGE_TYPE_WORDS.items()
    ])
