"""Whether a page declared a generally applicable noindex, per channel and combined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.functions.columns import stripped, without_first

PRESENT, ABSENT = "PRESENT", "ABSENT"
INDETERMINATE, NOT_APPLICABLE, UNASSESSED = "INDETERMINATE", "NOT_APPLICABLE", "UNASSESSED"


def _directives(declaration: Column) -> Column:
    return F.filter(
        F.transform(F.split(declaration, ","), lambda d: stripped(d)), lambda d: d != ""
    )


def _noindex_among(directives: Column) -> Column:
    return F.exists(directives, lambda d: F.lower(d).isin(V.NOINDEX_DIRECTIVES))


def _verdict(condition: Column) -> Column:
    return F.when(condition, PRESENT).otherwise(ABSENT)


def meta_verdict(contents: Column, truncated: Column) -> Column:
    """The document channel: a directive seen stands, one not seen in a cut read is open."""
    seen = F.exists(contents, lambda c: _noindex_among(_directives(c)))
    return F.when(seen, PRESENT).when(truncated, INDETERMINATE).otherwise(ABSENT)


def _line_verdict(directives: Column) -> Column:
    """One physical header line: the name before the first colon decides who is addressed."""
    first = F.get(directives, F.lit(0))
    name = F.lower(stripped(F.substring_index(first, ":", 1)))
    rest = without_first(directives)
    return (
        F.when(F.size(directives) == 0, ABSENT)
        .when(~first.contains(":"), _verdict(_noindex_among(directives)))
        .when((name == "") | name.isin(V.NOINDEX_DIRECTIVES), INDETERMINATE)
        .when(name.isin(V.VALUE_BEARING_RULES), _verdict(_noindex_among(rest)))
        .otherwise(ABSENT)
    )


def line_verdicts(lines: Column) -> Column:
    """The verdict of each header line, lines kept apart."""
    return F.transform(F.transform(lines, lambda line: _directives(line)), _line_verdict)


def combined_verdict(channels: Column) -> Column:
    """One verdict from several: present wins, an open channel forbids an absence."""
    return (
        F.when(F.array_contains(channels, PRESENT), PRESENT)
        .when(
            F.arrays_overlap(channels, F.array(F.lit(INDETERMINATE), F.lit(UNASSESSED))),
            INDETERMINATE,
        )
        .when(F.array_contains(channels, ABSENT), ABSENT)
        .otherwise(NOT_APPLICABLE)
    )


def header_verdict(lines: Column) -> Column:
    """The header channel; a response without such a header declares nothing."""
    empty = F.coalesce(F.size(lines), F.lit(0)) <= 0
    return F.when(empty, ABSENT).otherwise(combined_verdict(line_verdicts(lines)))


