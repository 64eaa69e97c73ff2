"""Small column builders shared by all jobs: texts, ids, digests, instants, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V

_BLANKS = f"[{V.CONTROL_CLASS}{V.UNICODE_SPACE_CLASS}]+"
_SPACE = rf"[\t-\r\u001C-\u0020\u0085\u2028\u2029{V.UNICODE_SPACE_CLASS}]+"
_URL_SHAPE = rf"^https?://[^{V.CONTROL_CLASS}]{{1,2040}}\z"
_PUBLIC_URL_SHAPE = (
    rf"^https?://[^{V.CONTROL_CLASS}/?#@]{{1,253}}(?:[/?#][^{V.CONTROL_CLASS}]{{0,1790}})?\z"
)
_PUBLIC_ORIGIN_SHAPE = rf"^https?://[^{V.CONTROL_CLASS}\\/?#@]{{1,253}}/?\z"
CODE_SHAPE = r"^[A-Z][A-Z0-9_]+\z"


def stripped(text: Column) -> Column:
    """Leading and trailing white space removed, line breaks and Unicode spaces included.

    Plain text holds none, and is told by a far cheaper match.
    """
    return F.when(is_plain(text), text).otherwise(F.regexp_replace(text, rf"^{_SPACE}|{_SPACE}\z", ""))


def single_line(text: Column) -> Column:
    """Controls and Unicode blanks folded to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def representable(text: Column, bound: int = V.MAX_TEXT_LENGTH) -> Column:
    """The normalised text, or null when it is empty or longer than ``bound``; never shortened."""
    line = single_line(text)
    return F.when((F.length(line) > 0) & (F.length(line) <= bound), line)


def is_plain(text: Column) -> Column:
    """Printable ASCII throughout: true of nearly every URL, and cheap to see."""
    return text.rlike(r"^[!-~]*\z")


def _has_shape(text: Column, bound: int, plain_shape: str, shape: str) -> Column:
    """Length and shape.  Plain text meets a shape without the long excluded classes, which are
    what a match spends its time on; the two agree on plain text."""
    fits = F.length(text) <= bound
    return F.coalesce(
        F.when(is_plain(text), fits & text.rlike(plain_shape)).otherwise(fits & text.rlike(shape)),
        F.lit(False),
    )


def is_contract_url(url: Column) -> Column:
    """Whether a document member of URL shape can carry this value; false for null."""
    return _has_shape(url, V.MAX_URL_LENGTH, r"^https?://.{1,2040}\z", _URL_SHAPE)


def is_persistable(form: Column) -> Column:
    """Whether a written form may be recorded verbatim."""
    plain = r"^https?://[^/?#@]{1,253}(?:[/?#].{0,1790})?\z"
    return _has_shape(form, V.MAX_URL_LENGTH, plain, _PUBLIC_URL_SHAPE)


def is_public_origin(origin: Column) -> Column:
    plain = r"^https?://[^\\/?#@]{1,253}/?\z"
    return _has_shape(origin, V.MAX_ORIGIN_LENGTH, plain, _PUBLIC_ORIGIN_SHAPE)


def is_code(token: Column) -> Column:
    return F.coalesce((F.length(token) <= 64) & token.rlike(CODE_SHAPE), F.lit(False))


def media_type(content_type: Column) -> Column:
    """The bare, lower-cased media type; null when none is declared."""
    bare = F.lower(stripped(F.substring_index(content_type, ";", 1)))
    return F.when(bare != "", bare)


def declared_charset(content_type: Column) -> Column:
    """The charset parameter of a content type; null when none is declared."""
    parameters = without_first(F.split(content_type, ";"))
    named = F.filter(
        parameters,
        lambda p: F.lower(stripped(F.substring_index(p, "=", 1))) == "charset",
    )
    first = F.get(named, F.lit(0))
    value = F.when(
        F.instr(first, "=") > 0, stripped(_after(first, "="))
    ).otherwise("")
    bare = F.regexp_replace(F.regexp_replace(value, r'^"+|"+$', ""), r"^'+|'+$", "")
    return F.when(bare != "", bare)


def without_first(items: Column) -> Column:
    """An array without its first item."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def _after(text: Column, mark: str) -> Column:
    """Everything after the first ``mark``."""
    return F.substring(text, F.instr(text, mark) + F.lit(len(mark)), F.length(text))


def after_first(text: Column, mark: str) -> Column:
    """Everything after the first ``mark``; empty when there is none."""
    return F.when(F.instr(text, mark) > 0, _after(text, mark)).otherwise("")


def digest_text(value: Column) -> Column:
    """``sha256:`` and the hex digest of a text's UTF-8 bytes or of a binary value."""
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def stable_id(kind: str, *parts: Column) -> Column:
    """A deterministic identifier: the same inputs name the same document on every rerun."""
    joined = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(kind + "-"), F.substring(F.sha2(joined, 256), 1, 32))


def instant(moment: Column) -> Column:
    """UTC text to the second, with the mandatory ``Z``, in a session of any time zone."""
    seconds = F.unix_seconds(moment)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))

    def two(n: Column) -> Column:
        return F.lpad(n.cast("int").cast("string"), 2, "0")

    clock = F.concat_ws(":", two(F.floor(rest / 3600)), two(F.floor(rest % 3600 / 60)), two(rest % 60))
    return F.when(moment.isNotNull(), F.concat(day.cast("string"), F.lit("T"), clock, F.lit("Z")))


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """A literal lookup; null for a key the mapping does not hold."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def strict_json(text: Column) -> Column:
    """The text as a variant; null unless the whole text is one JSON value.

    The parser stops after the first value.  Anything behind it cannot close both an array and an
    object around the text.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    return F.when(alone & held.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def settled(df: DataFrame, names: list[str]) -> DataFrame:
    """Fixes computed columns as the output of a one-row generator.

    Catalyst rewrites a later filter on a computed column in terms of what it was computed from.
    Over staged columns that repeats every stage below it, and over a Python UDF it runs the UDF
    twice.  It does not rewrite through a generator, so each column is computed once.
    """
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*names))))
