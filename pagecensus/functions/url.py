"""Canonical URL identity as Catalyst columns.

The rules are staged: each stage adds a few hidden columns the next one reads, so no expression is
repeated and every step stays inside the JVM.  Nothing is a Python function at run time, which is
what lets billions of written forms be keyed in the scan stage.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.functions.addresses import ipv6_text
from pagecensus.functions.columns import after_first, is_persistable, is_plain, is_public_origin

_FORBIDDEN = rf"[{V.CONTROL_CLASS}{V.UNICODE_SPACE_CLASS}\\]"
# The printable ASCII characters that may not appear raw in a path or a query.
_UNSAFE = r'["<>\[\\\]^`{|}]'
_UNRESERVED = r"^[A-Za-z0-9\-._~]\z"
_PATH_SAFE = r"A-Za-z0-9\-._~/!$&'()*+,;=:@%"
_QUERY_SAFE = _PATH_SAFE + "?"
# A form no stage would change or refuse: no port, escape, query or fragment, all characters as in a key.
_OWN_KEY = r"^https?://[a-z0-9.\-]{1,253}/[A-Za-z0-9\-._~/!$&'()*+,;=:@]{0,1790}\z"


def _delimiter_lookalikes() -> str:
    """Regex class of non-ASCII characters that NFKC turns into a URL delimiter."""
    found = [
        cp
        for cp in range(0x80, 0x110000)
        if unicodedata.decomposition(chr(cp))
        and any(mark in "/?#@:" for mark in unicodedata.normalize("NFKC", chr(cp)))
    ]
    return "[" + "".join(rf"\x{{{cp:X}}}" for cp in found) + "]"


_LOOKALIKE = _delimiter_lookalikes()


def _normal_escapes(text: Column) -> Column:
    """Escapes in upper case, escaped unreserved characters decoded.  Stray ``%`` is not judged here."""

    def piece(p: Column) -> Column:
        char = F.chr(F.conv(F.substring(p, 2, 2), 16, 10).try_cast("int"))
        return F.when(
            p.startswith("%"), F.when(char.rlike(_UNRESERVED), char).otherwise(F.upper(p))
        ).otherwise(p)

    pieces = F.regexp_extract_all(text, F.lit(r"(%[0-9A-Fa-f]{2}|[^%]+)"), F.lit(1))
    return F.when(F.instr(text, "%") == 0, text).otherwise(
        F.array_join(F.transform(pieces, piece), "")
    )


def _without_dot_segments(path: Column) -> Column:
    """Dot segments resolved; repeated and trailing slashes kept."""
    segments = F.split(path, "/")

    def step(stack: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", stack)
            .when(segment == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .otherwise(F.array_append(stack, segment))
        )

    body = F.slice(segments, F.lit(2), F.size(segments))
    kept = F.aggregate(body, F.array().cast("array<string>"), step)
    open_end = F.when(path.rlike(r"/\.{1,2}\z"), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(
        path.rlike(r"/\.{1,2}(/|\z)"), F.concat(F.lit("/"), F.array_join(open_end, "/"))
    ).otherwise(path)


def _without_tracking(query: Column) -> Column:
    """Tracking pairs and empty pairs dropped, the rest in written order."""

    def keep(pair: Column) -> Column:
        name = F.lower(F.substring_index(pair, "=", 1))
        tracking = name.isin(V.TRACKING_PARAMETERS) | name.startswith(V.TRACKING_PREFIX)
        return (pair != "") & (~tracking | pair.contains(";"))

    return F.when(query == "", query).otherwise(
        F.array_join(F.filter(F.split(query, "&"), keep), "&")
    )


def _percent_encoded(text: Column, safe: str, plain: Column) -> Column:
    """Everything outside ``safe`` as escaped UTF-8 bytes; ``plain`` text rarely needs any."""

    def piece(p: Column) -> Column:
        escaped = F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)", "%$1")
        return F.when(p.rlike(f"^[{safe}]"), p).otherwise(escaped)

    pieces = F.regexp_extract_all(text, F.lit(f"([{safe}]+|[^{safe}])"), F.lit(1))
    return F.when(plain & ~text.rlike(_UNSAFE), text).otherwise(
        F.array_join(F.transform(pieces, piece), "")
    )


def _is_own_key(form: Column) -> Column:
    """Whether a written form is its own key; of a segment that begins with a dot this is left open."""
    fits = F.length(form) <= V.MAX_URL_LENGTH
    return F.coalesce(fits & form.rlike(_OWN_KEY) & ~form.contains("/."), F.lit(False))


def with_url_identity(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Adds ``{prefix}url_key``, ``{prefix}url_refusal`` and ``{prefix}origin`` for ``column``.

    Exactly one of key and refusal is null for every written form; a null form has neither.
    """
    session = df.sparkSession.sparkContext.applicationId
    stages, found = _identity(session, column, prefix)
    outputs = [f"{prefix}url_key", f"{prefix}url_refusal", f"{prefix}origin"]
    kept = [c for c in df.columns if c not in outputs]
    return df.select(*kept, *stages).select(*kept, found)


@functools.lru_cache(maxsize=64)
def _identity(session: str, column: str, prefix: str) -> tuple[list[Column], Column]:
    """The staged expressions for one column name; unresolved, so any table can use them."""
    raw = F.col(column)
    stages: list[Column] = []

    def stage(name: str, value: Column) -> Column:
        """Adds a hidden column; later stages read it as a lateral alias of the same select."""
        stages.append(value.alias(f"__id_{name}"))
        return F.col(f"__id_{name}")

    # Most forms are their own keys: the stages see a null instead, which costs them next to nothing.
    own = stage("own", _is_own_key(raw))
    form = stage("form", F.when(~own, raw))
    addressed = stage("addressed", F.substring_index(form, "#", 1))
    plain = stage("plain", is_plain(addressed))
    scheme = stage("scheme", F.lower(F.regexp_extract(addressed, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)))
    rest = stage(
        "rest",
        F.when(scheme == "", addressed).otherwise(
            F.substring(addressed, F.length(scheme) + 2, F.length(addressed))
        ),
    )
    netloc = stage("netloc", F.regexp_extract(rest, r"^//([^/?#]*)", 1))
    tail = stage(
        "tail",
        F.when(
            rest.startswith("//"), F.substring(rest, F.length(netloc) + 3, F.length(rest))
        ).otherwise(rest),
    )
    path = stage("path", F.substring_index(tail, "?", 1))
    query = stage("query", after_first(tail, "?"))
    inside = F.regexp_extract(netloc, r"\[([^\]]*)", 1)
    both = netloc.contains("[") & netloc.contains("]")
    bracket = stage("bracket", F.when(both, F.lower(inside)))
    v6 = ipv6_text(stage, F.regexp_replace(bracket, r"%[^%]+\z", ""))
    future = F.coalesce(inside.rlike(r"^v[a-fA-F0-9]+\..+\z"), F.lit(False))
    unreadable = F.coalesce(
        (netloc.contains("[") != netloc.contains("]"))
        | (bracket.isNotNull() & v6.isNull() & ~future)
        | F.when(plain, F.lit(False)).otherwise(netloc.rlike(_LOOKALIKE)),
        F.lit(False),
    )
    with_port = netloc.rlike(r":[^:\]]*\z")
    written_host = stage(
        "host",
        F.lower(F.when(with_port, F.regexp_extract(netloc, r"^(.*):[^:\]]*\z", 1)).otherwise(netloc)),
    )
    port = stage("port", F.when(with_port, F.regexp_extract(netloc, r":([^:\]]*)\z", 1)).otherwise(""))
    bracketed = written_host.startswith("[") | written_host.endswith("]")
    host = stage(
        "usable_host",
        F.when((written_host == "") | netloc.rlike("[%@]"), None)
        .when(
            bracketed,
            F.when(
                written_host == F.concat(F.lit("["), bracket, F.lit("]")),
                F.concat(F.lit("["), v6, F.lit("]")),
            ),
        )
        .when(written_host.contains(":"), None)
        .otherwise(written_host),
    )
    digits = F.regexp_replace(port, "^0+", "")
    number = stage(
        "number",
        F.when(port.rlike(r"^[0-9]+\z") & F.length(digits).between(1, 5), digits.try_cast("int")),
    )
    default_port = F.when(scheme == "https", 443).when(scheme == "http", 80)
    authority = stage(
        "authority",
        F.when((port == "") | (number == default_port), host)
        .when(number.between(1, 65535), F.concat(host, F.lit(":"), number.cast("string"))),
    )
    plain_path = stage("plain_path", _normal_escapes(path))
    flat_path = stage(
        "flat_path", F.when(plain_path == "", "/").otherwise(_without_dot_segments(plain_path))
    )
    plain_query = stage("plain_query", _normal_escapes(query))
    kept_query = stage("kept_query", _without_tracking(plain_query))
    key_query = stage("key_query", _percent_encoded(kept_query, _QUERY_SAFE, plain))
    key = stage(
        "key",
        F.concat(
            scheme, F.lit("://"), authority, _percent_encoded(flat_path, _PATH_SAFE, plain),
            F.when(key_query == "", "").otherwise(F.concat(F.lit("?"), key_query)),
        ),
    )
    stray = F.concat_ws("?", path, query).rlike("%(?![0-9A-Fa-f]{2})")
    refusal = stage(
        "refusal",
        F.when(form.isNull(), None)
        .when(F.length(form) > V.MAX_URL_LENGTH, "TOO_LONG")
        .when(
            F.when(plain, addressed.contains("\\")).otherwise(addressed.rlike(_FORBIDDEN)),
            "FORBIDDEN_CHARACTER",
        )
        .when(unreadable, "MALFORMED")
        .when(~scheme.isin(list(V.DEFAULT_PORTS)), "NOT_ABSOLUTE_HTTP")
        .when(netloc.contains("@"), "CREDENTIALS_PRESENT")
        .when(authority.isNull(), "UNUSABLE_AUTHORITY")
        .when(stray, "MALFORMED")
        .when(~is_persistable(key), "TOO_LONG"),
    )
    accepted = stage("accepted", F.when(own, raw).when(form.isNotNull() & refusal.isNull(), key))
    root = F.concat(F.substring_index(raw, "/", 3), F.lit("/"))
    origin = stage("origin", F.when(own, root).otherwise(origin_of(accepted)))
    found = F.struct(
        accepted.alias(f"{prefix}url_key"),
        refusal.alias(f"{prefix}url_refusal"),
        origin.alias(f"{prefix}origin"),
    )
    return stages, F.inline(F.array(found))


def origin_of(url_key: Column) -> Column:
    """Scheme, authority and the root slash of a canonical key; null past the origin bound."""
    origin = F.concat(F.regexp_extract(url_key, r"^(https?://[^/?#]+)", 1), F.lit("/"))
    return F.when(is_public_origin(origin), origin)


def path_of(url_key: Column) -> Column:
    return F.regexp_extract(url_key, r"^https?://[^/?#]*([^?#]*)", 1)


def query_of(url_key: Column) -> Column:
    return F.regexp_extract(url_key, r"^[^?#]*\?([^#]*)", 1)


def is_page_resource(url_key: Column) -> Column:
    """Whether the path suffix is one this method reads as a page; an unknown suffix is."""
    last = F.substring_index(path_of(url_key), "/", -1)
    suffix = F.lower(F.regexp_extract(last, r"^.+(\.[^.]*)\z", 1))
    return ~suffix.isin(V.NON_PAGE_SUFFIXES)
