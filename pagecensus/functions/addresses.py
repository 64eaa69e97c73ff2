"""IP addresses as columns: canonical IPv6 text, and whether an address is a public destination."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V

_OCTET = "(0|[1-9][0-9]{0,2})"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"
_GROUPS = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"


def _octets(text: Column, pattern: str, first: int) -> list[Column]:
    """The four octets as numbers; an unmatched text gives nulls."""
    return [F.regexp_extract(text, pattern, first + i).try_cast("long") for i in range(4)]


def ipv4_number(text: Column) -> Column:
    """The address as a number; null when the text is not a dotted quad without leading zeros."""
    a, b, c, d = _octets(text, _IPV4, 1)
    small = (a <= 255) & (b <= 255) & (c <= 255) & (d <= 255)
    return F.when(text.rlike(_IPV4) & small, ((a * 256 + b) * 256 + c) * 256 + d)


Stage = Callable[[str, Column], Column]


def ipv6_groups(stage: Stage, text: Column) -> Column:
    """The eight groups of an IPv6 text without leading zeros; null when it is none.

    ``stage`` names an intermediate column, so that no step repeats the one before it.
    """
    text = stage("v6_source", F.lower(text))
    tail = rf"^(.*:){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"
    a, b, c, d = _octets(text, tail, 2)
    dotted = text.rlike(tail) & (a <= 255) & (b <= 255) & (c <= 255) & (d <= 255)
    as_groups = F.concat(
        F.regexp_extract(text, tail, 1),
        F.lower(F.hex(a * 256 + b)),
        F.lit(":"),
        F.lower(F.hex(c * 256 + d)),
    )
    plain = stage("v6_plain", F.when(~text.contains("."), text).when(dotted, as_groups))

    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    left = stage("v6_left", groups(F.substring_index(plain, "::", 1)))
    right = stage("v6_right", groups(F.substring_index(plain, "::", -1)))
    missing = F.lit(8) - F.size(left) - F.size(right)
    full = F.when(
        plain.rlike(r"^[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}\z"), F.split(plain, ":")
    ).when(
        plain.rlike(rf"^(?:{_GROUPS})?::(?:{_GROUPS})?\z") & (missing >= 1),
        F.concat(left, F.array_repeat(F.lit("0"), missing), right),
    )
    return stage("v6_groups", F.transform(full, lambda g: F.regexp_replace(g, "^0+(?=.)", "")))


def ipv6_text(stage: Stage, text: Column) -> Column:
    """The compressed canonical form of an IPv6 text; null when it is none."""
    groups = ipv6_groups(stage, text)
    joined = stage("v6_joined", F.array_join(groups, ":"))
    high = F.conv(F.get(groups, F.lit(6)), 16, 10).try_cast("int")
    low = F.conv(F.get(groups, F.lit(7)), 16, 10).try_cast("int")
    octets = [F.floor(high / 256), high % 256, F.floor(low / 256), low % 256]
    mapped = F.concat(F.lit("::ffff:"), F.concat_ws(".", *[o.cast("string") for o in octets]))
    shortest = F.when(joined.rlike("^(?:0:){5}ffff:"), mapped)
    for run in range(8, 1, -1):
        zeros = r"(?<![0-9a-f])0(?::0){%d}(?![0-9a-f])" % (run - 1)
        shortest = shortest.when(
            joined.rlike(zeros), F.regexp_replace(joined, rf"^(.*?):?{zeros}:?(.*)\z", "$1::$2")
        )
    return stage("v6_text", shortest.otherwise(joined))


def ipv6_hex(groups: Column) -> Column:
    """Thirty-two hex digits, so that text order is address order."""
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")


def _in_ipv4(number: Column, blocks: list[str]) -> Column:
    nets = [ipaddress.ip_network(block) for block in blocks]
    hits = [number.between(int(n.network_address), int(n.broadcast_address)) for n in nets]
    return _any(hits)


def _in_ipv6(text: Column, blocks: list[str]) -> Column:
    nets = [ipaddress.ip_network(block) for block in blocks]
    hits = [
        text.between(n.network_address.packed.hex(), n.broadcast_address.packed.hex()) for n in nets
    ]
    return _any(hits)


def _any(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def is_public_number(number: Column) -> Column:
    """Whether an IPv4 number lies outside every special-purpose range."""
    return ~_in_ipv4(number, V.NON_PUBLIC_IPV4) | _in_ipv4(number, V.PUBLIC_IPV4_EXCEPTIONS)


def is_public_hex(text: Column) -> Column:
    return ~_in_ipv6(text, V.NON_PUBLIC_IPV6) | _in_ipv6(text, V.PUBLIC_IPV6_EXCEPTIONS)
