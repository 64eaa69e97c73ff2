"""Which targets may be connected to, and where recorded redirect chains end."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.functions.addresses import (
    ipv4_number, ipv6_groups, ipv6_hex, is_public_hex, is_public_number,
)
from pagecensus.functions.columns import settled, stripped
from pagecensus.functions.content import joined_urls
from pagecensus.functions.url import with_url_identity
from pagecensus.session import materialised, shuffled


def with_public_flag(df: DataFrame, column: str) -> DataFrame:
    """Adds ``is_address`` and ``is_public`` for an address text; no address is not public.

    The ranges are literals in the expression, so nothing is joined.
    """
    stages: list[Column] = []

    def stage(name: str, value: Column) -> Column:
        stages.append(value.alias(f"__{name}"))
        return F.col(f"__{name}")

    groups = ipv6_groups(stage, F.regexp_replace(F.col(column), r"%[^%]+\z", ""))
    digits = stage("hex", ipv6_hex(groups))
    mapped = F.when(
        digits.startswith("0" * 20 + "ffff"),
        F.conv(F.substring(digits, 25, 8), 16, 10).try_cast("bigint"),
    )
    number = stage("number", F.coalesce(ipv4_number(F.col(column)), mapped))
    public = F.when(number.isNotNull(), is_public_number(number)).otherwise(is_public_hex(digits))
    flags = F.struct(
        (number.isNotNull() | digits.isNotNull()).alias("is_address"),
        F.coalesce(public, F.lit(False)).alias("is_public"),
    )
    kept = df.columns
    return df.select("*", *stages).select(*kept, F.inline(F.array(flags)))


def admissible_targets(targets: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Adds ``failure_kind``: null for a permitted target.

    A host is refused if any of its addresses is not public; a host without one did not resolve.
    Addresses are reduced to one verdict per host before the targets meet them.
    """
    keyed = with_url_identity(targets, "url").drop("origin")
    host = F.regexp_extract("url_key", r"^https?://(\[[^\]]*\]|[^/:?#]*)", 1)
    keyed = with_public_flag(
        keyed.withColumn("host", F.regexp_replace(host, r"^\[|\]\z", "")), "host"
    )
    verdicts = with_public_flag(resolutions, "address").groupBy(F.lower("host").alias("host")).agg(
        F.min("is_public").alias("all_public")
    )
    found = keyed.join(verdicts, "host", "left")
    return found.withColumn(
        "failure_kind",
        F.when(F.col("url_key").isNull(), "BLOCKED_TARGET")
        .when(F.col("is_address"), F.when(~F.col("is_public"), "BLOCKED_TARGET"))
        .when(F.col("all_public").isNull(), "DNS_FAILURE")
        .when(~F.col("all_public"), "BLOCKED_TARGET"),
    ).drop("is_address", "is_public", "all_public", "url_refusal")


def redirect_chains(starts: DataFrame, hops: DataFrame, max_redirects: int | None = None) -> DataFrame:
    """Follows each chain's recorded hops to its end, or to a caller's bound.

    ``starts``: chain_id, url, scope (an origin, or null for none).  ``hops``: chain_id, url,
    status, location.  A chain that redirects more often than it has hops runs in a circle, which
    is too many redirects.

    Pointers are doubled: after n rounds every URL of a chain knows where up to 2^n redirects lead
    and how many there were, so a chain of a thousand hops takes about ten rounds, and a circle is
    one whose count exceeds the chain's hops.
    """
    once = hops.groupBy("chain_id", "url").agg(
        F.min(F.struct("status", F.coalesce("location", F.lit("")).alias("location"))).alias("h")
    ).select("chain_id", F.col("url").alias("hop_url"), "h.status", stripped(F.col("h.location")).alias("location"))
    redirecting = F.col("status").isin(V.REDIRECT_STATUSES)
    target = F.get(
        joined_urls(
            F.col("hop_url"), F.when(redirecting & (F.col("location") != ""), F.array("location"))
        ),
        F.lit(0),
    )
    answers = materialised(settled(once.withColumn("next_url", target), ["next_url"]))
    stretches = _stretches(starts, answers)
    while not stretches.where("open").isEmpty():
        stretches = materialised(_doubled(stretches))
    last = F.lit(max_redirects).cast("long")
    met = starts.join(
        shuffled(stretches.toDF(*[f"__{c}" for c in stretches.columns])),
        (F.col("chain_id") == F.col("__chain_id")) & F.col("scope").eqNullSafe(F.col("__scope")) & (F.col("url") == F.col("__url")), "left",
    )
    circle = F.col("__end").isNull() & F.col("__to").isNotNull()
    count = F.when(circle, F.col("__hops")).otherwise(F.coalesce("__count", F.lit(0)))
    beyond = last.isNotNull() & ((count > last) | ((count == last) & F.col("__late")))
    outcome = F.when(circle | F.coalesce(beyond, F.lit(False)), "TOO_MANY_REDIRECTS").otherwise(F.coalesce("__end", F.lit("BLOCKED_TARGET")))
    arrived = F.col("outcome") == "RESPONSE_RECEIVED"
    return met.withColumn("outcome", outcome).select(
        "chain_id", "url", "outcome", F.least(count, last).cast("int").alias("redirect_count"),
        F.when(arrived, F.col("__to")).alias("final_url"), F.when(arrived, F.col("__status")).alias("final_status"),
    )


def _stretches(starts: DataFrame, answers: DataFrame) -> DataFrame:
    """Every URL of every chain with the stretch that begins there: one redirect, or none at an end.

    ``to`` is where it leads, ``count`` its redirects, ``end`` the verdict there (null while it goes
    on), ``late`` whether that verdict gives way to the bound, ``open`` whether it may go on.
    """
    groups = starts.select("chain_id", "scope").distinct()
    urls = starts.select("chain_id", "url").unionByName(
        answers.select("chain_id", F.explode(F.array("hop_url", "next_url")).alias("url"))
    ).where("url is not null").distinct()
    sizes = answers.groupBy("chain_id").agg(F.count("*").alias("hops"))
    nodes = with_url_identity(urls, "url").join(shuffled(groups), "chain_id").join(
        shuffled(answers.withColumnRenamed("hop_url", "url")), ["chain_id", "url"], "left"
    ).join(shuffled(sizes), "chain_id", "left")
    off_scope = F.col("scope").isNotNull() & ~F.col("origin").eqNullSafe(F.col("scope"))
    absolute = F.coalesce(F.col("next_url").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(False))
    end = (
        F.when(off_scope | F.col("url_key").isNull(), "BLOCKED_TARGET")
        .when(F.col("status").isNull(), "CONNECTION_FAILURE")
        .when(~F.col("status").isin(V.REDIRECT_STATUSES), "RESPONSE_RECEIVED")
        .when((F.col("location") == "") | ~absolute, "INVALID_REDIRECT")
    )
    judged = settled(nodes.withColumns({"end": end, "late": (F.col("location") != "") & ~absolute}), ["end", "late"])
    goes_on = F.col("end").isNull()
    return materialised(_with_ends(judged.select(
        "chain_id", "scope", "url", "hops", F.when(goes_on, F.col("next_url")).otherwise(F.col("url")).alias("to"),
        goes_on.cast("long").alias("count"), F.col("end").alias("own"), F.col("status").alias("own_status"),
        (~goes_on & F.coalesce("late", F.lit(False)) & (F.col("end") == "INVALID_REDIRECT")).alias("own_late"),
    )))


_KEY = ["chain_id", "scope"]


def _met(stretches: DataFrame, names: list[str]) -> DataFrame:
    """Stretches joined with what is known of the URL they lead to."""
    there = stretches.select(*_KEY, "url", *names).toDF("__chain", "__scope", "__at", *[f"__{n}" for n in names])
    same = (F.col("chain_id") == F.col("__chain")) & F.col("scope").eqNullSafe(F.col("__scope")) & (F.col("to") == F.col("__at"))
    return stretches.join(shuffled(there), same, "left")


def _with_ends(stretches: DataFrame) -> DataFrame:
    met = _met(stretches, ["own", "own_status", "own_late"])
    return met.select(
        *stretches.columns, F.col("__own").alias("end"), F.col("__own_status").alias("status"), F.col("__own_late").alias("late"),
        (F.col("__own").isNull() & (F.col("count") <= F.col("hops"))).alias("open"),
    )


def _doubled(stretches: DataFrame) -> DataFrame:
    """Stretches that go on are prolonged by the one that begins where they end."""
    met = _met(stretches, ["to", "count", "end", "status", "late"])
    longer = F.col("open")
    return met.select(
        *_KEY, "url", "hops", F.when(longer, F.col("__to")).otherwise(F.col("to")).alias("to"),
        F.when(longer, F.col("count") + F.col("__count")).otherwise(F.col("count")).alias("count"), "own", "own_status", "own_late",
        *[F.when(longer, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("end", "status", "late")],
    ).withColumn("open", F.col("end").isNull() & (F.col("count") <= F.col("hops")))
