"""Discovery sources as jobs: seed-page links, robots declarations, sitemap trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.functions.columns import is_persistable, lookup, media_type, settled, stripped
from pagecensus.functions.content import decoded_text, joined_urls
from pagecensus.functions.html import with_page
from pagecensus.functions.sitemap import with_sitemap
from pagecensus.functions.url import with_url_identity
from pagecensus.session import materialised
from pagecensus.sources.captures import status_source_outcome

_LINES = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"


def _unanswered() -> Column:
    """Why a capture cannot be read as a source at all; null when it can."""
    return F.coalesce(
        lookup(V.SOURCE_OUTCOME_OF_FAILURE, F.col("failure_kind")),
        F.when(F.col("failure_kind").isNotNull(), F.lit("RUNTIME_ERROR")),
        status_source_outcome(F.col("status_code")),
    )


def _latest(read: DataFrame, keys: list[str], ties: list[Column]) -> DataFrame:
    """The latest of several captures of one thing; the row-number filter is a group limit before
    the shuffle.  Captures without a time are ordered by what was read."""
    order = Window.partitionBy(*keys).orderBy(F.desc("captured_at"), *ties)
    return read.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "captured_at")


def of_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the given runs, under the site each run has established."""
    return rows.drop("site").join(runs.select("run_id", "site"), "run_id")


def _captured_at(captures: DataFrame) -> Column:
    named = "captured_at" in captures.columns
    return (F.col("captured_at") if named else F.lit(None).cast("timestamp")).alias("captured_at")


def seed_page_links(
    seed_captures: DataFrame, max_links: int | None = None, max_examined: int | None = None,
    runs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The seed document of each run (its latest capture) -> (link observations, source attempts).

    Every link of the own origin is observed: that of the capture's site, or of the established run
    where ``runs`` are given.  A caller's bound ends the reading of a document where the first
    target beyond it stands.
    """
    media = media_type(F.col("content_type"))
    blocked = F.coalesce(
        _unanswered(),
        F.when(media.isNotNull() & ~media.isin(V.DOCUMENT_MEDIA_TYPES), F.lit("MALFORMED")),
        F.when(F.col("undecodable"), F.lit("RUNTIME_ERROR")),
    )
    timed = seed_captures.withColumns({"__blocked": blocked, "captured_at": _captured_at(seed_captures)})
    read = with_page(
        settled(timed, ["__blocked"]), F.when(F.col("__blocked").isNull(), F.col("body")),
        F.col("declared_charset"), F.col("final_url"), links=True,
    ).select("run_id", "site", "truncated", "__blocked", "page", "captured_at")
    read = _latest(read, ["run_id"], [F.col("site"), F.col("__blocked"), F.xxhash64("page")])
    read = materialised(read if runs is None else of_runs(read, runs))
    links = read.select("run_id", "site", F.explode("page.links").alias("l")).select(
        "run_id", "site", "l.pos", "l.href", "l.label"
    )
    targets = links.groupBy("run_id", "site", "href").agg(F.min("pos").alias("pos"))
    judged = materialised(with_url_identity(targets, "href").withColumn(
        "admissible",
        F.coalesce(F.col("origin") == F.col("site"), F.lit(False)) & is_persistable(F.col("href")),
    ))
    admissible = judged.where("admissible")
    stops = _bounds(judged, max_examined).unionByName(_bounds(admissible, max_links))
    stops = stops.groupBy("run_id").agg(F.min("pos").alias("stop"))
    observations = (
        links.join(admissible.select("run_id", "href"), ["run_id", "href"])
        .join(stops, "run_id", "left")
        .where(F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
        .select(
            "run_id", "site", F.col("href").alias("observed_form"), F.lit(V.LINK_SOURCE).alias("source_id"),
            "label",
        )
        .distinct()
    )
    outcome = (
        F.when(F.col("__blocked").isNotNull(), F.col("__blocked"))
        .when(~F.coalesce("page.readable", F.lit(False)), "RUNTIME_ERROR")
        .when(F.col("stop").isNotNull() | F.col("truncated"), "BUDGET_EXHAUSTED")
        .when(F.size("page.links") > 0, "USED")
        .otherwise("EMPTY")
    )
    attempts = read.join(stops, "run_id", "left").select(
        "run_id", "site", F.lit(V.LINK_SOURCE).alias("source_id"), outcome.alias("outcome")
    )
    return observations, attempts


def _bounds(targets: DataFrame, most: int | None) -> DataFrame:
    """Where the first target beyond a bound stands; a group limit keeps each run to its bound."""
    if most is None:
        return targets.select("run_id", "pos").limit(0)
    order = Window.partitionBy("run_id").orderBy("pos")
    return targets.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most + 1).where(
        F.col("n") == most + 1
    ).select("run_id", "pos")


def robots_declarations(robots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """robots.txt captures -> (declared sitemap URLs with their place, source attempts).

    Only the ``Sitemap`` field of a run's latest capture is read.  UTF-8 bodies are decoded in the
    JVM.  Whether a body is text at all is judged on its bytes.
    """
    charset = F.lower(F.coalesce("declared_charset", F.lit("utf-8")))
    plain = charset.isin("utf-8", "utf8")
    text = F.coalesce(
        F.when(plain, F.make_valid_utf8(F.col("body").cast("string"))),
        decoded_text(F.when(~plain, F.col("body")), F.col("declared_charset")),
    )
    blocked = F.coalesce(_unanswered(), F.when(F.col("undecodable"), F.lit("RUNTIME_ERROR")))
    raw = F.col("body").cast("string")
    malformed = (
        F.coalesce(media_type(F.col("content_type")).isin(V.DOCUMENT_MEDIA_TYPES), F.lit(False))
        | raw.rlike(r"(?i)^\s*(?:<!doctype\s+html|<html)")
        | raw.contains("\u0000")
    )
    base = robots.withColumns({
        "__text": text, "__blocked": blocked, "__malformed": malformed, "captured_at": _captured_at(robots),
    })
    base = settled(base.drop("body"), ["__text", "__blocked", "__malformed"])
    base = _latest(base, ["run_id"], [F.col("site"), F.col("__blocked"), F.col("__text")])
    lines = F.transform(
        F.split(F.regexp_replace("__text", r"^\uFEFF", ""), _LINES),
        lambda line: F.substring_index(line, "#", 1),
    )

    def value_of(line: Column) -> Column:
        return stripped(F.substring(line, F.instr(line, ":") + 1, F.length(line)))

    fields = F.filter(
        lines,
        lambda line: line.contains(":")
        & (F.lower(stripped(F.substring_index(line, ":", 1))) == "sitemap")
        & (value_of(line) != ""),
    )
    readable = F.col("__blocked").isNull() & ~F.col("__malformed")
    found = base.withColumn("__values", F.when(readable, F.transform(fields, value_of)))
    found = found.withColumn("__urls", joined_urls(F.col("final_url"), F.col("__values")))
    resolved = F.array_compact("__urls")
    outcome = (
        F.when(F.col("__blocked").isNotNull(), F.col("__blocked"))
        .when(F.col("__malformed"), "MALFORMED")
        .when(F.col("truncated"), "BUDGET_EXHAUSTED")
        .when(F.size(resolved) > 0, "USED")
        .when(F.size("__values") > 0, "MALFORMED")
        .otherwise("NO_SITEMAP_DECLARATION")
    )
    done = settled(found.withColumns({"outcome": outcome, "__resolved": resolved}), ["outcome", "__resolved"])
    declared = done.select("run_id", "site", F.posexplode("__resolved").alias("pos", "declared_url"))
    attempts = done.select("run_id", "site", F.lit(V.ROBOTS_SOURCE).alias("source_id"), "outcome")
    return declared, attempts


def sitemap_documents(bodies: DataFrame) -> DataFrame:
    """Sitemap captures -> one narrow row per document: key, outcome, root and locations."""
    keyed = with_url_identity(bodies, "requested_url", "doc_").drop("doc_url_refusal", "doc_origin")
    blocked = F.coalesce(_unanswered(), F.when(F.col("undecodable"), F.lit("RUNTIME_ERROR")))
    timed = keyed.withColumns({"__blocked": blocked, "captured_at": _captured_at(bodies)})
    read = with_sitemap(
        settled(timed, ["__blocked"]), F.when(F.col("__blocked").isNull(), F.col("body")), F.col("truncated")
    )
    done = read.select(
        "run_id", F.col("doc_url_key").alias("doc_key"), "captured_at",
        F.coalesce("__blocked", F.col("sitemap.verdict")).alias("outcome"),
        F.col("sitemap.root").alias("root"), F.col("sitemap.locs").alias("locs"),
    )
    # A document captured several times speaks once: as it was last.
    return _latest(settled(done, ["outcome", "root", "locs"]), ["run_id", "doc_key"], [F.col("outcome"), F.col("root"), F.col("locs")])


def sitemap_tree(
    runs: DataFrame, declared: DataFrame, bodies: DataFrame,
    max_documents: int | None = None, max_entries: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Declared sitemaps and their children -> (entry observations, source attempts).

    Documents are followed level by level until a level names no new one.  A caller's bound on
    documents is that of one first-in-first-out queue per run, one on entries cuts them by rank.
    """
    documents = materialised(sitemap_documents(bodies))
    named = documents.where("root = 'sitemapindex'").select(
        "run_id", "doc_key", F.posexplode("locs").alias("pos", "loc")
    ).join(runs.select("run_id", "site"), "run_id")
    children = materialised(_keyed_references(named, "loc"))
    first = _keyed_references(
        declared.select("run_id", "site", F.lit("").alias("doc_key"), "pos", F.col("declared_url").alias("loc")), "loc"
    )
    first = materialised(first.withColumn("parent", F.lit(0)))
    level, spilled = _planned(first, None, max_documents)
    # Declarations after the one that overflowed the queue were never looked at.
    stops = spilled.groupBy("run_id").agg(F.min("pos").alias("stop"))
    refused = first.where("not inside").join(stops, "run_id", "left").where(
        F.col("stop").isNull() | (F.col("pos") < F.col("stop"))
    ).select("run_id", "parent")
    conventional = runs.join(level.select("run_id").distinct(), "run_id", "left_anti").select(
        "run_id", F.concat("site", F.lit("sitemap.xml")).alias("key"), F.lit(1).alias("idx")
    )
    level = materialised(level.unionByName(conventional))
    queue, overflow = level, spilled.select("run_id", "parent")
    while not level.isEmpty():
        met = level.select("run_id", F.col("key").alias("doc_key"), F.col("idx").alias("parent")).join(
            children, ["run_id", "doc_key"]
        )
        refused = refused.unionByName(met.where("not inside").select("run_id", "parent"))
        level, spilled = _planned(met, queue, max_documents)
        level = materialised(level)
        overflow = overflow.unionByName(spilled.select("run_id", "parent"))
        queue = queue.unionByName(level)
    return _read_in_order(runs, materialised(queue), documents, refused, overflow, max_entries)


def _keyed_references(references: DataFrame, column: str) -> DataFrame:
    keyed = with_url_identity(references, column).where("url_key is not null")
    return keyed.select(
        "run_id", "doc_key", "pos", F.col("url_key").alias("key"),
        F.coalesce(F.col("origin") == F.col("site"), F.lit(False)).alias("inside"),
    )


def _planned(references: DataFrame, queue: DataFrame | None, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """New same-origin documents in order: those that fit the queue, and those that do not."""
    fresh = references.where("inside")
    if queue is not None:
        fresh = fresh.join(queue.select("run_id", "key"), ["run_id", "key"], "left_anti")
    fresh = fresh.groupBy("run_id", "key").agg(F.min(F.struct("parent", "pos")).alias("at")).select(
        "run_id", "key", "at.parent", "at.pos"
    )
    if limit is None:  # places in the queue matter to its bound only; a level's documents share one
        return (
            fresh.select("run_id", "key", (F.col("parent") + 1).cast("int").alias("idx")),
            fresh.select("run_id", "parent", "pos").limit(0),
        )
    order = Window.partitionBy("run_id").orderBy("parent", "pos")
    ranked = fresh.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit + 1)
    if queue is not None:
        taken = queue.groupBy("run_id").agg(F.max("idx").alias("taken"))
        ranked = ranked.join(taken, "run_id").withColumn("idx", F.col("n") + F.col("taken"))
    else:
        ranked = ranked.withColumn("idx", F.col("n"))
    return (
        ranked.where(F.col("idx") <= limit).select("run_id", "key", "idx"),
        ranked.where(F.col("idx") > limit).select("run_id", "parent", "pos"),
    )


def _read_in_order(runs, queue, documents, refused, overflow, max_entries) -> tuple[DataFrame, DataFrame]:
    # Documents are told their site, so that the far more numerous entries meet no other table.
    sites = runs.select("run_id", "site")
    queue = queue.join(sites, "run_id")
    read = queue.join(documents, (queue["run_id"] == documents["run_id"]) & (queue["key"] == documents["doc_key"]), "left").select(
        queue["run_id"], "site", "idx", F.coalesce("outcome", F.lit("PROVIDER_FAILURE")).alias("outcome"), "root", "locs"
    )
    listed = read.where("root is null or root <> 'sitemapindex'").select(
        "run_id", "site", "idx", F.posexplode("locs").alias("pos", "form")
    )
    if max_entries is None:  # where a form stands matters to a bound only
        kept = _entry_forms(listed.select("run_id", "site", "form").distinct())
        beyond, spent = kept.select("run_id").limit(0), read.select("run_id", F.col("idx").alias("last")).limit(0)
    else:
        firsts = listed.groupBy("run_id", "site", "form").agg(F.min(F.struct("idx", "pos")).alias("at"))
        order = Window.partitionBy("run_id").orderBy("at")
        ranked = materialised(
            _entry_forms(firsts).withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_entries + 1)
            .select("run_id", "site", "form", "n", F.col("at.idx").alias("idx"))
        )
        # Once the budget is spent, no later document is read.
        spent = ranked.where(F.col("n") == max_entries).select("run_id", F.col("idx").alias("last"))
        kept, beyond = ranked.where(F.col("n") <= max_entries), ranked.where(F.col("n") > max_entries).select("run_id")
    within = read.join(spent, "run_id", "left")
    unread = F.col("last").isNotNull() & (F.col("idx") > F.col("last"))
    seen = within.where(~F.coalesce(unread, F.lit(False)))

    def of_read(flags: DataFrame) -> DataFrame:
        return flags.join(spent, "run_id", "left").where(
            F.col("last").isNull() | (F.col("parent") <= F.col("last"))
        ).select("run_id")

    cut = (
        of_read(overflow)
        .unionByName(within.where(unread).select("run_id"))
        .unionByName(beyond)
    )
    voices = seen.select("run_id", "outcome").unionByName(cut.withColumn("outcome", F.lit("BUDGET_EXHAUSTED")))
    outcome = source_outcome(voices)
    turned_away = of_read(refused).unionByName(
        seen.where("outcome = 'TARGET_POLICY_REFUSED'").select("run_id")
    ).distinct()
    attempts = sites.join(outcome, "run_id").select(
        "run_id", "site", F.lit(V.SITEMAP_SOURCE).alias("source_id"), "outcome"
    ).unionByName(
        sites.join(turned_away, "run_id").select(
            "run_id", "site", F.lit(V.REFUSED_SITEMAP_SOURCE).alias("source_id"),
            F.lit("TARGET_POLICY_REFUSED").alias("outcome"),
        )
    )
    entries = kept.select(
        "run_id", "site", F.col("form").alias("observed_form"), F.lit(V.SITEMAP_SOURCE).alias("source_id"),
        F.lit(None).cast("string").alias("label"),
    )
    return entries, attempts


def _entry_forms(forms: DataFrame) -> DataFrame:
    """The written forms that may be recorded and have an identity; a form that is its own key may."""
    keyed = with_url_identity(forms.where(F.length("form") <= V.MAX_URL_LENGTH), "form")
    return keyed.where(F.col("url_key").isNotNull() & ((F.col("url_key") == F.col("form")) | is_persistable(F.col("form"))))


def source_outcome(reads: DataFrame) -> DataFrame:
    """Many reads of one source -> the outcome that speaks for it, by fixed precedence."""
    ranks = {name: str(no) for no, name in enumerate(V.OUTCOME_PRECEDENCE)}
    rank = lookup(ranks, F.col("outcome")).cast("int")
    best = reads.groupBy("run_id").agg(F.min(rank).alias("rank"))
    return best.select(
        "run_id",
        F.get(F.array(*[F.lit(o) for o in V.OUTCOME_PRECEDENCE]), F.col("rank")).alias("outcome"),
    )
