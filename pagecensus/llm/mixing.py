"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents may belong to several sources.  Those with the same set of sources are one pattern, and
only the patterns' word totals reach the driver: a pattern's words flow to the quotas of its
sources, once at no cost, again at a cost that grows with each repetition.  What flows out of a
pattern says how often all of its documents are taken and how many words are left to choose.  These
are filled in passes: each takes, of the documents no larger than what is left, those with the
lowest seeded hashes, until no document fits; then documents already taken are passed over again in
the same way, as often as they may be repeated.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecensus.llm.common import as_row, whole, word_count
from pagecensus.session import materialised

MAX_REPEATS = 3
#: Patterns up to which what is decided of each is broadcast; beyond, it meets the rows in a shuffle.
BROADCAST_PATTERNS = 4096
#: Hash ranges in which a pattern's words are summed before the last range is looked at by row.
RANGE_BITS = 16
LAST_HASH = (1 << 63) - 1


def shared_targets(sizes: list[int], weights: list[int], total: int, most: int) -> list[Fraction]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared anew."""
    targets: list[Fraction | None] = [None] * len(sizes)
    left, open_ = Fraction(total), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = Fraction(most * sizes[i])
            left -= targets[i]
        open_ -= full
    return targets


def routed(tokens: list[int], members: list[list[int]], quotas: list[int], repeats: int) -> list[int]:
    """Words that leave each pattern in a cheapest largest flow.

    Arcs: start to pattern once per repetition (capacity its words, cost the repetitions before),
    pattern to each of its sources, source to end (capacity its quota).
    """
    patterns = len(tokens)
    end = 1 + patterns + len(quotas)
    to, room, cost, out = [], [], [], [[] for _ in range(end + 1)]

    def arc(a: int, b: int, most: int, price: int) -> None:
        for x, y, r, c in ((a, b, most, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(c)

    for p, words in enumerate(tokens):
        for again in range(repeats):
            arc(0, 1 + p, words, again)
        for source in members[p]:
            arc(1 + p, 1 + patterns + source, repeats * words, 0)
    for source, quota in enumerate(quotas):
        arc(1 + patterns + source, end, quota, 0)
    level = [0] * (end + 1)  # prices that keep every open arc's reduced cost at 0 or more
    while True:
        far: list[float] = [float("inf")] * (end + 1)
        came = [-1] * (end + 1)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                if room[e] and (there := d + cost[e] + level[x] - level[to[e]]) < far[to[e]]:
                    far[to[e]], came[to[e]] = there, e
                    heapq.heappush(heap, (there, to[e]))
        if far[end] == float("inf"):
            break
        level = [v + (f if f < float("inf") else far[end]) for v, f in zip(level, far)]
        path, x = [], end
        while x:
            path.append(came[x])
            x = to[came[x] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step
    return [sum(room[e ^ 1] for e in out[1 + p] if to[e] != 0 and not e & 1) for p in range(patterns)]


def allotted(tokens: list[int], members: list[list[int]], quotas: list[int], repeats: int) -> list[int]:
    """The flow of every pattern, by independent networks.

    Sources that no pattern joins have networks of their own.  A pattern that is alone with its only
    source needs none: it gives what its quota and its repetitions allow.
    """
    parent = list(range(len(quotas)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for held in members:
        for other in held[1:]:
            parent[root(other)] = root(held[0])
    networks: dict[int, list[int]] = {}
    for p, held in enumerate(members):
        if held:
            networks.setdefault(root(held[0]), []).append(p)
    flows = [0] * len(tokens)
    for patterns in networks.values():
        if len(patterns) == 1 and len(members[patterns[0]]) == 1:
            p = patterns[0]
            flows[p] = min(repeats * tokens[p], quotas[members[p][0]])
            continue
        local = {s: i for i, s in enumerate(sorted({s for p in patterns for s in members[p]}))}
        found = routed([tokens[p] for p in patterns], [[local[s] for s in members[p]] for p in patterns], [quotas[s] for s in local], repeats)
        for p, flow in zip(patterns, found):
            flows[p] = flow
    return flows


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_PATTERNS else table


def _sized(docs: DataFrame, sources: Column, id_col: str, text_col: str, seed: int) -> DataFrame:
    """row, size, pattern (its distinct sources as JSON) and a hash of 63 bits per row."""
    named = docs.select(as_row(docs), F.array_sort(F.array_distinct(sources)).alias("members"))
    return named.select(
        "row",
        word_count(whole(F.col("row").getField(text_col))).alias("size"),
        F.to_json("members").alias("pattern"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("row").getField(id_col)), 1).alias("hash"),
    )


def _plan(sized: DataFrame, repeats: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(how to take each pattern, words of the identifiers with several rows, the sources with their
    sizes and targets); the first and the last are small."""
    spark = sized.sparkSession
    rows = materialised(sized.select("pattern", "size", "hash"))
    totals = rows.groupBy("pattern").agg(F.sum("size").alias("words")).collect()  # a row per set of sources
    totals.sort(key=lambda r: r.pattern)
    sets = [json.loads(r.pattern) for r in totals]
    names = sorted({s for found in sets for s in found}, key=lambda s: (s is None, (s or "").encode()))
    number = {s: i for i, s in enumerate(names)}
    members = [[number[s] for s in found] for found in sets]
    tokens = [r.words for r in totals]
    sizes = [0] * len(names)
    for words, held in zip(tokens, members):
        for i in held:
            sizes[i] += words
    targets = shared_targets(sizes, [1 + i % 3 for i in range(len(names))], sum(tokens), repeats)
    flow = allotted(tokens, members, [int(t) for t in targets], repeats)
    takes = [_Take(r.pattern, *(divmod(f, words) if words else (0, 0))) for r, words, f in zip(totals, tokens, flow)]
    shares = spark.createDataFrame([(t.pattern,) for t in takes if t.gap], "pattern string")
    items = materialised(
        rows.where("size > 0").join(_small(shares, len(takes)), "pattern")
        .groupBy("pattern", "hash").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    )
    _fill(items, takes, repeats)
    take = spark.createDataFrame([(t.pattern, t.copies, t.passes) for t in takes], f"pattern string, copies long, {_PASSES}")
    together = materialised(items.where("rows > 1").select("pattern", "hash", F.col("size").alias("together")))
    known = spark.createDataFrame(
        [(s, n, float(t)) for s, n, t in zip(names, sizes, targets)],
        "source string, source_size long, target double",
    )
    return _small(take, len(takes)), together, known


_PASSES = "passes array<struct<level: int, most: long, cut: long>>"


@dataclass
class _Take:
    """How a pattern is taken: all of it ``copies`` times, ``gap`` words by ``passes``.

    A pass (level, most, cut) takes the documents of up to ``most`` words with hashes up to ``cut``
    that the level below has taken and no earlier pass of its own level.
    """

    pattern: str
    copies: int
    gap: int
    level: int = 1
    passes: list[tuple[int, int, int]] = field(default_factory=list)


def _taken(level: Column | int) -> Column:
    """Whether a pass of this level takes a document of ``size`` words and this ``hash``."""
    return F.exists(
        "passes", lambda p: (p["level"] == level) & (F.col("size") <= p["most"]) & (F.col("hash") <= p["cut"])
    )


def _fill(items: DataFrame, takes: list[_Take], repeats: int) -> None:
    """Adds passes until no document of a pattern fits its gap; only sums by pattern reach the driver.

    A pass sums a pattern's words in hash ranges, and looks at the rows of one range only.  Each
    leaves less than the document it stopped at, so their number grows with the logarithm of a size.
    """
    spark, shift = items.sparkSession, 63 - RANGE_BITS
    up_to = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    by_hash = Window.partitionBy("pattern").orderBy("hash")
    while open_ := {t.pattern: t for t in takes if t.gap and t.copies + t.level <= repeats}:
        now = spark.createDataFrame(
            [(t.pattern, t.gap, t.level, t.passes) for t in open_.values()], f"pattern string, gap long, level int, {_PASSES}"
        )
        below = (F.col("level") == 1) | _taken(F.col("level") - 1)
        fitting = items.join(_small(now, len(open_)), "pattern").where("size <= gap").where(below & ~_taken(F.col("level"))).select(
            "pattern", "gap", "hash", "size", F.shiftright("hash", shift).alias("part")
        )
        edges = (
            fitting.groupBy("pattern", "gap", "part").agg(F.sum("size").alias("words"))
            .withColumn("until", F.sum("words").over(up_to))
            .groupBy("pattern").agg(
                F.max(F.when(F.col("until") <= F.col("gap"), F.col("until"))).alias("before"),
                F.min(F.when(F.col("until") > F.col("gap"), F.col("part"))).alias("part"),
            ).collect()
        )
        cut = [(e.pattern, e.part, e.before or 0) for e in edges if e.part is not None]
        inside = (
            fitting.join(_small(spark.createDataFrame(cut, "pattern string, part long, before long"), len(cut)), ["pattern", "part"])
            .withColumn("until", F.col("before") + F.sum("size").over(by_hash))
            .where("until <= gap")
            .groupBy("pattern").agg(F.max("hash").alias("last"), F.max("until").alias("until"))
        ).collect() if cut else []
        last = {r.pattern: (r.last, r.until) for r in inside}
        for e in edges:
            t = open_.pop(e.pattern)
            if e.part is None:
                hash_, words = LAST_HASH, e.before
            else:
                hash_, words = last.get(e.pattern, ((e.part << shift) - 1, e.before))
            t.passes.append((t.level, t.gap, hash_))
            t.gap -= words
        for t in open_.values():  # nothing fits
            t.level += 1


def mix(
    docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
    repeats: int = MAX_REPEATS,
) -> tuple[DataFrame, DataFrame]:
    """How often each document enters the mix, and what the sources were to get.

    ``sources``: array of the sources a row belongs to, null among them a source of its own (last in
    order).  Sources in code point order weigh 1, 2, 3, repeating, and share all words; none gets
    more than ``repeats`` times its own.  Returns

    * one row per input row: ``row`` (struct of all input columns), ``size`` (words), ``pattern``,
      ``times`` (0 to ``repeats``),
    * one row per source: ``source``, ``source_size``, ``target``.

    Null and empty texts have no words and are never taken.  Rows of one identifier share a hash and
    so a decision.  The same rows and seed give the same mix; empty tables give empty results.
    A row without any source is never taken.
    """
    sized = _sized(docs, sources, id_col, text_col, seed)
    plan, together, known = _plan(sized, repeats)
    held, again = F.lit(True), F.lit(0).cast("long")
    for level in range(1, repeats + 1):
        held = held & _taken(level)
        again = again + held.cast("long")
    times = F.when(F.col("own") > 0, F.col("copies") + again).otherwise(0)
    placed = sized.join(together, ["pattern", "hash"], "left").join(plan, "pattern", "left")
    taken = placed.withColumn("own", F.col("size")).withColumn("size", F.coalesce("together", "size")).select(
        "row", F.col("own").alias("size"), "pattern", F.coalesce(times, F.lit(0)).alias("times")
    )
    return taken, known


def mixed(docs: DataFrame, sources: Column, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the input's columns."""
    taken, _ = mix(docs, sources, **options)
    return taken.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
