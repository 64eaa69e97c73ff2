"""Exact top-k by inner product as a Voronoi kNN join.

Pivots part the space into cells; queries and data are grouped by their nearest pivot.  Each data
cell has a summary (radius around the pivot, longest vector) and a few members nearest to its pivot.
Scoring a query against all summaries' members gives a lower bound of its k-th score; the summary
gives an upper bound of what a cell can score.  A vector goes to a query group only if its cell and
then the vector itself can still reach the group's lowest bound.  Groups and cells are cut into
blocks, so a common vector or a large cell spreads over many tasks; each pair of blocks is scored
by one matrix product, and only k rows per query and block leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecensus.session import materialised

#: Queries and vectors of one block at most, on average; both sides of a matrix product in a task.
QUERY_BLOCK = 4096
DATA_BLOCK = 16384
#: Pivots; the driver holds a bound per pair of them at most, and k + 1 vectors of each.
LEAST_PIVOTS, MOST_PIVOTS = 8, 512
#: Rows of a matrix product held at once.
SLICE = 256
#: Relative slack of the bounds against rounding; it can only let more vectors through.
SLACK = 1e-9
#: Whole numbers below this are exact as doubles; so are products and sums that stay below it.
EXACT = 1 << 53
#: Below every score, by kind of number.
_LEAST = {"f": -np.inf, "i": np.iinfo("int64").min, "O": -(1 << 200)}


def scaled(vector: Column) -> Column:
    """floor(256 x) of each component as double; null if one is null, not finite or 2^53 or more."""
    grown = F.transform(vector, lambda x: x.cast("double") * 256)
    fits = F.forall(grown, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(EXACT)))
    exact = F.transform(grown, lambda x: F.floor(x).cast("double"))
    return F.when(F.coalesce(fits, F.lit(False)) & (F.size(vector) > 0), exact)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype="float64")


def _exact(m: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in the narrowest numbers that hold all their products' sums: doubles, 64-bit
    integers or Python's."""
    most = int(np.abs(m).max(initial=0)) * int(np.abs(side).max(initial=0)) * m.shape[1]
    if most < EXACT:
        return m, side
    kind = "int64" if most < 1 << 63 else object
    if kind == "int64":
        return m.astype(kind), side.astype(kind)
    whole = np.frompyfunc(int, 1, 1)
    return whole(m), whole(side)


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot, the distance to it and the vector's length."""
    norms = (pivots**2).sum(1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            m = _matrix(batch["v"])
            own = (m**2).sum(1)
            apart = own[:, None] + norms - 2 * (m @ pivots.T)
            cell = apart.argmin(1)
            batch["cell"] = cell.astype("int32")
            batch["apart"] = np.sqrt(np.maximum(apart[np.arange(len(m)), cell], 0))
            batch["length"] = np.sqrt(own)
            yield batch

    return rows.mapInPandas(assign, "id long, v array<double>, part long, cell int, apart double, length double")


def _bounds(queries: DataFrame, pivots, near, near_ids, radius, longest, k: int) -> DataFrame:
    """(query cell, data cell, lowest k-th score, query radius) for cells that a query may need."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            m = _matrix(batch["v"])
            scores = m @ near.T
            scores[batch["id"].to_numpy()[:, None] == near_ids] = -np.inf
            least = np.partition(scores, -k, axis=1)[:, -k] if near.shape[0] >= k else np.full(len(m), -np.inf)
            length = batch["length"].to_numpy()[:, None]
            most = np.minimum(m @ pivots.T + length * radius, length * longest)
            most += SLACK * (1 + np.abs(most) + length * longest)
            rows, cells = np.nonzero((most >= least[:, None]) & (longest >= 0))
            yield pd.DataFrame({
                "group": batch["cell"].to_numpy()[rows], "cell": cells.astype("int32"), "least": least[rows],
                "radius": batch["apart"].to_numpy()[rows],
            }).groupby(["group", "cell"], as_index=False).agg({"least": "min", "radius": "max"})

    found = queries.mapInPandas(judge, "group int, cell int, least double, radius double")
    return found.groupBy("group", "cell").agg(F.min("least").alias("least"), F.max("radius").alias("radius"))


def _solved(k: int, kind: str):
    """The k best of one data block for each query of one query block; scores are exact integers."""

    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(data):
            data = data.sort_values("id", kind="stable")
            ids = data["id"].to_numpy()
            names = queries["id"].to_numpy()
            m, side = _exact(_matrix(queries["v"]), _matrix(data["v"]).T)
            for at in range(0, len(m), SLICE):
                score = m[at : at + SLICE] @ side
                other = names[at : at + SLICE, None] != ids
                if score.shape[1] > k:
                    score[~other] = _LEAST[score.dtype.kind]
                    kth = np.sort(score, axis=1)[:, -k, None] if score.dtype == object else np.partition(score, -k, axis=1)[:, -k, None]
                    other &= score >= kth
                row, col = np.nonzero(other)
                found = pd.DataFrame({"query_id": names[at + row], "vec_id": ids[col], "score": score[row, col]})
                # Identifiers ascend with the columns, and both sorts keep their order.
                found = found.assign(row=row).sort_values("score", ascending=False, kind="stable").sort_values("row", kind="stable")
                out.append(found[found.groupby("row").cumcount() < k].drop(columns="row"))
        found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return found.assign(score=found["score"].map(lambda x: Decimal(int(x)))) if kind != "long" else found.astype("int64")

    def join(key, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        return solve(queries, data)

    return join


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    seed: int = 1,
) -> DataFrame:
    """The k highest integer inner products of each query among all other rows.

    Components count as floor(256 x).  Returns query_id, rank (from 1), vec_id, score; ties go to
    the smaller identifier.  Rows with a null identifier, an empty vector, null or non-finite
    components, or one whose floor(256 x) is 2^53 or more in size, take no part.  A query's own rows
    are those with its identifier; repeated rows of other identifiers are rows of their own, and
    repeated query rows are one query (its smallest vector).  Fewer than k others give fewer rows, an
    empty table none.  Vectors of other lengths than the longest count as filled up with zeros.
    Scores are exact integers at any size; one beyond 64 bits keeps its rank and is null.
    """
    named = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), scaled(F.col(f"`{vector_col}`")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where("id is not null and v is not null")
    rows = materialised(named)
    spark = rows.sparkSession
    total, asking, longest, largest = rows.agg(
        F.count("*"), F.sum(F.col("asks").cast("long")), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))
    ).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not total or not asking:
        return spark.createDataFrame([], out)
    kind = "long" if int(largest) ** 2 * longest < 1 << 63 else "decimal(38,0)"
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v"))))
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, -(-asking // (16 * QUERY_BLOCK))))
    # Distinct seeded vectors: one that is very common becomes one pivot.  At most MOST_PIVOTS rows.
    sample = (
        rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(2 * wanted).select("v").distinct().limit(wanted).collect()
    )
    pivots = np.array(sorted(r.v for r in sample), dtype="float64")
    with_part = rows.withColumn("part", F.xxhash64("id", F.lit("part")))
    data = materialised(_cells(with_part.select("id", "v", "part"), pivots))
    asks = _cells(
        with_part.where("asks").groupBy("id").agg(F.min("v").alias("v"), F.min("part").alias("part")), pivots
    )
    asks = materialised(asks)
    count, radius, longest, near, near_ids = _summaries(data, len(pivots), k)
    bounds = materialised(_bounds(asks, pivots, near, near_ids, radius, longest, k))
    # A row per pair of cells at most: bounded by the square of the number of pivots.
    need = bounds.collect()
    least, reach = {}, {}
    for r in need:
        least[r.group] = min(least.get(r.group, np.inf), r.least)
        reach[r.group] = max(reach.get(r.group, 0.0), r.radius)
    sent: dict[int, list[int]] = {}
    for r in need:
        sent.setdefault(r.cell, []).append(r.group)
    groups = {r["cell"]: r["count"] for r in asks.groupBy("cell").count().collect()}
    query_blocks = {g: -(-n // QUERY_BLOCK) for g, n in groups.items()}
    data_blocks = {c: max(1, -(-n // DATA_BLOCK)) for c, n in enumerate(count)}
    spread = F.create_map(*[F.lit(x) for pair in data_blocks.items() for x in pair])

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = batch["cell"].to_numpy()
            for cell in np.unique(cells):
                own = batch[cells == cell]
                m, length = _matrix(own["v"]), own["length"].to_numpy()
                for group in sent.get(int(cell), []):
                    most = m @ pivots[group] + reach[group] * length
                    most += SLACK * (1 + np.abs(most) + reach[group] * length)
                    held = own[most >= least[group]]
                    for block in range(query_blocks[group]):
                        yield pd.DataFrame({
                            "group": np.int32(group), "block": np.int32(block), "cell": np.int32(cell),
                            "chunk": (held["part"].to_numpy() % data_blocks[int(cell)]).astype("int32"),
                            "id": held["id"], "v": held["v"],
                        })

    place = ["group", "block", "cell", "chunk"]
    copies = data.mapInPandas(replicate, "group int, block int, cell int, chunk int, id long, v array<double>")
    blocks_of = F.create_map(*[F.lit(x) for pair in query_blocks.items() for x in pair])
    pairs = spark.createDataFrame([(r.group, r.cell) for r in need], "group int, cell int")
    questions = asks.select(
        F.col("cell").alias("group"), F.pmod("part", blocks_of[F.col("cell")]).cast("int").alias("block"), "id", "v"
    ).join(F.broadcast(pairs), "group").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.element_at(spread, F.col("cell")).cast("int") - 1))
    )
    solved = questions.groupBy(*place).cogroup(copies.groupBy(*place)).applyInPandas(
        _solved(k, kind), f"query_id long, vec_id long, score {kind}"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.expr("try_cast(score as long)").alias("score")
    )


def _summaries(data: DataFrame, cells: int, k: int):
    """Rows, radius and longest vector of each cell, and its k + 1 members nearest to the pivot."""
    count, radius, longest = [0] * cells, np.zeros(cells), np.full(cells, -1.0)
    stats = data.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("apart").alias("radius"), F.max("length").alias("longest")
    )
    for r in stats.collect():
        count[r.cell], radius[r.cell], longest[r.cell] = r.n, r.radius, r.longest
    place = Window.partitionBy("cell").orderBy("apart", "id")
    near = data.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1).collect()
    return count, radius, longest, np.array([r.v for r in near]), np.array([r.id for r in near])
