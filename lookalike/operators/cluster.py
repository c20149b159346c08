"""K-means of all items, and token counts per cluster.

The only rows that reach the driver are the k centres of a round: k times the
vector length, whatever the size of the table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import bind, squared_distance
from .ranking import top_rows

KINDS = ("phash", "ward")


@dataclass(frozen=True)
class Fit:
    """Outcome of clustering: one row per centre and one row of statistics."""

    centers: DataFrame
    fit_stats: DataFrame
    points: tuple[tuple[float, ...], ...]


def project_measures(measures: DataFrame) -> DataFrame:
    """The columns clustering and lookups need."""
    return measures.select("image_id", "sel_id", "features", *KINDS)


def seed_sample(items: DataFrame, k: int, seed: int = 1, *keys: str) -> DataFrame:
    """k rows without replacement: the first ones in hash order of their keys."""
    keys = keys or ("image_id", "sel_id")
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys]))
    return items.withColumn("draw", draw).orderBy("draw", *keys).limit(k)


def _points(points) -> Column:
    """The centres as one value of the plan, however many and long they are."""
    text = json.dumps([[float(v) for v in p] for p in points])
    return F.from_json(F.lit(text), F.lit("array<array<double>>"))


def _distances(features: Column, points) -> Column:
    """Squared distance to every centre."""
    return F.transform(_points(points), lambda p: squared_distance(features, p))


def _least(distances: Column) -> Column:
    """(cluster_id, distance) of the nearest centre; the lower id wins a tie."""
    return bind(
        distances,
        lambda all_of: bind(
            F.array_min(all_of),
            lambda low: F.struct((F.array_position(all_of, low) - 1).cast("int").alias("cluster_id"), low.alias("distance")),
        ),
    )


def nearest_center(items: DataFrame, points, features: str = "features") -> DataFrame:
    """Add ``cluster_id`` and ``distance`` (squared); the lower id wins a tie."""
    best = _least(_distances(F.col(features), points))
    return (
        items.withColumn("_best", best)
        .select("*", "_best.cluster_id", "_best.distance")
        .drop("_best")
    )


def center_distances(items: DataFrame, points, features: str = "features") -> DataFrame:
    """Add ``distances``, the squared distance to every centre in id order."""
    return items.withColumn("distances", _distances(F.col(features), points))


def cluster_sizes(items: DataFrame, points, features: str = "features") -> DataFrame:
    """n and sse of every cluster that has items."""
    near = nearest_center(items, points, features)
    return near.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("distance").alias("sse"))


def lloyd_step(items: DataFrame, points, features: str = "features") -> DataFrame:
    """New centre, size and squared distances per cluster that has items.

    Sums combine per cluster and element within a task, so what leaves it is
    as long as the centres, and the plan does not grow with them.
    """
    near = nearest_center(items, points, features)
    cells = near.select("cluster_id", "distance", F.posexplode(features).alias("pos", "v"))
    sums = cells.groupBy("cluster_id", "pos").agg(
        F.avg("v").alias("v"), F.count("*").alias("n"), F.sum("distance").alias("sse")
    )
    # a vector's elements per cluster
    whole = sums.groupBy("cluster_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("cells"),
        F.max("n").alias("n"),
        F.max(F.when(F.col("pos") == 0, F.col("sse"))).alias("sse"),
    )
    return whole.select("cluster_id", F.transform("cells", lambda c: c["v"]).alias("center"), "n", "sse")


def cluster_items(
    items: DataFrame,
    k: int,
    max_rounds: int,
    converge: float | None = None,
    seed: int = 1,
    features: str = "features",
    keys: tuple[str, ...] = ("image_id", "sel_id"),
) -> Fit:
    """K-means rounds until the centres move by ``converge`` or less in sum.

    ``converge=None`` runs all rounds. A centre without items stays put. Sizes
    and ``sse`` belong to the final centres.
    """
    spark = items.sparkSession
    items = items.select(*keys, features)
    seeds = seed_sample(items, k, seed, *keys).select(features).collect()
    points = tuple(tuple(row[0]) for row in seeds)
    shift, rounds = float("inf"), 0
    while rounds < max_rounds:
        moved = {r["cluster_id"]: r for r in lloyd_step(items, points, features).collect()}
        new = tuple(
            tuple(moved[i]["center"]) if i in moved else p for i, p in enumerate(points)
        )
        shift = center_shift(points, new)
        points, rounds = new, rounds + 1
        if converge is not None and shift <= converge:
            break
    sizes = {r["cluster_id"]: r for r in cluster_sizes(items, points, features).collect()} if points else {}
    counts = [sizes[i]["n"] if i in sizes else 0 for i in range(len(points))]
    sse = float(sum(r["sse"] for r in sizes.values()))
    return Fit(
        centers=centers_table(spark, points, counts),
        fit_stats=spark.createDataFrame(
            [(rounds, shift, sse)], "rounds int, shift double, sse double"
        ),
        points=points,
    )


def centers_table(spark: SparkSession, points, counts) -> DataFrame:
    rows = [(i, [float(v) for v in p], int(n)) for i, (p, n) in enumerate(zip(points, counts))]
    return spark.createDataFrame(rows, "cluster_id int, center array<double>, n bigint")


def load_points(centers: DataFrame):
    """The k centres of a stored model."""
    return tuple(tuple(r["center"]) for r in centers.orderBy("cluster_id").collect())


def center_shift(old, new) -> float:
    """Summed squared distance between two lists of k centres."""
    return sum((a - b) ** 2 for p, q in zip(old, new) for a, b in zip(p, q))


def within_sse(items: DataFrame, points, features: str = "features") -> DataFrame:
    """Summed squared distance of all items to their own centre."""
    return nearest_center(items, points, features).agg(
        F.count("*").alias("n"), F.sum("distance").alias("sse")
    )


def cluster_token_counts(assigned: DataFrame, kinds=KINDS) -> DataFrame:
    """kind, cluster_id, token, n: how often each token occurs per cluster.

    ``assigned`` has one row per item with cluster_id and a token array per
    kind. Counts combine before the shuffle.
    """
    bags = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("tokens")) for k in kinds])
    rows = (
        assigned.select("cluster_id", F.inline(bags))
        .select("cluster_id", "kind", F.explode("tokens").alias("token"))
    )
    return rows.groupBy("kind", "cluster_id", "token").agg(F.count("*").alias("n"))


def cluster_top_tokens(counts: DataFrame, kind: str, cluster_id: int, top: int) -> DataFrame:
    """The most frequent tokens of one cluster."""
    mine = counts.where((F.col("kind") == kind) & (F.col("cluster_id") == cluster_id))
    return mine.orderBy(F.desc("n"), "token").limit(top)


def token_cap(counts: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The most frequent tokens per kind and cluster, up to the kind's cap.

    Exact, all kinds in one pass, and no cluster goes through one task: tokens
    are bucketed by their count and first hash digits, a histogram of the
    buckets says where the cap falls, and buckets are ranked by themselves.
    """
    cap = F.lit(None).cast("int")
    for kind, most in caps.items():
        cap = F.when(F.col("kind") == kind, F.lit(most)).otherwise(cap)
    headed = counts.where(F.col("kind").isin(*caps)).withColumn("_head", F.substring("token", 1, 3))
    return top_rows(
        headed,
        ["kind", "cluster_id"],
        cap,
        ["n", "_head"],
        [F.desc("n"), F.col("_head")],
        [F.col("token")],
    ).drop("_head")


def token_heavy_hitters(assigned: DataFrame, kind: str, top: int, buckets: int = 4096, opened: int = 4) -> DataFrame:
    """cluster_id, token, n, error: the most frequent tokens per cluster in
    bounded memory; ``n`` is exact.

    The summary counts tokens by a hash in ``buckets`` counters per cluster:
    counters add up, whatever the partitioning. No token is more frequent than
    its counter, so a second pass counts the tokens of the ``opened`` times
    ``top`` largest counters alone. ``error`` is how much more frequent than
    the last token listed an unlisted one could be; 0 means the list is
    certain to be the right one.
    """
    tokens = assigned.select("cluster_id", F.explode(kind).alias("token")).withColumn(
        "_bucket", F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % buckets
    )
    summary = tokens.groupBy("cluster_id", "_bucket").agg(F.count("*").alias("_most"))
    # at most ``buckets`` rows per cluster
    largest = Window.partitionBy("cluster_id").orderBy(F.desc("_most"), "_bucket")
    ranked = summary.withColumn("_rank", F.row_number().over(largest)).where(F.col("_rank") <= opened * top + 1)
    closed = ranked.where(F.col("_rank") > opened * top).select("cluster_id", F.col("_most").alias("_closed"))
    open_ones = ranked.where(F.col("_rank") <= opened * top).select("cluster_id", "_bucket")
    exact = tokens.join(open_ones, ["cluster_id", "_bucket"]).groupBy("cluster_id", "token").agg(F.count("*").alias("n"))
    first = top_rows(
        exact,
        ["cluster_id"],
        F.lit(top),
        ["n"],
        [F.desc("n")],
        [F.col("token")],
    )
    # a cluster's list is at most ``top`` rows
    whole = Window.partitionBy("cluster_id")
    last = F.when(F.count("*").over(whole) < top, F.lit(0)).otherwise(F.min("n").over(whole))
    error = F.greatest(F.lit(0), F.coalesce("_closed", F.lit(0)) - last)
    return first.join(closed, "cluster_id", "left").select("cluster_id", "token", "n", error.alias("error"))
