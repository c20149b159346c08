"""Exact ranks inside groups of any size.

A window over a group puts the whole group into one task. Here the group is
first cut into buckets that follow the wanted order; only the bucket sizes,
a short table, are summed up over the group, and rows are ranked inside their
bucket. A group that holds a third of all rows is so spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_offsets(
    rows: DataFrame, group: list[str], bucket: list[str], order: list[Column], weight: str
) -> DataFrame:
    """Per bucket: weight ``before`` it in its group, its own, and the group's."""
    sizes = rows.groupBy(*group, *bucket).agg(F.sum(weight).alias("in_bucket"))
    whole = Window.partitionBy(*group)
    running = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *group,
        *bucket,
        "in_bucket",
        F.coalesce(F.sum("in_bucket").over(running), F.lit(0)).alias("before"),
        F.sum("in_bucket").over(whole).alias("in_group"),
    )


def group_percentiles(
    rows: DataFrame, group: list[str], value: str, quantiles, bucket_width: float
) -> DataFrame:
    """Exact interpolated percentiles (0..100) of ``value`` per group: group
    columns, ``q`` and ``pct``."""
    return band_percentile_rows(rows, group, {value: bucket_width}, quantiles).drop("band")


def band_percentile_rows(
    rows: DataFrame, group: list[str], bucket_widths: dict[str, float], quantiles
) -> DataFrame:
    """Exact interpolated percentiles (0..100) of several columns per group, in
    one pass over ``rows``.

    ``bucket_widths`` names the columns and a width of buckets for each. Equal
    values are counted before anything else. A histogram of the buckets, a
    short table, says which of them hold a wanted rank; only these are looked
    into. Nulls take no part. Result: group columns, ``band`` (the column's
    name), ``q`` and ``pct``.
    """
    bands = F.array(
        *[
            F.struct(
                F.lit(name).alias("band"),
                F.col(name).cast("double").alias("v"),
                F.floor(F.col(name).cast("double") / width).alias("_bucket"),
            )
            for name, width in bucket_widths.items()
        ]
    )
    group = [*group, "band"]
    counted = (
        rows.select(*group[:-1], F.inline(bands))
        .where("v IS NOT NULL")
        .groupBy(*group, "_bucket", "v")
        .agg(F.count("*").alias("n"))
    )
    # both uses of ``counted`` share its shuffle
    offsets = bucket_offsets(counted, group, ["_bucket"], [F.col("_bucket")], "n")
    place = F.col("_q") / 100 * (F.col("in_group") - 1)
    wanted = (
        offsets.withColumn("_q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
        .withColumn("_place", place)
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))))
        .where((F.col("_rank") >= F.col("before")) & (F.col("_rank") < F.col("before") + F.col("in_bucket")))
    )
    targets = wanted.groupBy(*group, "_bucket", "before").agg(
        # at most two ranks per quantile
        F.collect_list(F.struct("_q", "_place", "_rank")).alias("_targets")
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy("v")
    found = (
        counted.join(targets, [*group, "_bucket"])
        .withColumn("_upto", F.col("before") + F.sum("n").over(inside))
        .withColumn("_t", F.explode("_targets"))
        .where(
            (F.col("_t._rank") < F.col("_upto"))
            & (F.col("_t._rank") >= F.col("_upto") - F.col("n"))
        )
    )
    ends = found.groupBy(*group, F.col("_t._q").alias("q"), F.col("_t._place").alias("_place")).agg(
        F.min("v").alias("_low"), F.max("v").alias("_high")
    )
    part = F.col("_place") - F.floor("_place")
    return ends.select(*group, "q", (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias("pct"))


def top_rows(
    rows: DataFrame,
    group: list[str],
    cap: int | Column,
    bucket: list[str],
    bucket_order: list[Column],
    inner_order: list[Column],
) -> DataFrame:
    """The first ``cap`` rows of every group, exactly; ``cap`` may differ
    between groups.

    Buckets that begin at the cap or later fall away by their sizes alone, a
    short table. Of the others, whose rows exceed the cap by less than one
    bucket, each is ranked by itself.
    """
    limit = cap if isinstance(cap, Column) else F.lit(cap)
    ones = rows.withColumn("_one", F.lit(1))
    offsets = bucket_offsets(ones, group, bucket, bucket_order, "_one").where(F.col("before") < limit)
    inside = Window.partitionBy(*group, *bucket).orderBy(*inner_order)
    placed = rows.join(offsets.select(*group, *bucket, "before"), [*group, *bucket])
    ranked = placed.withColumn("_place", F.col("before") + F.row_number().over(inside))
    return ranked.where(F.col("_place") <= limit).select(*rows.columns)
