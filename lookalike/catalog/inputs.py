"""The given tables in the roles the operators expect.

A vector of ``embeddings`` is an 8x8 gray image, or an 8x8 image whose red,
green and blue are the vector and the vector rotated twice; its altered copy is a candidate with a known answer. ``lineitem``
is a large pixel table with one image per supplier. Every row takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..functions.tokens import bits_at_mean, block_tokens, luminosity
from ..operators.cluster import (
    Fit,
    cluster_items,
    cluster_token_counts,
    nearest_center,
    project_measures,
)
from ..operators.measures import phash_tokens
from ..operators.perturb import block_median_fuzz
from ..operators.search import as_candidates
from ..operators.selections import select_full, to_rgb

# sizes used by the queries and by the SQL that checks them
PHASH_BITS = 8
WARD_BITS = 10
NGRAM = 2
CLUSTERS = 8
ROUNDS = 2
FUZZ_BLOCK = 3
FUZZ_PROBABILITY = 0.14
FUZZ_SEED = 7
PRICE_SCALE = 1000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id and the vector as doubles."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("e"),
    )


def gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(
        "image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.array("e").alias("bands")
    )


def rgb_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = bind(F.col("e"), lambda e: F.array(*[rotated(e, F.lit(21 * i)) for i in range(3)]))
    return vectors(spark, sf_dir).select(
        "image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), bands.alias("bands")
    )


def rotated(e: Column, by: Column) -> Column:
    """All values of a vector of 64, beginning at place ``by``."""
    return F.concat(F.slice(e, by + 1, F.lit(64) - by), F.slice(e, F.lit(1), by))


def byte_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coloured images with whole values 0..255."""
    as_byte = lambda v: F.floor((v + 1) * 127.5).cast("double")
    return rgb_images(spark, sf_dir).withColumn(
        "bands", F.transform("bands", lambda b: F.transform(b, as_byte))
    )


def fuzzy_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_median_fuzz(
        gray_images(spark, sf_dir), FUZZ_BLOCK, FUZZ_PROBABILITY, FUZZ_SEED
    )


def describe(images: DataFrame) -> DataFrame:
    """Vector and two kinds of tokens per gray image.

    The second kind, finer blocks of the same bits, stands in for region
    tokens where a query is checked by SQL; region tokens themselves come
    from a loop that SQL cannot follow.
    """
    wide = select_full(images).withColumn("features", F.get(F.col("bands"), F.lit(0)))
    wide = phash_tokens(to_rgb(wide), PHASH_BITS)
    bits = bind(F.col("bands"), lambda bands: bits_at_mean(luminosity(bands)))
    return project_measures(wide.withColumn("ward", block_tokens(bits, WARD_BITS)))


def known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(gray_images(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_candidates(describe(fuzzy_images(spark, sf_dir)))


def fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Fit]:
    items = known_items(spark, sf_dir)
    return items, cluster_items(items, CLUSTERS, ROUNDS)


def assigned_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Fit]:
    items, fit = fitted(spark, sf_dir)
    return nearest_center(items, fit.points), fit


def token_counts(assigned: DataFrame) -> DataFrame:
    return cluster_token_counts(assigned)


def line_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, r, g, b: one pixel per order line, one image per supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_id"),
        F.col("l_quantity").alias("r"),
        (F.col("l_extendedprice") / PRICE_SCALE).alias("g"),
        F.col("l_discount").alias("b"),
    )


def vector_text(vector: Column) -> Column:
    """A vector as text in whole millionths, the same in every engine."""
    return F.array_join(
        F.transform(vector, lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ","
    )


def values_at(df: DataFrame, array: str, *keys: str, digits: int = 6) -> DataFrame:
    """One rounded row per element of an array column."""
    rows = df.select(*keys, F.posexplode(array).alias("pos", "v"))
    return rows.select(*keys, "pos", tidy("v", digits).alias("v"))


def tidy(column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)
