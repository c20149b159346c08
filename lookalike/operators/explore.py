"""Small operators for looking at tables: products, counts, sorts, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import uniform
from .measures import WHITESPACE


def random_pairs(spark: SparkSession, n: int = 100, seed: int = 0) -> DataFrame:
    """n uniform (x, y) pairs, the same on every run."""
    return random_pairs_for(spark.range(n), "id", seed)


def random_pairs_for(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A uniform (x, y) pair for every row's key."""
    return rows.select(
        key,
        uniform(F.lit(seed), F.col(key), F.lit("x")).alias("x"),
        uniform(F.lit(seed), F.col(key), F.lit("y")).alias("y"),
    )


def map_products(pairs: DataFrame, *keys: str) -> DataFrame:
    """Squares and product of x and y."""
    x, y = F.col("x"), F.col("y")
    return pairs.select(*keys, (x * x).alias("xx"), (y * y).alias("yy"), (x * y).alias("xy"))


def moment_ratio(pairs: DataFrame) -> DataFrame:
    """Sum of products over the product of the sums of squares, and the
    correlation coefficient."""
    products = map_products(pairs, "x", "y")
    return products.agg(
        (F.sum("xy") / (F.sum("yy") * F.sum("xx"))).alias("ratio"),
        F.corr("x", "y").alias("correlation"),
    )


def words(documents: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """One row per word of whole texts."""
    split = F.filter(F.split(text, WHITESPACE), lambda w: w != "")
    return documents.select(*keys, F.explode(split).alias("word"))


def word_count(documents: DataFrame, text: str = "text") -> DataFrame:
    """Words by how often they occur, most frequent first."""
    counts = words(documents, text).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def take_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*order).limit(n)


def inspect_type(df: DataFrame) -> DataFrame:
    """Name and type of every column, taken from the rows themselves."""
    types = F.array(
        *[F.struct(F.lit(c).alias("column"), F.typeof(c).alias("type")) for c in df.columns]
    )
    return df.limit(1).select(F.inline(types))


def mean_of_percentiles(percentiles: DataFrame, band: str = "band") -> DataFrame:
    """Each percentile averaged over all images, per band."""
    return percentiles.groupBy(band, "q").agg(F.avg("pct").alias("mean_pct"))


def mean_color_bins(pixels: DataFrame, image: str, bands: list[str], width: int = 5) -> DataFrame:
    """Images by the bin of their mean value, per band, in order of bin.

    One row per image with the size of its bin's group: a group's members are
    neighbouring rows of the sorted result, however many there are.
    """
    means = pixels.groupBy(image).agg(*[F.avg(b).alias(b) for b in bands])
    tagged = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("mean")) for b in bands])
    binned = means.select(image, F.inline(tagged)).select(
        "band", (F.floor(F.col("mean") / width) * width).alias("bin"), image
    )
    sizes = binned.groupBy("band", "bin").agg(F.count("*").alias("n_images"))
    return binned.join(sizes, ["band", "bin"]).orderBy("band", "bin", image)


def histo_median(
    measures: DataFrame, n_bands: int = 3, histo: str = "histo", shift: int = 0
) -> DataFrame:
    """image_id, band, median: the middle percentile of each band.

    ``shift=1`` reads one place further up.
    """
    per_band = F.size(histo) / n_bands
    place = F.floor(per_band / 2) + shift
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(n_bands - 1)),
        lambda b: F.struct(
            b.alias("band"), F.get(F.col(histo), (place + b * per_band).cast("int")).alias("median")
        ),
    )
    return measures.select("image_id", rows.alias("_rows")).select("image_id", F.inline("_rows"))


def lowest_by_median(medians: DataFrame, n: int = 5) -> DataFrame:
    """The n images with the lowest median in each band.

    Spark keeps only the first n rows per band in each task before the
    window's shuffle, so a band never comes together as a whole.
    """
    order = Window.partitionBy("band").orderBy("median", "image_id")
    return medians.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def pair_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Equality join of two keyed tables: inner, left, right or full outer."""
    return left.join(right, key, how)
