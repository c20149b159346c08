"""Measure images: every selection of every image, all measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import KEYS
from ..operators.measures import (
    band_covariance,
    band_percentiles,
    color_centroids,
    feature_vector,
    pca_measures,
    phash_tokens,
)
from ..operators.regions import region_tokens
from ..operators.selections import resize, sampled_selections, select_all, to_rgb


def _with_regions(rows: DataFrame, config: Config) -> DataFrame:
    """Region tokens of a still smaller copy, beside the row's own bands."""
    own = ("width", "height", "bands")
    kept = [F.col(c).alias(f"_{c}") for c in own]
    smaller = resize(rows.select("*", *kept), config.ward_x_down)
    marked = region_tokens(smaller, config.ward_clusters).drop(*own)
    return marked.withColumnsRenamed({f"_{c}": c for c in own})


def measure_images(
    images: DataFrame, config: Config, value_range: float = 255.0, meta: DataFrame | None = None
) -> DataFrame:
    """One row of measures per selection.

    ``images`` are decoded files (``image_load``), of which only the bytes that
    are needed become numbers, or pictures as arrays: image_id, width, height,
    bands. Every measure works on the selection's own row, so nothing is
    shuffled. ``meta`` (image_id and any other columns) is carried along as a
    map.
    """
    windows = (config.max_patches, config.patch_fraction, config.patch_seed, config.quadrants)
    if "data" in images.columns:
        rows = sampled_selections(images, config.x_down, value_range, *windows)
    else:
        rows = resize(to_rgb(select_all(images, *windows)), config.x_down, value_range)
    rows = color_centroids(rows, config.n_clusters, config.max_iterations, config.kmeans_sample)
    rows = _with_regions(rows, config)
    rows = band_percentiles(rows, config.quantiles)
    rows = phash_tokens(rows, config.phash_bits)
    rows = feature_vector(pca_measures(band_covariance(rows)))
    if meta is not None:
        facts = [c for c in meta.columns if c != "image_id"]
        packed = F.create_map(
            *[part for c in facts for part in (F.lit(c), F.col(c).cast("string"))]
        )
        rows = rows.join(meta.select("image_id", packed.alias("meta")), "image_id", "left")
    else:
        rows = rows.withColumn("meta", F.lit(None).cast("map<string,string>"))
    return rows.select(
        *KEYS,
        "is_full",
        "width",
        "height",
        "cen",
        "histo",
        "phash",
        "ward",
        "pca_var",
        "pca_fac",
        "features",
        "meta",
    )
