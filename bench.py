"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lookalike.catalog.queries import QUERIES  # noqa: E402
from lookalike.config import Config  # noqa: E402
from lookalike.plans.measure import measure_images  # noqa: E402
from lookalike.sources.images import image_load, write_png  # noqa: E402
from lookalike.sources.store import fresh_dir  # noqa: E402

#: Files for the default settings, as large as those the baseline speaks of.
PICTURES, WIDTH, HEIGHT = 384, 180, 200

HEADLINES = (
    "phash_ngrams",
    "band_percentiles",
    "block_median_fuzz",
    "color_centroids",
    "pca_measures",
    "native_band_percentiles",
    "word_count",
    "word_ngrams",
    "cluster_items",
    "token_cap",
    "nearest_original",
    "vote_counts",
    "find_similar",
    "measure_images",
)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise pictures as files, made of hashes of the vectors' ids."""
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").orderBy("vec_id").limit(PICTURES)
    place = F.sequence(F.lit(1), F.lit(WIDTH * HEIGHT))
    band = lambda n: F.transform(place, lambda i: F.pmod(F.xxhash64("vec_id", i, F.lit(n)), F.lit(256)).cast("double"))
    rows = ids.repartition(16).select(
        F.concat(F.col("vec_id").cast("string"), F.lit(".png")).alias("name"),
        F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.array(band(0), band(1), band(2)).alias("bands"),
    )
    folder = fresh_dir(spark, "bench")
    write_png(rows, folder)
    return image_load(spark, folder, "*.png")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lookalike-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    images = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    # small files: without this they would all go to a few tasks
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 18))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    files = pictures(spark, sf_dir)
    # a few first: what is left of the difference is work per picture
    files_n, few = files.count(), files.where(F.pmod(F.xxhash64("image_id"), F.lit(4)) == 0).count()
    for name, most in (("default_settings_few", 0), ("default_settings", 3)):
        start = time.perf_counter()
        part = files.where(F.pmod(F.xxhash64("image_id"), F.lit(4)) <= most)
        measure_images(part, Config()).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "images": images,
                "measure_images_sec_per_image": round(seconds["measure_images"] / images, 4),
                "default_settings_sec_per_image": round(seconds["default_settings"] / PICTURES, 4),
                "default_settings_core_sec_per_further_image": round(
                    (seconds["default_settings"] - seconds["default_settings_few"]) * int(cpus) / (files_n - few), 4
                ),
            }
        )
    )


if __name__ == "__main__":
    main()
