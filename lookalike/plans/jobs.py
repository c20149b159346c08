"""Run measuring, clustering and searching as one batch job."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.cluster import (
    Fit,
    cluster_items,
    cluster_token_counts,
    load_points,
    nearest_center,
    project_measures,
    token_cap,
)
from ..operators.lookups import token_lookups
from ..operators.search import as_candidates, match_samples
from ..operators.votes import final_matches
from ..sources.images import image_format, image_load, image_scan
from ..sources.store import RunStore
from .measure import measure_images
from .search import Matches, find_similar


def file_facts(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """image_id, length and format of every file, from their first bytes."""
    files = image_scan(spark, folder, glob)
    return files.select(
        F.col("path").alias("image_id"), "length", image_format(F.col("content")).alias("format")
    )


def measure_folder(
    store: RunStore, config: Config, folder: str, glob: str, files: str, rejected: str, measures: str
) -> DataFrame:
    """Facts of all files, measures of those that can be decoded, and the rest.

    Every picture is decoded once. A file without measures was not decoded.
    """
    facts = store.save(file_facts(store.spark, folder, glob), files)
    rows = store.save(measure_images(image_load(store.spark, folder, glob), config, meta=facts), measures)
    store.save(facts.join(rows.select("image_id").distinct(), "image_id", "left_anti"), rejected)
    return rows


def fit_clusters(measures: DataFrame, config: Config) -> tuple[Fit, DataFrame]:
    """Model, and items with their cluster."""
    items = project_measures(measures)
    fit = cluster_items(
        items,
        config.n_clusters_group,
        config.max_iter_group,
        config.kmeans_group_converge,
    )
    return fit, nearest_center(items, fit.points)


def capped_counts(assigned: DataFrame, config: Config) -> DataFrame:
    """Token counts per cluster, all of them unless a cap is asked for."""
    counts = cluster_token_counts(assigned)
    return token_cap(counts, config.token_caps) if config.token_caps else counts


def save_clusters(store: RunStore, fit: Fit, assigned: DataFrame) -> None:
    """Centres, statistics, items, token counts and the chosen lookup tables.

    Items are stored first; everything counted is counted from there.
    """
    store.save(fit.centers, store.cluster_path("cluster_center_meta"))
    store.save(fit.fit_stats, store.cluster_path("fit_stats"))
    base = store.save(assigned, store.cluster_path("assigned"))
    counts = capped_counts(base, store.config)
    for kind in ("phash", "ward"):
        store.save(counts.where(f"kind = '{kind}'"), store.cluster_path(f"{kind}_unions"))
    tables = token_lookups(base, store.config.kmeans_output, store.config.phash_chunk_len)
    for name, table in tables.items():
        store.save(table, store.cluster_path(name))


def save_matches(store: RunStore, matches: Matches) -> None:
    """Per kind the candidates' tokens, the winners and samples of them, and
    both kinds side by side.

    The tokens give the votes of any pair by way of the lookup tables; a list
    of all pairs is not stored.
    """
    config, best = store.config, {}
    for kind in ("ward", "phash"):
        store.save(matches.cand_tokens[kind], store.candidate_path(f"{kind}_candidate_tokens"))
        best[kind] = store.save(matches.best(kind), store.candidate_path(f"{kind}_matches"))
        samples = match_samples(best[kind], config.search_sample_step, "cand")
        store.save(samples, store.candidate_path(f"{kind}_samples"))
        if config.search_rounds > 1:
            rounds = matches.rounds(kind, config.search_rounds)
            store.save(rounds, store.candidate_path(f"{kind}_rounds"))
    joined = final_matches(best["ward"], best["phash"])
    store.save(joined, store.candidate_path("joined_final_matches"))


def run_actions(
    spark: SparkSession,
    config: Config,
    input_folder: str | None = None,
    candidate_folder: str | None = None,
    resume: bool = False,
) -> dict[str, float]:
    """Run the steps ``config.actions`` names; seconds spent on each.

    Every step reads what the step before has stored, so steps can also be
    run one by one. A run that broke is taken up with ``resume``: steps and
    tables that it finished stay as they are.
    """
    store = RunStore(spark, config, resume)
    seconds = {}

    def timed(action: str, step) -> None:
        if action in config.actions:
            start = time.monotonic()
            if not store.finished(f"step {action}"):
                step()
                store.finish(f"step {action}")
            seconds[action] = time.monotonic() - start

    def measure() -> None:
        measure_folder(
            store, config, input_folder, config.input_glob,
            store.files_path(), store.rejected_path(), store.measures_path(),
        )

    def cluster() -> None:
        measures = store.load(store.measures_path())
        save_clusters(store, *fit_clusters(measures, config))

    def search() -> None:
        path = store.candidate_path("measures")
        candidates = candidate_measures(store, config, candidate_folder, path)
        assigned = store.load(store.cluster_path("assigned"))
        counts = store.load(store.cluster_path("phash_unions")).unionByName(
            store.load(store.cluster_path("ward_unions"))
        )
        points = load_points(store.load(store.cluster_path("cluster_center_meta")))
        matches = find_similar(assigned, counts, points, as_candidates(candidates), config)
        save_matches(store, matches)

    timed("map_each_image", measure)
    timed("kmeans", cluster)
    timed("find_similar", search)
    return seconds


def candidate_measures(
    store: RunStore, config: Config, folder: str | None, path: str
) -> DataFrame:
    """Stored candidate measures, or new ones where there are none yet."""
    if config.candidate_has_mapped:
        return store.load(path)
    return measure_folder(
        store, config, folder, config.candidate_glob,
        store.candidate_path("files"), store.candidate_path("rejected"), path,
    )
