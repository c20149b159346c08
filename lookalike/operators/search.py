"""Searching: assign candidates to clusters, weigh their tokens, find keys.

Candidates are rows of cand, sel_id, features, phash and ward. Token counts
of the known items stay distributed; only the k centres are literals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import token_ngrams
from ..sources.store import cut_lineage
from .cluster import KINDS, center_distances, nearest_center
from .votes import SEEDS, best_with_total, weigh

CAND_KEYS = ["cand", "sel_id"]


def as_candidates(measures: DataFrame) -> DataFrame:
    """Measured items in the role of candidates."""
    return measures.select(F.col("image_id").alias("cand"), "sel_id", "features", *KINDS)


def cluster_token_score(cands: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """cand, sel_id, cluster_id, score: how often the candidate's tokens occur
    in each cluster; a repeated token counts again.

    A token has at most one count per cluster, so the join adds no more than
    k rows per candidate token.
    """
    tokens = (
        cands.select(*CAND_KEYS, F.explode(kind).alias("token"))
        .groupBy(*CAND_KEYS, "token")
        .agg(F.count("*").alias("w"))
    )
    known = counts.where(F.col("kind") == kind).select("token", "cluster_id", "n")
    return tokens.join(known, "token").groupBy(*CAND_KEYS, "cluster_id").agg(
        F.sum(F.col("w") * F.col("n")).alias("score")
    )


def best_cluster_by_token(cands: DataFrame, scores: DataFrame) -> DataFrame:
    """cand, sel_id, cluster_id of the highest score; the lower id wins a tie,
    cluster 0 where nothing matches."""
    order = F.struct("score", -F.col("cluster_id"))
    best = scores.groupBy(*CAND_KEYS).agg(F.max_by("cluster_id", order).alias("_best"))
    return cands.select(*CAND_KEYS).join(best, CAND_KEYS, "left").select(
        *CAND_KEYS, F.coalesce("_best", F.lit(0)).alias("cluster_id")
    )


def best_cluster_by_distance(cands: DataFrame, points) -> DataFrame:
    """cand, sel_id, cluster_id and distance of the nearest centre."""
    return nearest_center(cands, points).select(*CAND_KEYS, "cluster_id", "distance")


def assign_clusters(cands: DataFrame, points, counts: DataFrame) -> DataFrame:
    """Three rows per candidate selection: the clusters picked by phash tokens,
    by ward tokens and by distance, each with its own distance."""
    rows = center_distances(cands, points)
    for kind in KINDS:
        best = best_cluster_by_token(cands, cluster_token_score(cands, counts, kind))
        rows = rows.join(best.withColumnRenamed("cluster_id", f"_{kind}"), CAND_KEYS)
    nearest = F.array_position("distances", F.array_min("distances")).cast("int") - 1
    picks = F.array(
        *[
            F.struct(F.lit(name).alias("pick"), chosen.alias("cluster_id"))
            for name, chosen in (
                ("phash", F.col("_phash")),
                ("ward", F.col("_ward")),
                ("distance", nearest),
            )
        ]
    )
    return rows.select(*CAND_KEYS, "distances", *KINDS, F.inline(picks)).select(
        *CAND_KEYS,
        "pick",
        "cluster_id",
        F.get(F.col("distances"), F.col("cluster_id")).alias("distance"),
        *KINDS,
    )


def sort_by_distance(assigned: DataFrame) -> DataFrame:
    return assigned.orderBy("distance", *CAND_KEYS, "pick")


def candidate_tokens(assigned: DataFrame, kind: str, ngram_length: int = 2) -> DataFrame:
    """cand, cluster_id, token: n-grams of phash tokens, single ward tokens."""
    tokens = token_ngrams(F.col("phash"), ngram_length) if kind == "phash" else F.col(kind)
    return assigned.select(*CAND_KEYS, "pick", "cluster_id", F.explode(tokens).alias("token"))


def join_on_cluster(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """Candidate tokens with ``n_b``, the size of their cluster's token table.

    Joining with the token table itself would repeat each row n_b times and
    change nothing else. ``weights`` has one row per cluster, at most k, so
    it is broadcast. Tokens of a cluster without rows drop out.
    """
    return tokens.join(F.broadcast(weights), "cluster_id")


def key_tokens(assigned: DataFrame, kind: str, ngram_length: int = 2) -> DataFrame:
    """cluster_id, token, image_id of known items."""
    tokens = token_ngrams(F.col("phash"), ngram_length) if kind == "phash" else F.col(kind)
    return assigned.select("image_id", "cluster_id", F.explode(tokens).alias("token"))


def token_pairs(cand_tokens: DataFrame, known_tokens: DataFrame, weight: str | None = None) -> DataFrame:
    """The join of candidates and known items on tokens, by its two sides:
    token, side, id, n for every member of a token that both sides have.

    The pairs of a token are all combinations of its sides, with the product
    of their n; listing the sides says the same in a number of rows that grows
    with the input and not with its square.
    """
    c = weigh(cand_tokens, "cand", ["token"], weight)
    k = weigh(known_tokens, "image_id", ["token"])
    return _sides(c.join(k, "token", "left_semi"), k.join(c, "token", "left_semi"))


def _sides(c: DataFrame, k: DataFrame) -> DataFrame:
    sides = [
        df.select("token", F.lit(side).alias("side"), F.col(owner).alias("id"), F.col("w").alias("n"))
        for df, side, owner in ((c, "cand", "cand"), (k, "image", "image_id"))
    ]
    return sides[0].unionByName(sides[1])


def token_pair_groups(cand_tokens: DataFrame, known_tokens: DataFrame, take: int = 4) -> DataFrame:
    """Members of the first ``take`` shared tokens: token, side, id, n."""
    c = weigh(cand_tokens, "cand", ["token"])
    k = weigh(known_tokens, "image_id", ["token"])
    shared = (
        c.select("token").distinct().join(k.select("token").distinct(), "token")
        .orderBy("token").limit(take)
    )
    return _sides(c.join(shared, "token", "left_semi"), k.join(shared, "token", "left_semi"))


def outer_token_groups(cand_tokens: DataFrame, known_tokens: DataFrame) -> DataFrame:
    """The full outer join on tokens by its sides: token, side, id, n for
    every member of every token of either side."""
    return _sides(weigh(cand_tokens, "cand", ["token"]), weigh(known_tokens, "image_id", ["token"]))


def cluster_neighbors(cands: DataFrame, points, assigned: DataFrame) -> DataFrame:
    """Candidates and known items of every cluster: cluster_id, side, id,
    sel_id. A candidate's neighbours are the known items of its cluster."""
    near = best_cluster_by_distance(cands, points)
    return near.select("cluster_id", F.lit("cand").alias("side"), F.col("cand").alias("id"), "sel_id").unionByName(
        assigned.select("cluster_id", F.lit("image").alias("side"), F.col("image_id").alias("id"), "sel_id")
    )


def match_pairs(matches: DataFrame, candidates: DataFrame, originals: DataFrame, payload: str) -> DataFrame:
    """Matches with the contents of both items side by side."""
    mine = candidates.select(F.col("image_id").alias("cand"), F.col(payload).alias(f"cand_{payload}"))
    theirs = originals.select(
        F.col("image_id").alias("best_match"), F.col(payload).alias(f"match_{payload}")
    )
    return matches.select("cand", "best_match").join(mine, "cand").join(theirs, "best_match")


def match_samples(table: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of a match table in the given order."""
    return table.orderBy(*order).limit(n)


def search_rounds(
    cand_tokens: DataFrame,
    known_tokens: DataFrame,
    rounds: int = 1,
    weight: str | None = None,
    seeds: int = SEEDS,
    weights: DataFrame | None = None,
) -> DataFrame:
    """round, cand, best_match, agree_count, total.

    From the second round on, the keys found in the round before search among
    those not found yet. Where ``weight`` weighs candidates' tokens by the size
    of their cluster, ``weights`` (cluster_id, n_b) does so for the keys that
    ask, by their own cluster, so votes mean the same in every round.
    """
    if (weight is None) != (weights is None):
        raise ValueError("weight and weights belong together")
    first = best_with_total(cand_tokens, known_tokens, weight=weight, seeds=seeds)
    results = [first.select(F.lit(1).alias("round"), "*")]
    if rounds > 1:
        results[0] = cut_lineage(results[0])
        found = seen = results[0].select(F.col("best_match").alias("image_id")).distinct()
    for number in range(2, rounds + 1):
        asking = known_tokens.join(found, "image_id", "left_semi").withColumnRenamed("image_id", "cand")
        if weights is not None:
            asking = join_on_cluster(asking, weights.withColumnRenamed("n_b", weight))
        unseen = known_tokens.join(seen, "image_id", "left_anti")
        found_now = best_with_total(asking, unseen, weight=weight, seeds=seeds)
        results.append(cut_lineage(found_now.select(F.lit(number).alias("round"), "*")))
        found = results[-1].select(F.col("best_match").alias("image_id")).distinct()
        seen = cut_lineage(seen.unionByName(found))
    return reduce(DataFrame.unionByName, results)
