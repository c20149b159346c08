import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brute import best_of, literal_votes
from lookalike.operators.search import join_on_cluster, search_rounds, token_pairs
from lookalike.operators.votes import (
    best_of_votes,
    best_with_total,
    final_matches,
    fused_votes,
    tagged,
    vote_counts,
)


def bags(rng, n, tokens, length, hot=()):
    """(token, owner) rows; some owners are copies, some tokens everywhere."""
    rows = []
    for owner in range(n):
        source = owner if owner % 3 else 0
        mine = random.Random(f"{rng}-{source}")
        picked = [f"t{mine.randrange(tokens)}" for _ in range(length)]
        rows += [(t, owner) for t in picked + [h for h in hot if mine.random() < 0.8]]
    return rows


@pytest.fixture(scope="module")
def sample(spark):
    cand = bags("c", 20, 30, 4, ("h1", "h2"))
    known = bags("k", 40, 30, 4, ("h1", "h2", "h3"))
    return (
        spark.createDataFrame(cand, "token string, cand int"),
        spark.createDataFrame(known, "token string, image_id int"),
        cand,
        known,
    )


def as_votes(cand, known):
    rows = [(0, t, c) for t, c in cand]
    return literal_votes(rows, [(0, "any")], known)


def test_votes_equal_the_literal_joins(spark):
    rng = random.Random(5)
    cand = [(rng.randrange(4), f"t{rng.randrange(6)}", rng.randrange(5)) for _ in range(60)]
    cluster = [(rng.randrange(3), f"t{rng.randrange(6)}") for _ in range(40)]
    known = [(f"t{rng.randrange(6)}", rng.randrange(9)) for _ in range(50)]
    expected = literal_votes(cand, cluster, known)

    weights = (
        spark.createDataFrame(cluster, "cluster_id int, token string")
        .groupBy("cluster_id").agg(F.count("*").alias("n_b"))
    )
    cand_df = spark.createDataFrame(cand, "cluster_id int, token string, cand int")
    known_df = spark.createDataFrame(known, "token string, image_id int")
    weighed = join_on_cluster(cand_df, weights)
    got = {
        (r.cand, r.image_id): r.votes
        for r in vote_counts(weighed, known_df, weight="n_b").collect()
    }
    assert got == dict(expected)
    best = {
        r.cand: (r.best_match, r.agree_count, r.total)
        for r in best_with_total(weighed, known_df, weight="n_b", seeds=1).collect()
    }
    assert best == best_of(expected)


@pytest.mark.parametrize("seeds", [1, 4, 50])
def test_best_is_exact_however_good_the_bound_is(sample, seeds):
    cand_df, known_df, cand, known = sample
    got = best_with_total(cand_df, known_df, seeds=seeds).collect()
    assert {r.cand: (r.best_match, r.agree_count, r.total) for r in got} == best_of(
        as_votes(cand, known)
    )


@pytest.mark.parametrize("kinds, length, own", [(9, 4, 0), (16, 6, 0), (5, 3, 2)])
def test_best_is_exact_among_different_bags_of_common_tokens(spark, kinds, length, own):
    rng = random.Random(kinds)

    def some(side, n):
        return [
            (t, owner)
            for owner in range(n)
            for t in [f"h{rng.randrange(kinds)}" for _ in range(length)]
            + [f"{rng.choice(('c', 'k', side))}{owner % 60}-{i}" for i in range(own)]
        ]

    cand, known = some("c", 80), some("k", 150)
    got = best_with_total(
        spark.createDataFrame(cand, "token string, cand int"),
        spark.createDataFrame(known, "token string, image_id int"),
        seeds=2,
    ).collect()
    assert {r.cand: (r.best_match, r.agree_count, r.total) for r in got} == best_of(
        as_votes(cand, known)
    )


def test_votes_beyond_a_bigint_are_exact(spark):
    cand = spark.createDataFrame([(1, "t", 4 * 10**18), (1, "u", 1)], "cand int, token string, big long")
    known = spark.createDataFrame([(7, "t")] * 5 + [(8, "u")], "image_id int, token string")
    row = best_with_total(cand, known, weight="big").first()
    assert tuple(row) == (1, 7, 2 * 10**19, 2 * 10**19 + 1)


def test_best_of_stored_votes_is_the_same(sample):
    cand_df, known_df, cand, known = sample
    got = best_of_votes(vote_counts(cand_df, known_df)).collect()
    assert {r.cand: (r.best_match, r.agree_count, r.total) for r in got} == best_of(
        as_votes(cand, known)
    )


def test_fusing_votes_equals_voting_on_all_tokens(spark, sample):
    cand_df, known_df, _, _ = sample
    other_c = cand_df.where("cand < 10").withColumn("token", F.concat(F.lit("x"), "token"))
    other_k = known_df.where("image_id > 5").withColumn("token", F.concat(F.lit("x"), "token"))
    added = fused_votes(vote_counts(cand_df, known_df), vote_counts(other_c, other_k))
    together = best_with_total(
        tagged({"a": cand_df, "b": other_c}), tagged({"a": known_df, "b": other_k}), ("kind", "token")
    )
    assert sorted(best_of_votes(added).collect()) == sorted(together.collect())


def test_final_matches_drop_candidates_with_one_kind(spark):
    schema = "cand int, best_match int, agree_count long, total long"
    ward = spark.createDataFrame([(1, 5, 2, 3), (2, 6, 1, 1)], schema)
    phash = spark.createDataFrame([(2, 7, 4, 9)], schema)
    assert [tuple(r) for r in final_matches(ward, phash).collect()] == [(2, 6, 1, 1, 7, 4, 9)]


def test_sides_of_a_token_give_the_literal_pairs(sample):
    cand_df, known_df, cand, known = sample
    rows = [tuple(r) for r in token_pairs(cand_df, known_df).collect()]
    sides = {s: [(t, i, n) for t, side, i, n in rows if side == s] for s in ("cand", "image")}
    votes = Counter()
    for token, c, n in sides["cand"]:
        for other, k, m in sides["image"]:
            if token == other:
                votes[c, k] += n * m
    want = {(r.cand, r.image_id): r.votes for r in vote_counts(cand_df, known_df).collect()}
    assert dict(votes) == want
    assert len(rows) <= len(cand) + len(known)


def test_later_rounds_find_new_keys_only(sample):
    cand_df, known_df, _, _ = sample
    rows = search_rounds(cand_df, known_df, rounds=3).collect()
    first = {r.best_match for r in rows if r.round == 1}
    second = {r.best_match for r in rows if r.round == 2}
    third = {r.best_match for r in rows if r.round == 3}
    assert second and not first & second and not (first | second) & third
    assert {r.cand for r in rows if r.round == 2} <= first


def test_later_rounds_weigh_by_the_asking_key(spark):
    """The same tokens in clusters of other sizes give other votes."""
    known = [("t1", 1, 0), ("t2", 1, 0), ("t2", 2, 1), ("t3", 2, 1), ("t3", 3, 1), ("t2", 4, 0)]
    known_df = spark.createDataFrame(known, "token string, image_id int, cluster_id int")
    weights = spark.createDataFrame([(0, 10), (1, 7)], "cluster_id int, n_b long")
    cand = spark.createDataFrame([("t1", 50, 10)], "token string, cand int, n_b long")
    rows = search_rounds(cand, known_df, rounds=3, weight="n_b", weights=weights).collect()
    assert [tuple(r) for r in rows] == [(1, 50, 1, 10, 10), (2, 1, 2, 10, 20), (3, 2, 3, 7, 14)]
    with pytest.raises(ValueError):
        search_rounds(cand, known_df, rounds=2, weight="n_b")
