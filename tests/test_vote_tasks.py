"""Votes by blocks, and in how many tasks short rows lead to many pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brute import best_of
from lookalike.operators import vote_grid, votes


def some(side, owners, kinds, length):
    rng = random.Random(side)
    return [(f"t{rng.randrange(kinds)}", f"{side}{o}") for o in range(owners) for _ in range(length)]


def plain(cand, known):
    c, k, out = Counter(cand), Counter(known), Counter()
    for (t, a), n in c.items():
        for (u, b), m in k.items():
            if t == u:
                out[a, b] += n * m
    return out


@pytest.fixture(scope="module")
def tables(spark):
    cand, known = some("c", 25, 12, 4), some("k", 35, 14, 4)
    return (
        spark.createDataFrame(cand + [(None, "c0")], "token string, cand string"),
        spark.createDataFrame(known + [(None, "k0")], "token string, image_id string"),
        plain(cand, known),
    )


def test_votes_by_blocks_are_whole_and_make_no_pair_row(tables, monkeypatch):
    cand, known, want = tables
    monkeypatch.setattr(vote_grid, "OWNERS", 10)

    def joined(*_):
        raise AssertionError("a row per pair and token")

    monkeypatch.setattr(votes, "_pair_votes", joined)
    rows = votes.vote_counts(cand, known).collect()
    assert {(r.cand, r.image_id): r.votes for r in rows} == dict(want) and len(rows) == len(want)


def test_a_block_is_summed_in_parts(monkeypatch):
    import pyarrow as pa

    cand, known = Counter(some("c", 25, 12, 4)), Counter(some("k", 35, 14, 4))

    def table(bag, owner):
        return pa.table({owner: [o for _, o in bag], "_id": [int(t[1:]) for t, _ in bag], "n": list(bag.values())})

    monkeypatch.setattr(vote_grid, "AT_ONCE", 7)
    got = vote_grid._scored(table(cand, "cand"), table(known, "image_id"), "cand", "image_id").to_pylist()
    want = plain(list(cand.elements()), list(known.elements()))
    assert {(r["cand"], r["image_id"]): int(r["votes"]) for r in got} == dict(want)


@pytest.mark.parametrize("weight", [0, None, 2**52])
def test_weights_that_blocks_do_not_hold_are_joined(tables, weight):
    cand, known, want = tables
    weighed = cand.withColumn("n_b", F.lit(weight).cast("bigint"))
    got = {(r.cand, r.image_id): r.votes for r in votes.vote_counts(weighed, known, weight="n_b").collect()}
    assert got == {pair: None if weight is None else n * weight for pair, n in want.items()}


def test_leading_tokens_are_followed_in_many_tasks(tables, monkeypatch):
    cand, known, want = tables
    tasks, whole = [], votes._pair_votes

    def seen(c, *rest):
        tasks.append(c.rdd.getNumPartitions())
        return whole(c, *rest)

    monkeypatch.setattr(votes, "_pair_votes", seen)
    c, k = votes.weigh(cand, "cand", ["token"]), votes.weigh(known, "image_id", ["token"]).withColumnRenamed("w", "m")
    pairs = votes._by_leads(c, k, ["token"], "cand", "image_id", 1, 10**6)
    assert tasks == [4]
    best = {r.cand: (r.best_match, r.agree_count) for r in votes.best_of_votes(pairs).collect()}
    assert best == {c: found[:2] for c, found in best_of(want).items()}
