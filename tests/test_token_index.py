"""Best match by blocks against plain counting, on bags of common tokens."""

import random

import pytest
from pyspark.sql import functions as F

from brute import best_of, literal_votes
from lookalike.operators import token_index, votes
from lookalike.operators.votes import best_with_total


def common_bags(seed, n, kinds, length, names=int, near=0):
    """(token, owner): all tokens are common. ``near`` bags are altered ones
    of the same number of groups."""
    rng, rows = random.Random(seed), []
    groups = [[f"t{rng.randrange(kinds)}" for _ in range(length)] for _ in range(near)]
    for owner in range(n):
        bag = list(groups[owner % near]) if near else [f"t{rng.randrange(kinds)}" for _ in range(length)]
        for _ in range(rng.randrange(2) if near else 0):
            bag[rng.randrange(length)] = f"t{rng.randrange(kinds)}"
        rows += [(t, names(owner)) for t in bag]
    return rows


def plain(cand, known):
    return best_of(literal_votes([(0, t, c) for t, c in cand], [(0, "any")], known))


@pytest.mark.parametrize("kinds, length, near, bits", [(6, 5, 0, 14), (30, 8, 0, 5), (200, 12, 40, 5), (3, 40, 0, 5)])
def test_blocks_are_exact(spark, monkeypatch, kinds, length, near, bits):
    monkeypatch.setattr(token_index, "CHUNK_BITS", bits)
    monkeypatch.setattr(token_index, "ROOTS", 2)
    monkeypatch.setattr(token_index, "LEAF", 4)
    monkeypatch.setattr(token_index, "CANDIDATES", 16)
    cand = common_bags(1, 60, kinds, length, near=near)
    known = common_bags(1, 300, kinds, length, near=near) + common_bags(2, 50, kinds, length, names=lambda i: i + 300)
    got = best_with_total(
        spark.createDataFrame(cand, "token string, cand int"),
        spark.createDataFrame(known, "token string, image_id int"),
        leads=0,
    ).collect()
    assert {r.cand: (r.best_match, r.agree_count, r.total) for r in got} == plain(cand, known)


def test_keys_of_text_several_token_columns_and_large_weights(spark):
    cand = common_bags(3, 25, 9, 6, names=lambda i: f"c{i}")
    known = common_bags(4, 70, 9, 6, names=lambda i: f"k{i:02}é")
    c = spark.createDataFrame(cand, "token string, who string").withColumn("big", F.lit(10**17))
    k = spark.createDataFrame(known, "token string, item string")
    for on in (("token",), ("kind", "token")):
        sides = [df.withColumn("kind", F.lit(5)) for df in (c, k)]
        got = best_with_total(*sides, on=on, cand="who", key="item", weight="big", leads=0).collect()
        assert {r.who: (r.best_match, r.agree_count // 10**17, r.total // 10**17) for r in got} == plain(cand, known)


def test_no_pairs_no_rows(spark):
    c = spark.createDataFrame([("a", 1), (None, 1), (None, 2)], "token string, cand int")
    k = spark.createDataFrame([("b", 1), (None, 3)], "token string, image_id int")
    assert best_with_total(c, k, leads=0).count() == 0
    assert best_with_total(c.limit(0), k.limit(0), leads=0).count() == 0


def test_blocks_that_cannot_win_are_not_visited(spark, monkeypatch):
    """Altered copies whose tokens are all common: few chunks per candidate,
    however many there are."""
    visits, inner = {}, token_index.visit
    monkeypatch.setattr(token_index, "CHUNK_BITS", 5)
    for n in (400, 4_000):
        seen = []
        monkeypatch.setattr(token_index, "visit", lambda pairs, *a: seen.append(pairs.count()) or inner(pairs, *a))  # noqa: B023
        known = common_bags(7, n, 150, 14, near=n // 8)
        cand = common_bags(7, n // 2, 150, 14, near=n // 8)
        best_with_total(
            spark.createDataFrame(cand, "token string, cand int"),
            spark.createDataFrame(known, "token string, image_id int"),
            leads=0,
        ).count()
        visits[n] = sum(seen)
    assert visits[400] < 2 * 200 and visits[4_000] < 4 * 2_000


def test_few_rows_for_common_tokens(spark, monkeypatch):
    """Every token in a fifth of all items: rows stay far from all pairs."""
    made = []
    inner = votes.best_by_blocks
    monkeypatch.setattr(votes, "best_by_blocks", lambda *a: made.append(inner(*a)) or made[-1])
    n = 3_000
    cand, known = common_bags(8, n, 40, 8), common_bags(9, n, 40, 8)
    got = best_with_total(
        spark.createDataFrame(cand, "token string, cand int"),
        spark.createDataFrame(known, "token string, image_id int"),
        leads=2_000,
    )
    assert got.count() == n and made[0].count() <= 3 * n
