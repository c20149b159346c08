"""Top-k against all scores on small inputs."""

import random

import pytest

from lookalike.llm import topk


def plain(rows, asked, k):
    found = []
    for q in sorted({q for q, _ in asked if q is not None}):
        v = min(v for i, v in asked if i == q)
        scored = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in rows if i is not None and i != q)
        found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(found)


@pytest.mark.parametrize("spread,pivots", [(3, 4), (1000, 8), (10**7, 3)])
def test_equals_all_scores(spark, monkeypatch, spread, pivots):
    monkeypatch.setattr(topk, "CHUNK_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    r = random.Random(spread)
    middles = [[r.randint(-spread, spread) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + r.randint(-2, 2) for x in r.choice(middles)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(300, []), (301, [1, 2]), (None, [1] * 6), rows[3]]
    asked = rows[::7] + [rows[0], (0, [spread] * 6), (0, [-spread] * 6)]
    tables = [spark.createDataFrame(t, "id long, v array<long>") for t in (rows, asked)]
    assert sorted(map(tuple, topk.top_k(*tables, k=5, pivots=pivots).collect())) == plain(rows, asked, 5)


def test_few_rows_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (50, [0.001, 2.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, None), (10, [None, 1.0]), (11, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v")
    ints = {0: [256, -128], 50: [0, 512], 11: [768, 768]}
    want = plain(list(ints.items()), [(0, ints[0]), (50, ints[50])], 5)
    assert sorted(map(tuple, topk.report(df).collect())) == want
    assert topk.report(df.limit(0)).count() == 0


def test_far_data_stay_away(spark):
    """With separate clusters most rows serve their own cell only."""
    r = random.Random(9)
    rows = []
    for i in range(400):
        middle = [0] * 4
        middle[i % 4] = 10_000
        rows.append((i, [x + r.randint(-5, 5) for x in middle]))
    table = spark.createDataFrame(rows, "id long, v array<long>")
    asked = table.where("id < 8")
    assert sorted(map(tuple, topk.top_k(table, asked, 3, 16).collect())) == plain(rows, rows[:8], 3)
