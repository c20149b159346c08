"""The mix against plain water-filling and the cube's invariants."""

import random

import pytest

from lookalike.llm import mixing


def plain_targets(size_of, most=3):
    """Reshare the excess by weight until no source is above."""
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    goal, free, left = {}, set(names), float(sum(size_of.values()))
    while free:
        factor = left / sum(weight[s] for s in free)
        above = {s for s in free if factor * weight[s] > most * size_of[s]}
        if not above:
            return goal | {s: factor * weight[s] for s in free}
        for s in above:
            goal[s] = float(most * size_of[s])
            left -= goal[s]
        free -= above
    return goal


def corpus(seed, n=3000):
    r = random.Random(seed)
    names = ["a", "B", "é", "zz", None, "tiny", "empty"]
    rows = []
    for i in range(n):
        source = r.choices(names, [30, 3, 10, 2, 5, 1, 1])[0]
        words = 0 if source == "empty" else r.choice([0, 1, 5, 40, 300])
        rows.append((i, None if r.random() < 0.02 else "w " * words, source, i))
    return rows + rows[:4] + [(None, "x y z", "a", 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_limits_and_balance(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.decide(df, block_rows=1000).collect()
    assert len(got) == len(rows)
    size_of = {}
    for _, text, source, _ in rows:
        size_of[source] = size_of.get(source, 0) + len((text or "").split())
    goal = plain_targets(size_of)
    taken, largest = {}, {}
    for r in got:
        assert r.source_size == size_of[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
        wanted = r.target / r.source_size if r.source_size else 0
        assert abs(r.copies - wanted) < 1 + 1e-9
    for source, target in goal.items():
        assert abs(taken[source] - target) <= 150  # half a document
    again = mixing.decide(df.repartition(7), block_rows=1000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_repeats_rows(spark):
    df = spark.createDataFrame(corpus(3), "doc_id long, text string, source string, size long")
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in mixing.decide(df).collect())
    with pytest.raises(ValueError):
        mixing.decide(df, block_rows=5)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.report(df.limit(0)).count() == 0


def test_columns_under_internal_names_stay(spark):
    """Rows come out whole, repeated ones as often as was decided for them together."""
    names = ["copies", "of", "_id", "_digest", "_n", "_copy", "row", "rows", "whole", "told", "origin", "id", "digest", "size", "target", "of_id", "copy"]
    r = random.Random(5)
    rows = [(i, "w " * r.choice([3, 30]), r.choice(["a", "b", None]), *[r.choice([i, None]) for _ in names]) for i in range(200)]
    rows += rows[:9] * 3 + [(None, "one text", None, *[1] * len(names))] * 40 + [(None, "one text", "a", *[2] * len(names))] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    got = [tuple(x) for x in mixed.collect()]
    decided = mixing.decide(df).collect()
    key = lambda doc, text, source: str((doc, source, len(text.split())))
    want, have, most = {}, {}, {}
    for x in decided:
        k = str((x.doc_id, x.source, x.size))
        want[k] = want.get(k, 0) + x.copies
        most[k] = most.get(k, 0) + 3
    for x in got:
        assert x in rows
        have[key(*x[:3])] = have.get(key(*x[:3]), 0) + 1
    assert have == {k: n for k, n in want.items() if n} and all(have[k] <= most[k] for k in have)
    again = [tuple(x) for x in mixing.mix(df.repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(again, key=str)


def test_flight_keeps_both_totals_and_the_chances():
    r = random.Random(0)
    sizes = sorted((r.choice([1, 2, 7, 30]) for _ in range(90)), reverse=True)
    chances = [r.random() for _ in sizes]
    sums = [0.0] * len(sizes)
    for trial in range(2000):
        out = mixing.fly(sizes, chances, random.Random(trial), False)
        assert sum(0 < c < 1 for c in out) <= 2 + 8 * 4
        assert sum(out) == pytest.approx(sum(chances), abs=1e-5)
        assert sum(c * s for c, s in zip(out, sizes)) == pytest.approx(sum(c * s for c, s in zip(chances, sizes)), abs=1e-4)
        sums = [a + c for a, c in zip(sums, out)]
    assert all(abs(s / 2000 - c) < 0.06 for s, c in zip(sums, chances))
