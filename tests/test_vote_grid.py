"""The best match by a grid of blocks against plain counting."""

import random

import pytest

from brute import best_of, literal_votes
from lookalike.operators import vote_grid, votes
from lookalike.operators.votes import best_with_total


def bags(seed, owners, kinds, lengths, clusters, name):
    """cluster, token, owner: a bag of some length in every cluster of an owner."""
    rng = random.Random(seed)
    return [
        (cluster, f"t{rng.randrange(kinds)}", name(o))
        for o in range(owners)
        for cluster in rng.sample(range(5), clusters)
        for _ in range(rng.choice(lengths))
    ]


def plain(cand, known):
    return best_of(literal_votes([(0, f"{c}/{t}", o) for c, t, o in cand], [(0, "any")], [(f"{c}/{t}", o) for c, t, o in known]))


def found(spark, cand, known, key="string"):
    rows = best_with_total(
        spark.createDataFrame(cand, f"cluster_id int, token string, cand {key}"),
        spark.createDataFrame(known, f"cluster_id int, token string, image_id {key}"),
        ("cluster_id", "token"),
    ).collect()
    return {r.cand: (r.best_match, r.agree_count, r.total) for r in rows}


@pytest.fixture
def no_rows(monkeypatch):
    def made(*_):
        raise AssertionError("rows of pairs or subsets")

    for name in ("best_by_subsets", "_by_leads", "_pair_votes"):
        monkeypatch.setattr(votes, name, made)


@pytest.mark.parametrize("kinds, lengths, pieces", [(9, (7,), 256), (4, (1, 3, 9), 256), (400, (12,), 256), (30, (1, 20), 3)])
def test_long_bags_of_common_tokens_make_no_rows_of_pairs(spark, monkeypatch, no_rows, kinds, lengths, pieces):
    """Candidates have bags in three clusters, items in one, as in strict mode."""
    monkeypatch.setattr(vote_grid, "OWNERS", 16)
    monkeypatch.setattr(vote_grid, "PIECE", pieces)
    cand = bags(1, 50, kinds, lengths, 3, lambda o: f"c{o}")
    known = bags(2, 90, kinds, lengths, 1, lambda o: f"k{o}é") + [(None, "t1", "k1é"), (1, None, "k2é"), (1, "none", None)]
    cand += [(None, "t1", "c1"), (1, None, "c2"), (1, "t1", None)]
    named = [[r for r in side if None not in r] for side in (cand, known)]
    assert found(spark, cand, known) == plain(*named)


def test_the_lower_key_wins_across_blocks(spark, monkeypatch, no_rows):
    monkeypatch.setattr(vote_grid, "OWNERS", 3)
    known = [(0, t, o) for o in range(-4, 40) for t in ("a", "b", f"own{o}")]
    assert found(spark, [(0, "a", 1), (0, "b", 1), (0, "b", 2)], known, "bigint") == {1: (-4, 2, 88), 2: (-4, 1, 44)}


def test_items_of_many_blocks_go_the_other_ways(spark, monkeypatch):
    monkeypatch.setattr(vote_grid, "OWNERS", 8)
    monkeypatch.setattr(vote_grid, "MEETINGS", 2)
    asked, inner = [], votes.best_by_subsets
    monkeypatch.setattr(votes, "best_by_subsets", lambda *a: asked.append(1) or inner(*a))
    cand, known = bags(3, 20, 9, (5,), 1, int), bags(4, 30, 9, (5,), 1, int)
    assert found(spark, cand, known, "int") == plain(cand, known) and asked


@pytest.mark.parametrize("work", ["_Best", "_All"])
def test_blocks_and_bags_may_be_cut_anywhere(work):
    import pyarrow as pa

    def rows(name, at, bag, is_item):
        return [{"_at": at, "_cand": None if is_item else name, "_key": name if is_item else None, "_ids": i, "_ns": n} for i, n in bag]

    items = [rows("x", 3, [([1, 2], [1, 2]), ([5], [1])], True), rows("y", 3, [([2], [1])], True), rows("z", 8, [([1], [4])], True)]
    cands = [rows("a", 3, [([1], [1]), ([2], [3])], False), rows("b", 3, [([2], [1])], False), rows("b", 8, [([2], [1]), ([1], [1])], False)]
    flat = [r for part in (items[0], items[1], cands[0], cands[1], items[2], cands[2]) for r in part]
    # a block of candidates without items
    flat += rows("c", 9, [([1], [1])], False)
    schema = pa.schema([("_at", pa.int32()), ("_cand", pa.string()), ("_key", pa.string()), ("_ids", pa.list_(pa.int64())), ("_ns", pa.list_(pa.int64()))])
    pairs = {("a", "x", 7), ("a", "y", 3), ("b", "x", 2), ("b", "y", 1), ("b", "z", 4)}
    want = pairs if work == "_All" else {("a", "x", 7), ("b", "x", 2), ("b", "z", 4)}
    for step in range(1, len(flat) + 1):
        batches = [pa.RecordBatch.from_pylist(flat[i : i + step], schema) for i in range(0, len(flat), step)]
        got = [r for b in vote_grid._passed(iter(batches), "cand", "key", getattr(vote_grid, work)) for r in b.to_pylist()]
        assert {(r["cand"], r["key"], int(r["votes"])) for r in got} == want and len(got) == len(want)


def test_lists_left_are_only_looked_up():
    """A token that all items own is not gone through once a rare one decides."""
    import pyarrow as pa

    n = 1000
    known = pa.table({"k": [*range(n), 7, 8], "_id": [0] * n + [1, 1], "n": [1] * n + [2, 2]})
    best = vote_grid._Best(known, "k")
    common = best.item[best.first[0] : best.first[1]]
    seen = []

    class Votes:
        def __getitem__(self, at):
            seen.append(len(at))
            return inner[at]

        def __setitem__(self, at, values):
            inner[at] = values

    inner, best.votes = best.votes, Votes()
    (rows,) = best.ask(pa.table({"c": ["a", "a"], "_id": [0, 1], "n": [1, 1]}), "c")
    assert [tuple(r.values()) for r in rows.to_pylist()] == [("a", 7, 3)] and len(common) == n and max(seen) == 2


def test_bags_do_not_travel_more_often_for_more_candidates(spark, monkeypatch):
    """Of all votes: items meet blocks of candidates, as many as the cores need."""
    monkeypatch.setattr(vote_grid, "WORTH", 2)
    monkeypatch.setattr(vote_grid, "OWNERS", 10)
    travelled, inner = [], vote_grid._meet
    monkeypatch.setattr(vote_grid, "_meet", lambda *a: travelled.append(a[4]) or inner(*a))
    for owners in (100, 600):
        cand, known = ([(f"t{i % 7}", o) for o in range(n) for i in range(o, o + 5)] for n in (owners, 20))
        rows = votes.vote_counts(
            spark.createDataFrame(cand, "token string, cand int"), spark.createDataFrame(known, "token string, image_id int")
        )
        want = sum(sum(u == t for u, _ in known) for t, _ in cand)
        assert rows.agg({"votes": "sum"}).first()[0] == want and rows.count() == owners * 20
    small, large = travelled
    assert small["items"] == large["items"] == 2 and small["cands"] == large["cands"] <= vote_grid.TASKS * spark.sparkContext.defaultParallelism


def test_weighted_bags_of_two_kinds_make_no_rows_of_pairs(spark, monkeypatch, no_rows):
    """As in weighted mode: tokens count as often as their cluster is large."""
    monkeypatch.setattr(vote_grid, "OWNERS", 16)
    cand, known = bags(5, 40, 6, (7,), 3, int), bags(6, 90, 6, (7,), 1, int)
    sizes = {cluster: 10**9 + 7 * cluster for cluster in range(5)}
    kinds = [
        votes.tagged({kind: spark.createDataFrame([(f"{kind}{t}", o, *more) for t, o, *more in rows], schema) for kind in ("phash", "ward")})
        for rows, schema in (
            ([(t, o, sizes[c]) for c, t, o in cand], "token string, cand int, n_b bigint"),
            ([(t, o) for _, t, o in known], "token string, image_id int"),
        )
    ]
    got = best_with_total(*kinds, ("kind", "token"), weight="n_b").collect()
    pairs = {}
    for c, t, o in cand:
        for _, u, i in known:
            if t == u:
                pairs[o, i] = pairs.get((o, i), 0) + 2 * sizes[c]
    for r in got:
        mine = {i: v for (o, i), v in pairs.items() if o == r.cand}
        assert (r.agree_count, -r.best_match) == max((v, -i) for i, v in mine.items()) and r.total == sum(mine.values())
    assert sorted(r.cand for r in got) == sorted({o for o, _ in pairs})
