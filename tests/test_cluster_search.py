import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import best_of, literal_votes
from lookalike.config import LOOKUP_TABLES, Config
from lookalike.operators.cluster import (
    cluster_items,
    cluster_token_counts,
    cluster_top_tokens,
    nearest_center,
    token_cap,
    token_heavy_hitters,
)
from lookalike.operators.explore import (
    histo_median,
    lowest_by_median,
    mean_color_bins,
    moment_ratio,
    pair_join,
    random_pairs,
    word_count,
)
from lookalike.operators.lookups import token_lookup, token_lookups
from lookalike.operators.search import as_candidates
from lookalike.plans.search import find_similar

ITEM = "image_id int, sel_id int, features array<double>, phash array<string>, ward array<string>"


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(30):
        for sel in (0, 1):
            phash = [f"p{v}" for v in rng.integers(0, 4, 5)]
            ward = [f"w{v}" for v in rng.integers(0, 5, 3)]
            rows.append((i, sel, [float(v) for v in rng.normal(i % 3, 0.2, 4)], phash, ward))
    return rows, spark.createDataFrame(rows, ITEM)


def test_kmeans_matches_numpy(items):
    rows, df = items
    fit = cluster_items(df, 3, 4)
    assert fit.fit_stats.first().rounds == 4
    x = np.array([r[2] for r in rows])
    import hashlib

    order = sorted(range(len(rows)), key=lambda i: hashlib.md5(f"1|{rows[i][0]}|{rows[i][1]}".encode()).hexdigest())
    centers = x[order[:3]]
    for _ in range(4):
        near = ((x[:, None] - centers) ** 2).sum(-1).argmin(1)
        centers = np.array([x[near == i].mean(0) if (near == i).any() else centers[i] for i in range(3)])
    assert np.allclose(fit.points, centers)
    near = ((x[:, None] - centers) ** 2).sum(-1)
    # sizes and sse are those of the final centres
    assert {r.cluster_id: r.n for r in fit.centers.collect()} == {i: int((near.argmin(1) == i).sum()) for i in range(3)}
    assert abs(fit.fit_stats.first().sse - near.min(1).sum()) < 1e-9
    early = cluster_items(df, 3, 9, converge=1e9).fit_stats.first()
    assert early.rounds == 1


def test_equal_distance_goes_to_the_lower_cluster(spark):
    df = spark.createDataFrame([(1, 0, [0.0], [], [])], ITEM)
    assert nearest_center(df, [(1.0,), (-1.0,)]).first().cluster_id == 0


def test_lookup_tables_in_both_directions_agree(items):
    _, df = items
    assigned = nearest_center(df, [(0.0,) * 4, (1.0,) * 4, (2.0,) * 4])
    tables = token_lookups(assigned)
    assert set(tables) == set(LOOKUP_TABLES) and len(tables) == 14
    for name in LOOKUP_TABLES:
        left, right = name.split("_to_")
        back = f"{right}_to_{left}"
        if back in LOOKUP_TABLES:
            columns = sorted(tables[name].columns)
            a = sorted(map(str, tables[name].select(*columns).collect()))
            b = sorted(map(str, tables[back].select(*columns).collect()))
            assert a == b and a
    with pytest.raises(ValueError):
        token_lookup(assigned, "key_to_ward")


def test_token_counts(items):
    rows, df = items
    assigned = nearest_center(df, [(0.0,) * 4, (2.0,) * 4])
    counts = cluster_token_counts(assigned)
    assert counts.where("kind = 'phash'").agg(F.sum("n")).first()[0] == 5 * len(rows)
    top = cluster_top_tokens(counts, "ward", 1, 3).collect()
    assert len(top) == 3 and [r.n for r in top] == sorted((r.n for r in top), reverse=True)
    exact = {(r.cluster_id, r.token): r.n for r in counts.where("kind = 'ward'").collect()}
    for buckets in (4096, 7, 1):
        got = token_heavy_hitters(assigned, "ward", 3, buckets, opened=1).collect()
        for cluster in (0, 1):
            mine = [r for r in got if r.cluster_id == cluster]
            ranked = sorted((-n, t) for (c, t), n in exact.items() if c == cluster)
            assert all(exact[cluster, r.token] == r.n for r in mine)
            missed = [-n for n, t in ranked if t not in {r.token for r in mine}]
            assert all(max(missed, default=0) <= min(r.n for r in mine) + r.error for r in mine)
            if mine[0].error == 0:
                assert sorted(-r.n for r in mine) == [n for n, _ in ranked[:3]]


def test_heavy_hitters_are_certain_where_counters_are_many(items):
    _, df = items
    assigned = nearest_center(df, [(0.0,) * 4, (2.0,) * 4])
    counts = cluster_token_counts(assigned).where("kind = 'ward'")
    got = sorted((r.cluster_id, -r.n, r.token, r.error) for r in token_heavy_hitters(assigned, "ward", 4).collect())
    want = []
    for cluster in (0, 1):
        ranked = sorted((-r.n, r.token) for r in counts.where(f"cluster_id = {cluster}").collect())
        want += [(cluster, n, t, 0) for n, t in ranked[:4]]
    assert got == want


def test_caps_differ_between_kinds(items):
    _, df = items
    counts = cluster_token_counts(nearest_center(df, [(0.0,) * 4, (2.0,) * 4]))
    caps = {"phash": 3, "ward": 2}
    rows = counts.collect()
    want = []
    for kind, cap in caps.items():
        for cluster in (0, 1):
            mine = sorted((-r.n, r.token) for r in rows if (r.kind, r.cluster_id) == (kind, cluster))
            want += [(kind, cluster, t, -n) for n, t in mine[:cap]]
    got = token_cap(counts, caps)
    assert sorted((r.kind, r.cluster_id, r.token, r.n) for r in got.collect()) == sorted(want)


def test_plans_do_not_grow_with_the_centres(items):
    rows, df = items
    size = lambda points: str(nearest_center(df, points)._jdf.queryExecution().analyzed()).count("\n")
    many = [tuple(float(i + j) for j in range(4)) for i in range(2_000)]
    assert size(many) == size(many[:2])
    got = {(r.image_id, r.sel_id): r.cluster_id for r in nearest_center(df, many).collect()}
    x, c = np.array([r[2] for r in rows]), np.array(many)
    assert [got[r[0], r[1]] for r in rows] == ((x[:, None] - c) ** 2).sum(-1).argmin(1).tolist()


def plain_search(rows, cands, points, mode):
    """Three picks per candidate selection, then the two joins written out."""
    def near(f):
        return int(np.argmin([sum((a - b) ** 2 for a, b in zip(f, p)) for p in points]))

    def grams(t):
        return [f"{a}-{b}" for a, b in zip(t, t[1:])]

    cluster = {(r[0], r[1]): near(r[2]) for r in rows}
    out = {}
    for kind, single, tokens in (("phash", 3, lambda r: grams(r[3])), ("ward", 4, lambda r: r[4])):
        cluster_rows = [(cluster[r[0], r[1]], t) for r in rows for t in tokens(r)]
        key_rows = [(t, r[0]) for r in rows for t in tokens(r)]
        asked = []
        for c in cands:
            picks = []
            for column in (3, 4):
                score = [
                    sum(r[column].count(t) for r in rows if cluster[r[0], r[1]] == k for t in c[column])
                    for k in range(len(points))
                ]
                picks.append(int(np.argmax(score)))
            picks.append(near(c[2]))
            asked += [(k, t, c[0]) for k in picks for t in tokens(c)]
        if mode == "weighted":
            out[kind] = literal_votes(asked, cluster_rows, key_rows)
        else:
            both = [((cluster[r[0], r[1]], t), r[0]) for r in rows for t in tokens(r)]
            out[kind] = literal_votes([(0, (k, t), c) for k, t, c in asked], [(0, "")], both)
    return out


@pytest.mark.parametrize("mode", ["weighted", "strict"])
def test_search_matches_the_literal_joins(spark, items, mode):
    rows, df = items
    cands = [(100 + r[0], r[1], r[2], r[3][:4] + ["new"], r[4]) for r in rows[:14]]
    points = [(0.0,) * 4, (1.0,) * 4, (2.0,) * 4]
    assigned = nearest_center(df, points)
    found = find_similar(
        assigned,
        cluster_token_counts(assigned),
        points,
        as_candidates(spark.createDataFrame(cands, ITEM)),
        Config(vote_mode=mode),
    )
    expected = plain_search(rows, cands, points, mode)
    for kind in ("phash", "ward"):
        votes = {(r.cand, r.image_id): r.votes for r in found.votes(kind).collect()}
        assert votes == dict(expected[kind])
        best = {r.cand: (r.best_match, r.agree_count, r.total) for r in found.best(kind).collect()}
        assert best == best_of(expected[kind])
    fused = {r.cand: (r.best_match, r.agree_count, r.total) for r in found.fused().collect()}
    assert fused == best_of(expected["phash"] + expected["ward"])


def test_an_unchanged_item_votes_for_itself_in_strict_mode(items):
    rows, df = items
    points = [(0.0,) * 4, (2.0,) * 4]
    assigned = nearest_center(df, points)
    found = find_similar(
        assigned, cluster_token_counts(assigned), points, as_candidates(df), Config(vote_mode="strict")
    )
    own = {r.cand for r in found.votes("ward").where("cand = image_id").collect()}
    assert own == {r[0] for r in rows}


# a repeated key on one side, and null keys, which match nothing
LIST_A, LIST_B = [(2, 20), (2, 21), (None, 22), (9, 23)], [(2, 30), (None, 31), (4, 32)]
BOTH = {(2, 20, 30), (2, 21, 30)}
ONLY_A = {(None, 22, None), (9, 23, None)}
ONLY_B = {(None, None, 31), (4, None, 32)}


@pytest.mark.parametrize(
    "left, how, expected",
    [
        ("a", "inner", BOTH),
        ("b", "inner", BOTH),
        ("a", "right_outer", {*BOTH, *ONLY_B}),
        ("b", "left_outer", {*BOTH, *ONLY_B}),
        ("b", "right_outer", {*BOTH, *ONLY_A}),
        ("a", "left_outer", {*BOTH, *ONLY_A}),
        ("a", "full_outer", {*BOTH, *ONLY_A, *ONLY_B}),
    ],
)
def test_seven_joins(spark, left, how, expected):
    a = spark.createDataFrame(LIST_A, "k int, va int")
    b = spark.createDataFrame(LIST_B, "k int, vb int")
    joined = pair_join(a, b, "k", how) if left == "a" else pair_join(b, a, "k", how)
    assert {(r.k, r.va, r.vb) for r in joined.collect()} == expected


def test_word_count(spark):
    texts = ["a red fox", "the fox saw a  hare", "", None, "Fox and hare"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = dict(tuple(r) for r in word_count(df).collect())
    assert {w: rows[w] for w in ("a", "fox", "hare", "Fox", "red")} == {"a": 2, "fox": 2, "hare": 2, "Fox": 1, "red": 1}


def test_small_explorations(spark):
    assert random_pairs(spark).count() == 100
    assert random_pairs(spark).collect() == random_pairs(spark.newSession()).collect()
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (4.0, 1.0)], "x double, y double")
    row = moment_ratio(pairs).first()
    assert row.ratio == pytest.approx(12 / (14 * 21))
    histo = spark.createDataFrame(
        [(i, [float(v + i) for v in range(21)]) for i in range(8)], "image_id int, histo array<double>"
    )
    medians = histo_median(histo)
    assert [r.median for r in medians.where("image_id = 0").orderBy("band").collect()] == [3, 10, 17]
    assert histo_median(histo, shift=1).where("image_id = 0 AND band = 0").first().median == 4
    low = lowest_by_median(medians, 5).where("band = 2").orderBy("place").collect()
    assert [r.image_id for r in low] == [0, 1, 2, 3, 4]
    pixels = spark.createDataFrame([("a", 87.0), ("b", 85.0), ("c", 91.0)], "f string, r double")
    bins = [tuple(r) for r in mean_color_bins(pixels, "f", ["r"]).collect()]
    assert bins == [("r", 85, "a", 2), ("r", 85, "b", 2), ("r", 90, "c", 1)]
