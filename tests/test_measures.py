import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import lattice, md5, regions, uniform
from lookalike.functions.arrays import positions, quantile_of_sorted
from lookalike.functions.arrays import uniform as spark_uniform
from lookalike.functions.tokens import block_tokens, token_ngrams
from lookalike.operators import measures
from lookalike.operators.measures import (
    as_covariance,
    band_covariance,
    band_percentiles,
    color_centroids,
    pca_measures,
    phash_tokens,
    pixel_covariance,
)
from lookalike.operators.perturb import block_median_fuzz
from lookalike.operators.ranking import group_percentiles, top_rows
from lookalike.operators.regions import region_tokens
from lookalike.operators.selections import resize, select_all, select_patches, to_rgb

SELECTION = "image_id int, sel_id int, is_full boolean, width int, height int, bands array<array<double>>"


def picture(rng, width, height, n_bands=3, levels=None):
    draw = (lambda: float(rng.randrange(levels))) if levels else rng.random
    return [[draw() for _ in range(width * height)] for _ in range(n_bands)]


@pytest.fixture(scope="module")
def pictures(spark):
    rng = random.Random(3)
    sizes = [(5, 4), (4, 4), (7, 3), (1, 6)]
    rows = [(i, 0, True, w, h, picture(rng, w, h)) for i, (w, h) in enumerate(sizes)]
    rows.append((9, 0, True, 4, 4, [[1.0] * 16] * 3))
    return rows, spark.createDataFrame(rows, SELECTION)


def one(df, column):
    return df.select(column.alias("v")).first().v


def test_blocks_and_ngrams_keep_the_last(spark):
    df = spark.range(1)
    blocks = lambda n, **k: one(df, block_tokens(F.lit("1" * n), 256, **k))
    assert [len(blocks(n)) for n in (1152, 1024, 256, 100)] == [5, 4, 1, 1]
    assert [len(blocks(n, keep_last=False)) for n in (1152, 1024, 256)] == [4, 3, 0]
    letters = F.array(*[F.lit(c) for c in "abcd"])
    assert one(df, token_ngrams(letters, 2)) == ["a-b", "b-c", "c-d"]
    assert one(df, token_ngrams(letters, 2, keep_last=False)) == ["a-b", "b-c"]
    assert one(df, token_ngrams(letters, 4)) == ["a-b-c-d"]
    assert one(df, positions(F.lit(0))) == []


def test_uniform_is_the_hash(spark):
    assert one(spark.range(1), spark_uniform(7, "x", 12)) == uniform(7, "x", 12)


def test_percentiles_and_covariance(pictures):
    rows, df = pictures
    got = {r.image_id: r for r in band_covariance(band_percentiles(df, (5, 50, 95))).collect()}
    for image, *_, bands in rows:
        expected = [np.percentile(b, (5, 50, 95)) for b in bands]
        assert np.allclose(got[image].histo, np.concatenate(expected))
        cov = np.cov(np.array(bands))
        assert np.allclose(list(got[image]["cov"]), cov[np.triu_indices(3)])


def test_phash_tokens(pictures):
    rows, df = pictures
    got = {r.image_id: r.phash for r in phash_tokens(df, 4).collect()}
    for image, *_, bands in rows[:4]:
        r, g, b = (np.array(x) for x in bands)
        light = 0.21 * r + 0.72 * g + 0.07 * b
        bits = "".join("1" if v >= light.mean() else "0" for v in light)
        count = -(-len(bits) // 4)
        assert got[image] == [md5(bits[i * 4 : i * 4 + 4]) for i in range(count)]


@pytest.mark.parametrize(
    "matrix",
    [
        np.diag([3.0, 2.0, 1.0]),
        np.diag([1.0, 2.0, 2.0]),
        np.diag([2.0, 2.0, 1.0]),
        np.eye(3),
        np.zeros((3, 3)),
        np.outer([1.0, -2.0, 3.0], [1.0, -2.0, 3.0]),
        np.cov(np.random.default_rng(1).normal(size=(3, 50))),
        np.cov(np.random.default_rng(2).normal(size=(3, 4))) * 1e-6,
    ],
)
def test_principal_components(spark, matrix):
    upper = [float(v) for v in matrix[np.triu_indices(3)]]
    df = spark.createDataFrame([upper], "xx double, xy double, xz double, yy double, yz double, zz double")
    row = pca_measures(as_covariance(df)).first()
    values, vectors = np.array(row.pca_var), np.array(row.pca_fac).reshape(3, 3)
    scale = max(1e-30, np.abs(matrix).max())
    assert np.allclose(values / scale, np.linalg.eigvalsh(matrix)[::-1] / scale, atol=1e-7)
    assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-7)
    assert np.allclose((vectors @ matrix).T / scale, vectors.T * values / scale, atol=1e-6)
    for v in vectors:
        assert v[np.argmax(np.abs(v).round(9))] > 0


def test_grouped_covariance_matches_the_wide_one(spark, pictures):
    rows, df = pictures
    pixels = [(i, *p) for i, *_, bands in rows for p in zip(*bands)]
    long = spark.createDataFrame(pixels, "image_id int, r double, g double, b double")
    wide = {r.image_id: list(r["cov"]) for r in band_covariance(df).collect()}
    for r in pixel_covariance(long, "image_id").collect():
        assert np.allclose([r.xx, r.xy, r.xz, r.yy, r.yz, r.zz], wide[r.image_id])


def bilinear(band, width, height, new_w, new_h):
    grid, out = np.array(band).reshape(height, width), np.empty((new_h, new_w))
    for r in range(new_h):
        for c in range(new_w):
            y = min(max((r + 0.5) * height / new_h - 0.5, 0), height - 1)
            x = min(max((c + 0.5) * width / new_w - 0.5, 0), width - 1)
            y0, x0 = int(y), int(x)
            y1, x1 = min(y0 + 1, height - 1), min(x0 + 1, width - 1)
            top = grid[y0, x0] * (1 - (x - x0)) + grid[y0, x1] * (x - x0)
            low = grid[y1, x0] * (1 - (x - x0)) + grid[y1, x1] * (x - x0)
            out[r, c] = top * (1 - (y - y0)) + low * (y - y0)
    return out.ravel()


def test_resize(pictures):
    rows, df = pictures
    got = {r.image_id: r for r in resize(df, 6, 2.0).collect()}
    for image, _, _, w, h, bands in rows:
        new_w = max(1, int(6 * w / h + 0.5))
        assert (got[image].width, got[image].height) == (new_w, 6)
        for mine, band in zip(got[image].bands, bands):
            assert np.allclose(mine, bilinear(band, w, h, new_w, 6) / 2)


def test_resized_length_of_the_worked_example(spark):
    df = spark.createDataFrame([(1, 0, True, 180, 200, [[0.0] * 36000])], SELECTION)
    row = resize(df, 32).first()
    assert (row.height, row.width, len(row.bands[0])) == (32, 29, 928)


def test_selections_cut_the_right_windows(spark):
    grid = [float(i) for i in range(35)]
    df = spark.createDataFrame([(1, 7, 5, [grid])], "image_id int, width int, height int, bands array<array<double>>")
    rows = {r.sel_id: r for r in select_all(df, 3, (0.5, 0.5), 0, quadrants=True).collect()}
    assert sorted(rows) == list(range(8)) and rows[0].is_full
    quarters = [rows[i].bands[0] for i in range(4, 8)]
    assert sorted(v for q in quarters for v in q) == grid
    assert quarters[0][:4] == [0, 1, 2, 3] and quarters[1][:3] == [4, 5, 6]
    for i in (1, 2, 3):
        assert (rows[i].width, rows[i].height) == (3, 2) and not rows[i].is_full
        r0, c0 = int(uniform(0, 1, i, "row") * 4), int(uniform(0, 1, i, "col") * 5)
        expected = [grid[(r0 + y) * 7 + c0 + x] for y in range(2) for x in range(3)]
        assert rows[i].bands[0] == expected


def test_no_more_patches_than_places(spark):
    df = spark.createDataFrame([(1, 2, 1, [[1.0, 2.0]])], "image_id int, width int, height int, bands array<array<double>>")
    assert select_patches(df, 9, (0.5, 1.0)).count() == 2


def test_bands_become_three(spark):
    df = spark.createDataFrame(
        [(n, [[3.0 * (i + 1)] for i in range(n)]) for n in (1, 2, 3, 4)],
        "n int, bands array<array<double>>",
    )
    got = {r.n: r.bands for r in to_rgb(df).collect()}
    assert got[1] == got[2] == [[1.0]] * 3
    assert got[3] == got[4] == [[3.0], [6.0], [9.0]]


def test_centroids(pictures):
    rows, df = pictures
    got = {r.image_id: r.cen for r in color_centroids(df, 3, 4, 12).collect()}
    for image, sel, _, w, h, bands in rows:
        order = sorted(range(w * h), key=lambda p: (md5(f"0|{image}|{sel}|{p}"), p))[:12]
        px = np.array([[b[p] for b in bands] for p in order])
        centers = px[[min(i, len(px) - 1) for i in range(3)]]
        for _ in range(4):
            near = ((px[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
            centers = np.array(
                [px[near == i].mean(0) if (near == i).any() else centers[i] for i in range(3)]
            )
        ordered = sorted(centers.tolist(), key=lambda c: (c[0] * 0.21 + c[1] * 0.72 + c[2] * 0.07, c))
        assert np.allclose(got[image], np.concatenate(ordered))


@pytest.mark.parametrize("levels", [None, 3])
def test_regions_match_the_plain_version(spark, levels):
    rng = random.Random(11)
    rows = [
        (i, 0, True, w, h, picture(rng, w, h, levels=levels))
        for i, (w, h) in enumerate([(4, 3), (3, 3), (5, 2), (1, 1)])
    ]
    rows.append((7, 0, True, 3, 3, [[2.0] * 9] * 3))
    df = spark.createDataFrame(rows, SELECTION)
    got = {r.image_id: r.ward for r in region_tokens(df, 4).collect()}
    for image, _, _, w, h, bands in rows:
        values = [bands[i % 3][i // 3] for i in range(w * h * 3)]
        assert got[image] == regions(values, 4, lattice(w * h)), image


def test_regions_on_the_picture_grid(spark):
    # two flat halves, left and right: the grid keeps them as two regions
    band = [0.0, 0.0, 9.0, 9.0] * 3
    df = spark.createDataFrame([(1, 0, True, 4, 3, [band] * 3)], SELECTION)
    tokens = region_tokens(df, 2, adjacency="grid2d").first().ward
    left = [p * 3 + c for p in range(12) if p % 4 < 2 for c in range(3)]
    right = [p * 3 + c - 6 for p in range(12) if p % 4 >= 2 for c in range(3)]
    assert tokens == [md5(",".join(map(str, half))) for half in (left, right)]


def test_fuzz_leaves_the_last_blocks_alone(spark):
    rng = random.Random(2)
    bands = picture(rng, 8, 7, 2)
    df = spark.createDataFrame([(5, 8, 7, bands)], "image_id int, width int, height int, bands array<array<double>>")
    for chance in (0.0, 0.6, 1.0):
        got = block_median_fuzz(df, 2, chance, 3).first().bands
        for mine, band in zip(got, bands):
            grid = np.array(band).reshape(7, 8)
            for r in range(0, 7 - 2, 2):
                for c in range(0, 8 - 2, 2):
                    if uniform(3, 5, r // 2, c // 2) < chance:
                        grid[r : r + 2, c : c + 2] = np.median(grid[r : r + 2, c : c + 2])
            assert np.allclose(mine, grid.ravel())


def test_fuzz_leaves_alpha_alone(spark):
    rng = random.Random(6)
    bands = [[float(rng.randrange(256)) for _ in range(144)] for _ in range(4)]
    df = spark.createDataFrame([("a", 12, 12, bands)], "image_id string, width int, height int, bands array<array<double>>")
    got = block_median_fuzz(df, 3, 1.0, 3).first().bands
    assert got[3] == bands[3] and all(got[i] != bands[i] for i in range(3))


def test_group_percentiles_of_a_hot_group(spark):
    rng = random.Random(4)
    rows = [(0, round(rng.random() * 50, 2)) for _ in range(900)] + [(1, 4.0), (2, -1.5), (2, 7.25)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = group_percentiles(df, ["g"], "v", (0, 5, 50, 99, 100), 0.7).collect()
    for r in got:
        values = [v for g, v in rows if g == r.g]
        assert r.pct == pytest.approx(np.percentile(values, r.q))
    assert len(got) == 15


def test_top_rows_is_exact(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(2), rng.randrange(4), md5(str(i))) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, n int, token string").withColumn("head", F.substring("token", 1, 1))
    for cap in (1, 7, 60, 1000):
        top = top_rows(df, ["g"], cap, ["n", "head"], [F.desc("n"), F.col("head")], [F.col("token")])
        expected = set()
        for g in (0, 1):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
            expected |= set(mine[:cap])
        assert {(r.g, r.n, r.token) for r in top.collect()} == expected


def test_quantile_of_sorted(spark):
    values = [1.0, 2.0, 4.0, 8.0]
    column = F.array(*[F.lit(v) for v in values])
    for q in (0.0, 0.3, 0.5, 1.0):
        assert one(spark.range(1), quantile_of_sorted(column, q)) == pytest.approx(np.quantile(values, q))


def test_word_ngrams_are_not_summed_before_their_shuffle(spark):
    docs = spark.createDataFrame([(3, "a b  c a b c"), (1, "b c a"), (2, None), (4, "a b")], "doc_id long, text string")
    counts = measures.word_ngram_counts(docs, "text", 3, "doc_id")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan.split("Exchange")[1]
    assert {tuple(r) for r in counts.collect()} == {("a-b-c", 2, 3), ("b-c-a", 2, 1), ("c-a-b", 1, 3)}
