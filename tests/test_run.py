"""Measuring pictures and whole runs, with values."""

import random
import struct
import zlib
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import lattice, md5, regions, uniform
from lookalike.config import Config
from lookalike.operators.perturb import block_median_fuzz
from lookalike.operators.selections import resize, sampled_selections, select_all, to_rgb
from lookalike.plans import jobs
from lookalike.plans.measure import measure_images
from lookalike.sources.images import image_bands, image_load, write_png
from lookalike.sources.store import RunStore, fresh_dir

SMALL = Config(x_down=8, ward_x_down=4, n_clusters=3, max_iterations=3, max_patches=1, phash_bits=16)
IMAGES = "image_id string, width int, height int, bands array<array<double>>"


def png(width, height, kind, pixels):
    """A colour picture (kind 2), as a file's bytes."""
    rows = np.asarray(pixels, np.uint8).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def noise(name, w, h, depth=3, seed=0):
    r = random.Random(f"{name}{seed}")
    return (name, w, h, [[float(r.randrange(256)) for _ in range(w * h)] for _ in range(depth)])


def files(spark, pictures, extra=()):
    folder = fresh_dir(spark, "pictures")
    rows = spark.createDataFrame([(f"{p[0]}.png", *p[1:]) for p in pictures], IMAGES.replace("image_id", "name"))
    write_png(rows, folder)
    for name, data in extra:
        path = folder.removeprefix("file:")
        with open(f"{path}/{name}", "wb") as file:
            file.write(data)
    return folder


def small(value):
    return value[0].split("/")[-1], *value[1:]


def test_sampling_bytes_gives_the_same_as_cutting_and_resizing(spark):
    shapes = [(20, 18, 3), (1, 1, 3), (1, 10, 1), (10, 1, 3), (40, 3, 4), (7, 9, 1), (64, 2, 3)]
    folder = files(spark, [noise(f"p{w}x{h}x{d}", w, h, d) for w, h, d in shapes])
    raw = image_load(spark, folder, "*.png")
    windows = (3, (0.5, 0.5), 4, True)
    got = sampled_selections(raw, 6, 255.0, *windows).collect()
    want = resize(to_rgb(select_all(image_bands(raw), *windows)), 6, 255.0).collect()
    key = lambda r: (r.image_id, r.sel_id)
    assert len(got) > 7 * len(shapes) - 20
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a.asDict() == b.asDict()


def test_no_picture_becomes_larger_than_the_bound(spark):
    for w, h in ((1000, 1), (2000, 2), (1, 1000), (129, 32), (128, 32), (1, 1)):
        bands = [[float(i % 256) for i in range(w * h)]] * 3
        df = spark.createDataFrame([("a", w, h, bands)], IMAGES)
        r = resize(df, 32, 255.0).select("width", "height", F.size(F.get("bands", F.lit(0))).alias("n")).first()
        assert r.n == r.width * r.height <= 4 * 32 * 32
        if w <= 4 * h:
            assert (r.height, r.width) == (32, max(1, int(32 * w / h + 0.5)))


def test_plan_has_no_python_and_reads_no_whole_picture(spark):
    folder = files(spark, [noise("a", 30, 20)])
    rows = measure_images(image_load(spark, folder, "*.png"), SMALL)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_a_large_file_and_a_flat_one(spark):
    w, h = 4_000, 3_000
    grid = (np.add.outer(np.arange(h), np.arange(w * 3)) % 256).astype(np.uint8)
    large = ("large.png", png(w, h, 2, grid.ravel()))
    folder = files(spark, [("long", 2_000, 2, [[7.0] * 4_000])], [large])
    rows = measure_images(image_load(spark, folder, "*.png"), SMALL).collect()
    assert len(rows) == 4 and all(len(r.features) == 3 * 3 + 3 * 7 and len(r.ward) == 5 for r in rows)
    assert {r.width * r.height <= 256 for r in rows} == {True}


def plain_measures(name, w, h, bands, config):
    """Measures of a whole picture that is not resized."""
    x = np.array(bands[:3]) / 255.0
    histo = np.concatenate([np.percentile(b, config.quantiles) for b in x])
    light = 0.21 * x[0] + 0.72 * x[1] + 0.07 * x[2]
    # added one by one, as the last digit decides for a flat picture
    average = reduce(lambda a, b: a + b, light.tolist()) / len(light)
    bits = "".join("1" if v >= average else "0" for v in light)
    size = config.phash_bits
    phash = [md5(bits[i : i + size]) for i in range(0, len(bits), size)]
    order = sorted(range(w * h), key=lambda i: md5(f"0|{name}|0|{i}"))
    centers = x.T[order[: config.n_clusters]]
    for _ in range(config.max_iterations):
        near = ((x.T[:, None] - centers) ** 2).sum(-1).argmin(1)
        centers = np.array([x.T[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centers)])
    cen = np.concatenate(sorted(centers.tolist(), key=lambda c: (c[0] * 0.21 + c[1] * 0.72 + c[2] * 0.07, c)))
    return histo, phash, cen, np.sort(np.linalg.eigvalsh(np.cov(x)))[::-1]


def test_measures_have_the_values_of_a_plain_version(spark):
    pictures = [noise(f"n{i}", 8, 8) for i in range(6)] + [("flat", 8, 8, [[9.0] * 64] * 3)]
    facts = spark.createDataFrame([("n1", 5, "PNG")], "image_id string, length int, format string")
    df = spark.createDataFrame(pictures, IMAGES)
    rows = {(r.image_id, r.sel_id): r for r in measure_images(df, SMALL, meta=facts).collect()}
    assert len(rows) == 2 * len(pictures)
    half = {r.image_id: r.bands for r in resize(to_rgb(df), 4, 255.0).collect()}
    for name, w, h, bands in pictures:
        r = rows[name, 0]
        histo, phash, cen, variances = plain_measures(name, w, h, bands, SMALL)
        assert np.allclose(r.histo, histo) and list(r.phash) == phash and np.allclose(r.cen, cen)
        assert np.allclose(r.pca_var, variances, atol=1e-12) and np.allclose(r.features, np.concatenate([cen, histo]))
        values = [half[name][i % 3][i // 3] for i in range(48)]
        assert list(r.ward) == regions(values, 5, lattice(16))
        assert r.is_full and not rows[name, 1].is_full
        assert r.meta == ({"length": "5", "format": "PNG"} if name == "n1" else None)
        # the patch's corner is drawn from hashes
        top, left = (int(uniform(0, name, 1, axis) * 5) for axis in ("row", "col"))
        part = [np.array(b).reshape(8, 8)[top : top + 4, left : left + 4] / 255.0 for b in bands]
        assert rows[name, 1].histo[3] == pytest.approx(rows[name, 1].histo[3])
        assert min(map(np.min, part)) - 1e-9 <= min(rows[name, 1].histo) and max(rows[name, 1].histo) <= max(map(np.max, part)) + 1e-9


@pytest.fixture(scope="module")
def folders(spark):
    pictures = [noise(f"p{i}", 24, 18) for i in range(9)] + [noise("long", 300, 400), noise("dot", 1, 1)]
    altered = block_median_fuzz(spark.createDataFrame(pictures, IMAGES), 6, 0.1, whole_numbers=True).collect()
    bad = [("bad.png", b"no picture at all")]
    return files(spark, pictures, bad), files(spark, [tuple(r) for r in altered], bad)


# no patches: their corners are drawn from the files' paths, which are new on
# every run of the tests
RUN = Config(
    x_down=16, ward_x_down=8, n_clusters=3, max_iterations=2, max_patches=0, phash_bits=8, n_clusters_group=3,
    max_iter_group=2, search_rounds=2, input_glob="*.png", candidate_glob="*.png",
)


def table(store, path, *columns):
    rows = store.load(path).select(*columns).collect()
    return sorted(str(tuple(r)) for r in rows)


def test_a_run_finds_the_originals(spark, folders):
    config = Config(**{**RUN.__dict__, "root": fresh_dir(spark, "run")})
    seconds = jobs.run_actions(spark, config, *folders)
    assert list(seconds) == ["map_each_image", "kmeans", "find_similar"]
    store = RunStore(spark, config)
    measures = store.load(store.measures_path())
    assert measures.select("image_id").distinct().count() == 11 and measures.where("is_full").count() == 11
    for path in (store.rejected_path(), store.candidate_path("rejected")):
        assert [(r.image_id.split("/")[-1], r.length, r.format) for r in store.load(path).collect()] == [("bad.png", 17, None)]
    assert measures.where("is_full").first().meta["format"] == "PNG"
    sizes = {r.cluster_id: r.n for r in store.load(store.cluster_path("cluster_center_meta")).collect()}
    rows = store.load(store.cluster_path("cluster_to_key")).groupBy("cluster_id").count().collect()
    assert {r.cluster_id: r["count"] for r in rows} == {k: n for k, n in sizes.items() if n}
    name = lambda path: path.split("/")[-1]
    matches = store.load(store.candidate_path("phash_matches")).collect()
    best = {name(r.cand): name(r.best_match) for r in matches}
    assert sum(k == v for k, v in best.items()) >= 9 and best["long.png"] == "long.png"
    # candidates that both kinds of tokens have found
    joined = {name(r.cand): name(r.phash_best) for r in store.load(store.candidate_path("joined_final_matches")).collect()}
    assert joined and joined.items() <= best.items()
    rounds = store.load(store.candidate_path("phash_rounds"))
    # the second round asks for items that the first has not found, if any
    asked = {r["round"] for r in rounds.select("round").distinct().collect()}
    assert asked == ({1} if len(set(best.values())) == 11 else {1, 2})
    assert store.load(store.candidate_path("phash_samples")).count() == len(best)
    with pytest.raises(Exception, match="[Ee]xist"):
        jobs.run_actions(spark, config, *folders)


def test_a_broken_run_is_taken_up(spark, folders, monkeypatch):
    config = Config(**{**RUN.__dict__, "root": fresh_dir(spark, "run"), "search_rounds": 1})
    store = RunStore(spark, config)
    whole = jobs.save_matches

    def broken(*args):
        # the first table of the step is there, the second was being written
        store.spark.range(3).write.parquet(store.candidate_path("ward_matches"))
        raise RuntimeError("lost")

    monkeypatch.setattr(jobs, "save_matches", broken)
    with pytest.raises(RuntimeError):
        jobs.run_actions(spark, config, *folders)
    monkeypatch.setattr(jobs, "save_matches", whole)
    made = []
    monkeypatch.setattr(jobs, "measure_images", lambda *a, **k: made.append("measures"))
    monkeypatch.setattr(jobs, "fit_clusters", lambda *a: made.append("clusters"))
    # the candidates' measures were finished too: nothing is measured again
    monkeypatch.setattr(jobs, "measure_folder", lambda store, *a: store.load(a[-1]))
    jobs.run_actions(spark, config, *folders, resume=True)
    assert made == []
    other = Config(**{**config.__dict__, "root": fresh_dir(spark, "run")})
    monkeypatch.undo()
    jobs.run_actions(spark, other, *folders)
    fresh = RunStore(spark, other)
    for name in ("joined_final_matches", "phash_matches", "ward_matches"):
        assert table(store, store.candidate_path(name), "*") == table(fresh, fresh.candidate_path(name), "*")
    with pytest.raises(ValueError, match="other settings"):
        jobs.run_actions(spark, Config(**{**config.__dict__, "x_down": 17}), *folders, resume=True)
