import struct
import zlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lookalike.config import Config
from lookalike.sources.images import (
    image_bands,
    image_format,
    image_load,
    image_meta,
    image_scan,
    pixel_rows,
    write_png,
)
from lookalike.sources.store import RunStore, asset_key, fresh_dir, shared_dir


def png(width, height, kind, pixels):
    depth = {0: 1, 2: 3, 6: 4}[kind]
    lines = [pixels[r * width * depth : (r + 1) * width * depth] for r in range(height)]
    raw = b"".join(b"\0" + bytes(line) for line in lines)

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("imgs")
    (base / "rgb0.png").write_bytes(png(4, 3, 2, list(range(36))))
    (base / "rgba0.png").write_bytes(png(4, 3, 6, [200 + i % 4 for i in range(48)]))
    (base / "gray0.png").write_bytes(png(4, 3, 0, list(range(100, 112))))
    (base / "bad0.png").write_bytes(b"no picture")
    (base / "other1.png").write_bytes(png(1, 1, 0, [5]))
    return str(base)


def test_scan_and_metadata(spark, folder):
    files = image_scan(spark, folder, "*0.png")
    assert files.count() == 4
    meta = {r.image_id.split("/")[-1]: r for r in image_meta(spark, folder, "*0.png").collect()}
    assert meta["rgb0.png"].format == "PNG" and meta["bad0.png"].format is None
    assert [meta[f"{n}0.png"].n_channels for n in ("rgb", "rgba", "gray")] == [3, 4, 1]
    assert meta["rgb0.png"].is_valid and not meta["bad0.png"].is_valid


def test_decoded_bands(spark, folder):
    images = image_bands(image_load(spark, folder, "*0.png"))
    got = {r.image_id.split("/")[-1]: r for r in images.collect()}
    assert set(got) == {"rgb0.png", "rgba0.png", "gray0.png"}
    rgb = got["rgb0.png"]
    assert (rgb.width, rgb.height) == (4, 3)
    assert rgb.bands == [[float(i + b) for i in range(0, 36, 3)] for b in range(3)]
    assert got["gray0.png"].bands == [[float(v) for v in range(100, 112)]]
    assert [b[0] for b in got["rgba0.png"].bands[:3]] == [200, 201, 202]


def test_written_images_come_back(spark):
    rows = [("a.png", 2, 2, [[1.0, 2.0, 3.0, 255.0], [0.0] * 4, [9.0] * 4])]
    target = fresh_dir(spark, "png")
    df = spark.createDataFrame(rows, "name string, width int, height int, bands array<array<double>>")
    assert write_png(df, target) == 1
    images = image_bands(image_load(spark, target, "*.png"))
    assert images.first().bands == rows[0][3]
    pixels = pixel_rows(images, "image_id").orderBy("pos").collect()
    assert [(p.x, p.y, p.r) for p in pixels] == [(0, 0, 1), (1, 0, 2), (0, 1, 3), (1, 1, 255)]


def test_formats(spark):
    heads = {"JPEG": "FFD8FFE0", "GIF": "47494638", "BMP": "424D0000", None: "00010203"}
    for name, head in heads.items():
        assert spark.range(1).select(image_format(F.unhex(F.lit(head)))).first()[0] == name


def test_tables_are_written_once(spark):
    store = RunStore(spark, Config(root=fresh_dir(spark, "run")))
    table = store.save(spark.range(3), store.cluster_path("key_to_cluster"))
    assert table.count() == 3
    assert store.candidate_path("x").endswith("/t4/candidates/c4/x")
    with pytest.raises(AnalysisException):
        store.save(spark.range(1), store.cluster_path("key_to_cluster"))


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark).startswith(f"file:{named}/")
    assert shared_dir(spark) == shared_dir(spark)


def test_asset_key(spark):
    df = spark.createDataFrame([("./faces/._x/a.1.jpg",), ("/b.jpg",), (".c",)], "p string")
    assert [r[0] for r in df.select(asset_key(F.col("p"))).collect()] == ["facesxa.1.jpg", "b.jpg", "c"]
