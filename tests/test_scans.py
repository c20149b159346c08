"""Scans of many small files: a task reads many of them, and all are read."""

from lookalike.sources import images


def test_small_files_share_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(images, "SCANS", 4)
    folder = f"file://{tmp_path}/png"
    rows = [(f"{i}.png", 2, 1, [[float(i), 1.0]] * 3) for i in range(40)]
    images.write_png(spark.createDataFrame(rows, "name string, width int, height int, bands array<array<double>>"), folder)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        scan, load = images.image_scan(spark, folder, "*.png"), images.image_load(spark, folder, "*.png")
        for df, column in ((scan, "path"), (load, "image_id")):
            # four tasks a core, not one a file
            assert df.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
            names = sorted(r[0].rsplit("/", 1)[1] for r in df.select(column).collect())
            assert names == sorted(r[0] for r in rows)
        few = images.image_scan(spark, folder, "1.png")
        assert few.rdd.getNumPartitions() == 1 and few.count() == 1
    finally:
        spark.conf.set(key, before)
    assert images.image_scan(spark, folder, "*.jpg").count() == 0
