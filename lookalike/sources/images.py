"""Image files as DataFrames, and DataFrames as image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import positions

# Leading bytes (hexadecimal) of the image formats.
MAGIC_BYTES = {
    "PNG": "89504E470D0A1A0A",
    "JPEG": "FFD8FF",
    "GIF": "474946",
    "BMP": "424D",
}

#: Tasks of a file scan that one task takes over, and tasks a core gets at least.
SCANS = 16


def image_scan(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files of a folder that match ``glob``: path, length, content.

    The content of a file is read only where a query uses the column.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return _fewer_tasks(files).select(_plain_path(F.col("path")).alias("path"), "length", "content")


def image_load(
    spark: SparkSession, folder: str, glob: str = "*", drop_invalid: bool = False
) -> DataFrame:
    """Decoded images: image_id, width, height, n_channels, data (BGR[A] rows).

    A file that cannot be decoded comes back with height -1 unless dropped.
    """
    files = spark.read.format("image").option("pathGlobFilter", glob).option("dropInvalid", drop_invalid).load(folder)
    return _fewer_tasks(files).select(
        _plain_path(F.col("image.origin")).alias("image_id"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
    )


def _fewer_tasks(files: DataFrame) -> DataFrame:
    """The same rows in a ``SCANS``-th of the scan's tasks, but several for
    every core.

    A scan counts megabytes for the opening of a file, so a task gets but a few
    small pictures and costs more than they do. Files pass one at a time.
    """
    tasks = files.rdd.getNumPartitions()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(1, -(-tasks // SCANS), min(tasks, SCANS * cores)))


def image_format(content: Column) -> Column:
    """Format name from the leading bytes; null for other files."""
    head = F.hex(F.substring(content, 1, 8))
    chain = None
    for name, magic in MAGIC_BYTES.items():
        test = F.startswith(head, F.lit(magic))
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain


def image_meta(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Size, band count and format of every file.

    The pixel bytes are dropped before the two scans meet, so only short rows
    are shuffled.
    """
    files = image_scan(spark, folder, glob).select(
        F.col("path").alias("image_id"), "length", image_format(F.col("content")).alias("format")
    )
    sizes = image_load(spark, folder, glob).drop("data")
    return files.join(sizes, "image_id", "left").withColumn(
        "is_valid", F.coalesce(F.col("height") >= 0, F.lit(False))
    )


def image_bands(images: DataFrame) -> DataFrame:
    """Wide form of decoded images: one array of values per band, row-major.

    Bands come out as red, green, blue (, alpha), or as the single gray band.
    """
    width, channels = F.col("width"), F.col("n_channels")
    count = F.col("height") * width

    def band(offset: int) -> Column:
        # single bytes of a binary column are cut out without copying the rest
        return F.transform(
            positions(count),
            lambda i: F.conv(
                F.hex(F.substring(F.col("data"), i * channels + offset + 1, F.lit(1))), 16, 10
            ).cast("double"),
        )

    bands = (
        F.when(channels == 4, F.array(band(2), band(1), band(0), band(3)))
        .when(channels == 3, F.array(band(2), band(1), band(0)))
        .when(channels == 1, F.array(band(0)))
    )
    return images.where("height > 0").withColumn("bands", bands).drop("data", "n_channels")


def pixel_rows(selections: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per pixel with pos, x, y and the three bands."""
    zipped = F.arrays_zip(
        *[F.get(F.col("bands"), F.lit(i)).alias(name) for i, name in enumerate("rgb")]
    )
    # name the fields by position, whatever arrays_zip called them
    rows = selections.select(*keys, "width", F.posexplode(zipped.cast("array<struct<r:double,g:double,b:double>>")).alias("pos", "p"))
    return rows.select(
        *keys,
        "pos",
        (F.col("pos") % F.col("width")).alias("x"),
        F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"),
        "p.r",
        "p.g",
        "p.b",
    )


def write_png(images: DataFrame, folder: str) -> int:
    """Write one PNG per row (name, width, height, bands) and return how many.

    Tasks write their own rows through the file system the folder's address
    names. A task that runs again writes the same bytes under the same names.
    """
    scheme, _, path = folder.rpartition(":/")
    address = folder if "://" in folder else f"{scheme or 'file'}:///{path.lstrip('/')}"

    def write(batches):
        import struct
        import zlib

        import numpy as np
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(address)
        target.create_dir(base, recursive=True)

        def chunk(kind, body):
            return (
                struct.pack(">I", len(body)) + kind + body
                + struct.pack(">I", zlib.crc32(kind + body))
            )

        for batch in batches:
            for name, width, height, bands in zip(
                batch["name"], batch["width"], batch["height"], batch["bands"]
            ):
                grid = np.stack([np.asarray(b) for b in bands], axis=-1).astype(np.uint8)
                depth = grid.shape[-1]
                lines = grid.reshape(height, width * depth)
                raw = b"".join(b"\0" + line.tobytes() for line in lines)
                color = {1: 0, 2: 4, 3: 2, 4: 6}[depth]
                header = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
                data = (
                    b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header)
                    + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
                )
                with target.open_output_stream(f"{base}/{name}") as out:
                    out.write(data)
            yield batch[["name"]]

    rows = images.select("name", "width", "height", "bands")
    return rows.mapInPandas(write, "name string").count()


def _plain_path(path: Column) -> Column:
    """One spelling for the addresses of both file readers."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")
