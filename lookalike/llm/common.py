"""What several operators share: words, texts as bytes, bounded batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = rb"[\x20\x09-\x0D]"
_SPACE = re.compile(SPACE)
BATCH_BYTES = 16 << 20
PIECE = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str = "text") -> Column:
    """The text, and an empty one for null."""
    return F.coalesce(F.col(text), F.lit(""))


def as_bytes(text: str = "text") -> Column:
    return whole(text).cast("binary")


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Arrow batches end at ``size`` bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def word_lists(data: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, as lists of bounded size.

    ``bytes.split()`` knows exactly the white space of ``WORD``. A piece ends
    before white space, so no word is cut.
    """
    start = 0
    while start < len(data):
        end = min(len(data), start + piece)
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[start:end].split()
        start = end


def held_out_rows(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))
