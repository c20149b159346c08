"""Altered copies of images, to search for with the answer known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, idiv, positions, quantile_of_sorted, record, uniform


def block_median_fuzz(
    images: DataFrame,
    block: int = 6,
    probability: float = 0.14,
    seed: int = 7,
    whole_numbers: bool = False,
) -> DataFrame:
    """Replace random blocks by their median, band by band.

    Each ``block`` x ``block`` square is replaced with ``probability``, in
    all three colours or none; a fourth band (alpha) stays as it is. The last block of each axis is left alone. A block's
    median is worked out once and only for blocks that are replaced.
    ``whole_numbers`` cuts medians down to integers, as byte images need.
    Narrow: an image never leaves its partition.
    """
    # block b starts at b * block and takes part only if start < size - block
    image = record(
        id=F.col("image_id"),
        bands=F.col("bands"),
        width=F.col("width"),
        across=F.greatest(F.lit(0), F.ceil((F.col("width") - block) / block)).cast("int"),
        down=F.greatest(F.lit(0), F.ceil((F.col("height") - block) / block)).cast("int"),
    )

    def alter(im: Column) -> Column:
        def is_chosen(b: Column) -> Column:
            draw = uniform(F.lit(seed), im["id"], idiv(b, im["across"]), b % im["across"])
            return draw < probability

        chosen = F.transform(positions(im["across"] * im["down"]), is_chosen)
        return bind(
            record(im=im, chosen=chosen),
            lambda s: F.transform(
                s["im"]["bands"], lambda band, i: F.when(i < 3, alter_band(s, band)).otherwise(band)
            ),
        )

    def alter_band(s: Column, band: Column) -> Column:
        im = s["im"]

        def median(hit: Column, b: Column) -> Column:
            row0, col0 = idiv(b, im["across"]) * block, (b % im["across"]) * block
            values = F.array_sort(
                F.transform(
                    positions(F.lit(block * block)),
                    lambda i: F.get(band, (row0 + idiv(i, block)) * im["width"] + col0 + i % block),
                )
            )
            middle = bind(values, lambda v: quantile_of_sorted(v, 0.5))
            return F.when(hit, F.floor(middle).cast("double") if whole_numbers else middle)

        def value(medians: Column, v: Column, i: Column) -> Column:
            row, col = idiv(idiv(i, im["width"]), block), idiv(i % im["width"], block)
            inside = (row < im["down"]) & (col < im["across"])
            replacement = F.get(medians, row * im["across"] + col)
            return F.when(inside, F.coalesce(replacement, v)).otherwise(v)

        return bind(
            F.transform(s["chosen"], median),
            lambda medians: F.transform(band, lambda v, i: value(medians, v, i)),
        )

    return images.withColumn("bands", bind(image, alter))
