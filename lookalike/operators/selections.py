"""Selections of images: whole, patches, quadrants; three bands; resizing.

``sampled_selections`` does all of it on the bytes of decoded files at once.

A selection is one row: image_id, sel_id, is_full, width, height and
``bands``, one array of values per band in row-major order. Every operator
here is narrow: no row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, idiv, positions, record, uniform

def select_full(images: DataFrame) -> DataFrame:
    """The whole image as selection 0."""
    return _cut(images, F.array(_window(0, 0, 0, F.col("height"), F.col("width"))))


def select_patches(
    images: DataFrame,
    max_patches: int = 4,
    fraction: tuple[float, float] = (0.5, 0.5),
    seed: int = 0,
) -> DataFrame:
    """Random windows as selections 1 … max_patches, the same on every run.

    ``fraction`` scales width and height. An image with fewer window places
    than ``max_patches`` gets that many windows.
    """
    return _cut(images, _patches(max_patches, fraction, seed))


def select_quadrants(images: DataFrame) -> DataFrame:
    """The four quarters as selections 1 … 4, row by row.

    The first half of an odd axis is the longer one.
    """
    return _cut(images, _quadrants(0))


def select_all(
    images: DataFrame,
    max_patches: int,
    fraction: tuple[float, float],
    seed: int,
    quadrants: bool = False,
) -> DataFrame:
    """Whole image plus its patches (and quadrants), numbered apart.

    All windows come from one pass, so an image is read and decoded once.
    """
    return _cut(images, _all_windows(max_patches, fraction, seed, quadrants))


def _all_windows(max_patches: int, fraction: tuple[float, float], seed: int, quadrants: bool) -> Column:
    windows = [F.array(_window(0, 0, 0, F.col("height"), F.col("width")))]
    if max_patches > 0:
        windows.append(_patches(max_patches, fraction, seed))
    if quadrants:
        windows.append(_quadrants(max_patches))
    return F.concat(*windows)


def sampled_selections(
    images: DataFrame,
    x_down: int,
    value_range: float,
    max_patches: int,
    fraction: tuple[float, float],
    seed: int,
    quadrants: bool = False,
) -> DataFrame:
    """``select_all``, ``to_rgb`` and ``resize`` in one step, from decoded files
    (``image_load``): the same rows and values.

    Only the bytes that the resized pixels lie between are read. No array is as
    large as the picture, whatever its size, and a row as large as the picture
    exists once and not per selection. Files that were not decoded drop out.
    """

    def sampled(at: Column) -> Column:
        return bind(
            record(rows=_rows(at["_h"], at["_w"], x_down), cols=_cols(at["_h"], at["_w"], x_down)),
            lambda to: record(
                sel_id=at["sel_id"],
                is_full=at["sel_id"] == 0,
                width=to["cols"],
                height=to["rows"],
                bands=bind(
                    record(
                        data=F.col("data"),
                        depth=F.col("n_channels"),
                        ys=F.transform(_taps(at["_h"], to["rows"]), lambda y: line(at, y)),
                        xs=F.transform(_taps(at["_w"], to["cols"]), span),
                    ),
                    lambda im: bind(pixels(im), split),
                ),
            ),
        )

    def line(at: Column, y: Column) -> Column:
        """First bytes of the two rows a resized row lies between."""
        first = lambda row: ((at["_r0"] + row) * F.col("width") + at["_c0"]) * F.col("n_channels") + 1
        return record(lo=first(y["lo"]), hi=first(y["hi"]), t=y["t"])

    def span(x: Column) -> Column:
        """Bytes of two neighbouring pixels up to the second one's colours; at
        the right edge those of one pixel, the other having no weight."""
        depth = F.col("n_channels")
        inside = x["hi"] > x["lo"]
        colours = F.least(depth, F.lit(3))
        return record(
            at=x["lo"] * depth,
            n=F.when(inside, depth + colours).otherwise(colours),
            factor=F.when(inside, F.lit(1)).otherwise(F.pow(F.lit(256), depth)).cast("long"),
            t=x["t"],
        )

    def pixels(im: Column) -> Column:
        """Per resized row and column: the two rows' bytes as two numbers."""

        def number(row: Column, x: Column) -> Column:
            part = F.hex(F.substring(im["data"], row + x["at"], x["n"]))
            return F.conv(part, 16, 10).cast("long") * x["factor"]

        def cell(y: Column, x: Column) -> Column:
            return record(lo=number(y["lo"], x), hi=number(y["hi"], x), y=y["t"], x=x["t"])

        cells = F.flatten(F.transform(im["ys"], lambda y: F.transform(im["xs"], lambda x: cell(y, x))))
        return record(cells=cells, depth=im["depth"])

    def split(both: Column) -> Column:
        # bytes are blue, green, red; a gray value is shared out
        rgb = lambda depth: F.array(*[band(both["cells"], depth, 3, channel) for channel in (2, 1, 0)])
        gray = bind(band(both["cells"], 1, 1, 0), lambda one: F.array(one, one, one))
        return F.when(both["depth"] == 3, rgb(3)).when(both["depth"] == 4, rgb(4)).otherwise(gray)

    def band(cells: Column, depth: int, colours: int, channel: int) -> Column:
        def byte(number: Column, place: int) -> Column:
            raw = F.shiftright(number, 8 * (depth + colours - 1 - place)).bitwiseAND(F.lit(255)).cast("double")
            return raw if colours == 3 else raw / 3

        def value(c: Column) -> Column:
            def across(number: Column) -> Column:
                return byte(number, channel) * (1 - c["x"]) + byte(number, depth + channel) * c["x"]

            return (across(c["lo"]) * (1 - c["y"]) + across(c["hi"]) * c["y"]) / value_range

        return F.transform(cells, value)

    decoded = images.where("height > 0 AND width > 0")
    windows = _all_windows(max_patches, fraction, seed, quadrants)
    return decoded.select("image_id", F.inline(F.transform(windows, sampled)))


def _window(sel_id, r0, c0, h, w) -> Column:
    fields = {"sel_id": sel_id, "_r0": r0, "_c0": c0, "_h": h, "_w": w}
    return record(
        **{n: (v if isinstance(v, Column) else F.lit(v)).cast("int") for n, v in fields.items()}
    )


def _patches(max_patches: int, fraction: tuple[float, float], seed: int) -> Column:
    w = F.greatest(F.lit(1), F.floor(F.col("width") * fraction[0]))
    h = F.greatest(F.lit(1), F.floor(F.col("height") * fraction[1]))
    rows, cols = F.col("height") - h + 1, F.col("width") - w + 1

    def patch(i: Column) -> Column:
        def corner(axis: str, places: Column) -> Column:
            draw = uniform(F.lit(seed), F.col("image_id"), i + 1, F.lit(axis))
            return F.floor(draw * places)

        return _window(i + 1, corner("row", rows), corner("col", cols), h, w)

    return F.transform(positions(F.least(F.lit(max_patches), cols * rows)), patch)


def _quadrants(numbered_after: int) -> Column:
    left, top = F.ceil(F.col("width") / 2), F.ceil(F.col("height") / 2)
    right, low = F.col("width") - left, F.col("height") - top
    quarters = ((0, 0, top, left), (0, left, top, right), (top, 0, low, left), (top, left, low, right))
    parts = F.array(
        *[_window(numbered_after + n, *quarter) for n, quarter in enumerate(quarters, start=1)]
    )
    return F.filter(parts, lambda q: (q["_h"] > 0) & (q["_w"] > 0))


def _cut(images: DataFrame, windows: Column) -> DataFrame:
    """One row per window, with the window's part of every band."""
    framed = images.withColumn("_part", F.explode(windows)).select("*", "_part.*")
    box = record(**{c: F.col(c) for c in ("_r0", "_c0", "_h", "_w", "width", "bands")})

    def cut(at: Column) -> Column:
        def place(i: Column) -> Column:
            return (at["_r0"] + idiv(i, at["_w"])) * at["width"] + at["_c0"] + i % at["_w"]

        spots = F.transform(positions(at["_h"] * at["_w"]), place)
        return bind(
            record(spots=spots, bands=at["bands"]),
            lambda s: F.transform(
                s["bands"], lambda band: F.transform(s["spots"], lambda p: F.get(band, p))
            ),
        )

    is_full = F.col("sel_id") == 0
    framed = framed.withColumn("_bands", F.when(is_full, F.col("bands")).otherwise(bind(box, cut)))
    return framed.select(
        "image_id",
        "sel_id",
        is_full.alias("is_full"),
        F.col("_w").alias("width"),
        F.col("_h").alias("height"),
        F.col("_bands").alias("bands"),
    )


def to_rgb(selections: DataFrame) -> DataFrame:
    """Exactly three bands: alpha is dropped, a gray value is shared out.

    One or two bands give a third of the gray value in each colour.
    """
    gray = F.transform(F.get(F.col("bands"), F.lit(0)), lambda v: v / 3)
    return selections.withColumn(
        "bands",
        F.when(F.size("bands") >= 3, F.slice("bands", 1, 3)).otherwise(F.array(gray, gray, gray)),
    )


#: A picture is resized to at most this many times ``x_down`` squared pixels.
WIDEST = 4


def _rows(height: Column, width: Column, x_down: int) -> Column:
    """Rows after resizing: ``x_down``, less for a picture so wide that its
    area would exceed the bound."""
    wide = F.floor(x_down * F.sqrt(WIDEST * height / width) + 0.5)
    fits = width <= height * WIDEST
    return F.when(fits, F.lit(x_down)).otherwise(F.greatest(F.lit(1), wide.cast("int")))


def _cols(height: Column, width: Column, x_down: int) -> Column:
    """Columns after resizing: as many as keep the shape, 1 at least."""
    wide = F.floor(F.lit(float(WIDEST * x_down * x_down)) / _rows(height, width, x_down))
    keep = F.floor(F.lit(x_down) * width / height + 0.5)
    return F.greatest(F.lit(1), F.when(width <= height * WIDEST, keep).otherwise(wide).cast("int"))


def resize(selections: DataFrame, x_down: int, value_range: float = 1.0) -> DataFrame:
    """Bilinear scaling to ``x_down`` rows and as many columns as keep the shape.

    A picture more than ``WIDEST`` times as wide as high gets fewer rows, so
    that its area is ``WIDEST * x_down ** 2``: no row grows beyond that.
    Values are divided by ``value_range`` (255 brings bytes to 0..1). The
    taps of each axis are worked out once per selection, not once per pixel.
    """
    keep = [c for c in selections.columns if c not in ("width", "height", "bands")]
    size = [f(F.col("height"), F.col("width"), x_down) for f in (_rows, _cols)]
    sized = selections.withColumns({"_h": size[0], "_w": size[1]})
    image = record(
        bands=F.col("bands"),
        width=F.col("width"),
        ys=_taps(F.col("height"), F.col("_h")),
        xs=_taps(F.col("width"), F.col("_w")),
    )

    def scale(im: Column) -> Column:
        def scaled(band: Column) -> Column:
            return _bilinear(lambda row, col: F.get(band, row * im["width"] + col), im["ys"], im["xs"], value_range)

        return F.transform(im["bands"], scaled)

    # two steps: a lambda would take the new width for the old one
    sized = sized.withColumn("_scaled", bind(image, scale))
    return sized.select(
        *keep,
        F.col("_w").alias("width"),
        F.col("_h").alias("height"),
        F.col("_scaled").alias("bands"),
    )


def _bilinear(at, ys: Column, xs: Column, value_range: float) -> Column:
    """Values between four taps each; ``at`` gives the value of a row and column."""

    def row_values(y: Column) -> Column:
        def value(x: Column) -> Column:
            upper = at(y["lo"], x["lo"]) * (1 - x["t"]) + at(y["lo"], x["hi"]) * x["t"]
            lower = at(y["hi"], x["lo"]) * (1 - x["t"]) + at(y["hi"], x["hi"]) * x["t"]
            return (upper * (1 - y["t"]) + lower * y["t"]) / value_range

        return F.transform(xs, value)

    return F.flatten(F.transform(ys, row_values))


def _taps(old: Column, new: Column) -> Column:
    """For every new place: the two old places it lies between, and how far."""
    last = (old - 1).cast("double")

    def tap(i: Column) -> Column:
        place = F.greatest(F.lit(0.0), F.least(last, (i + 0.5) * old / new - 0.5))
        low = F.floor(place).cast("int")
        return record(lo=low, hi=F.least(low + 1, (old - 1).cast("int")), t=place - low)

    return F.transform(positions(new), tap)
