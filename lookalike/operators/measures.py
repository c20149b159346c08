"""Measurements of selections.

Percentiles, luminosity, hash tokens and principal components work on the
wide row of one selection, whose size the resize step bounds, and need no
shuffle. ``pixel_covariance`` is the same statistic for pixel tables whose
groups have no bound. ``color_centroids`` runs its rounds as expressions over
the arrays of a row, with bounds that spare most distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, mean, positions, quantile_of_sorted, record, total
from ..functions.eigen import ENTRIES, eigen_symmetric3
from ..functions.tokens import (
    LUMINOSITY_WEIGHTS,
    bits_at_mean,
    block_tokens,
    luminosity,
    token_ngrams,
)
from . import KEYS

BANDS = ("r", "g", "b")


def band_percentiles(selections: DataFrame, quantiles, out: str = "histo") -> DataFrame:
    """Percentiles (0..100) of each band, band by band in one array."""
    ranked = F.transform("bands", lambda b: F.array_sort(b))
    per_band = F.transform(
        ranked, lambda s: F.array(*[quantile_of_sorted(s, q / 100) for q in quantiles])
    )
    return selections.withColumn(out, F.flatten(per_band))


def phash_bits(selections: DataFrame, out: str = "bits") -> DataFrame:
    """Bit string of thresholded luminosities, row-major."""
    return selections.withColumn(
        out, bind(F.col("bands"), lambda bands: bits_at_mean(luminosity(bands)))
    )


def phash_tokens(
    selections: DataFrame, block_bits: int, keep_last: bool = True, out: str = "phash"
) -> DataFrame:
    """Hash tokens of consecutive blocks of the bit string."""
    with_bits = phash_bits(selections, "_bits")
    return with_bits.withColumn(out, block_tokens(F.col("_bits"), block_bits, keep_last)).drop("_bits")


def ngram_rows(
    items: DataFrame, tokens: str, length: int, *keys: str, keep_last: bool = True
) -> DataFrame:
    """One row per n-gram of a token array column."""
    return items.select(*keys, F.explode(token_ngrams(F.col(tokens), length, keep_last)).alias("token"))


def word_ngram_rows(
    documents: DataFrame, text: str, length: int, *keys: str, keep_last: bool = True
) -> DataFrame:
    """One row per n-gram of a document's words; whole texts."""
    words = F.filter(F.split(text, WHITESPACE), lambda w: w != "")
    return ngram_rows(
        documents.select(*keys, words.alias("_words")), "_words", length, *keys, keep_last=keep_last
    )


def word_ngram_counts(documents: DataFrame, text: str, length: int, key: str) -> DataFrame:
    """token, n and first_doc, the least key, of every n-gram of words.

    Most n-grams of a task are different, so sums before the shuffle would save
    few rows and spill most of them. Rows are dealt by n-gram first, and summed
    where they arrive; a frequent n-gram is a stream of rows to one counter.
    """
    rows = word_ngram_rows(documents, text, length, key).repartition("token")
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.min(key).alias("first_doc"))


# Fixed value: what separates words.
WHITESPACE = r"[ \t\n\r\f\x0B]+"


def pixel_covariance(pixels: DataFrame, *keys: str, bands=BANDS) -> DataFrame:
    """Sample covariances of three band columns per key, from pixel rows.

    Six aggregates that combine before the shuffle, so one key may hold any
    share of the rows.
    """
    x, y, z = bands
    pairs = {"xx": (x, x), "xy": (x, y), "xz": (x, z), "yy": (y, y), "yz": (y, z), "zz": (z, z)}
    return pixels.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[
            (F.var_samp(a) if a == b else F.covar_samp(a, b)).alias(name)
            for name, (a, b) in pairs.items()
        ],
    )


def band_covariance(selections: DataFrame, out: str = "cov") -> DataFrame:
    """The same six numbers from the wide row, as a struct; no shuffle."""
    upper = [(i, j) for i in range(3) for j in range(i, 3)]

    def centre(band: Column) -> Column:
        pair = record(band=band, average=mean(band))
        return bind(pair, lambda p: F.transform(p["band"], lambda v: v - p["average"]))

    def products(deviations: Column) -> Column:
        n = F.size(F.get(deviations, F.lit(0))) - 1

        def product(i: int, j: int) -> Column:
            a, b = F.get(deviations, F.lit(i)), F.get(deviations, F.lit(j))
            return total(F.zip_with(a, b, lambda u, v: u * v)) / n

        return record(**{name: product(i, j) for name, (i, j) in zip(ENTRIES, upper)})

    return selections.withColumn(out, bind(F.transform("bands", centre), products))


def pca_measures(df: DataFrame, cov: str = "cov") -> DataFrame:
    """Add pca_var (3, descending) and pca_fac (9, one component after another)."""
    return eigen_symmetric3(df, cov, "pca_var", "pca_fac")


def as_covariance(df: DataFrame, out: str = "cov") -> DataFrame:
    """Pack the columns of ``pixel_covariance`` into the struct of ``pca_measures``."""
    return df.withColumn(out, F.struct(*ENTRIES)).drop(*ENTRIES)


def feature_vector(df: DataFrame, cen: str = "cen", histo: str = "histo") -> DataFrame:
    """Centroids followed by percentiles."""
    return df.withColumn("features", F.concat(cen, histo))


def color_centroids(
    selections: DataFrame,
    k: int,
    rounds: int,
    sample: int | None = None,
    seed: int = 0,
    keys: tuple[str, ...] = KEYS,
    out: str = "cen",
) -> DataFrame:
    """Add ``out``: k-means of the pixels inside every selection, 3k numbers,
    darkest centre first.

    Seeds are the first k pixels in hash order; ``sample`` asks for the first
    so many pixels instead of all. A centre without pixels stays where it is.
    The rounds run on the selection's own row, so nothing is shuffled.
    """
    label = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])
    pixels = F.transform(
        positions(F.size(F.get(F.col("bands"), F.lit(0)))),
        lambda i: record(**{c: F.get(F.get(F.col("bands"), F.lit(n)), i).cast("double") for n, c in enumerate(BANDS)}),
    )
    ordered = bind(record(label=label, pixels=pixels), lambda p: _in_hash_order(p, k, sample))
    return selections.withColumn(out, bind(ordered, lambda p: _lloyd(p["pixels"], p["seeds"], rounds)))


def _in_hash_order(given: Column, k: int, sample: int | None) -> Column:
    """The pixels (the first ``sample`` in hash order), and k seeds: the first
    ones, the last of them repeated where there are too few."""
    places = F.sort_array(
        F.transform(
            positions(F.size(given["pixels"])),
            lambda i: record(h=F.md5(F.concat_ws("|", given["label"], i.cast("string"))), i=i),
        )
    )

    def chosen(order: Column) -> Column:
        taken = lambda most: F.transform(F.slice(order, 1, most), lambda o: F.get(given["pixels"], o["i"]))
        seeds = bind(taken(k), lambda s: F.transform(positions(F.lit(k)), lambda i: F.get(s, F.least(i, F.size(s) - 1))))
        return record(pixels=given["pixels"] if sample is None else taken(sample), seeds=seeds)

    return bind(places, chosen)


#: More than any distance between colours.
_FAR = 1e300


def _lloyd(pixels: Column, seeds: Column, rounds: int) -> Column:
    """Centres after ``rounds``, darkest first, as one array.

    Every pixel keeps its centre, at most how far that is, and at least how far
    any other one is. Centres that move shift these bounds; while they do not
    meet, no distance of the pixel is worked out. When no centre moves any
    more, the rounds left change nothing and are passed over.
    """
    start = record(
        centers=seeds,
        near=F.transform(pixels, lambda p: record(i=F.lit(0), most=F.lit(_FAR), least=F.lit(0.0))),
        shifts=F.transform(seeds, lambda c: F.lit(0.0)),
        moved=F.lit(True),
    )

    def turn(state: Column, _) -> Column:
        limits = record(centers=state["centers"], shifts=state["shifts"], reach=F.array_max(state["shifts"]))
        moved = bind(
            limits,
            lambda at: bind(
                F.zip_with(pixels, state["near"], lambda p, n: _nearest(p, n, at)),
                lambda near: _means(pixels, near, state["centers"]),
            ),
        )
        return F.when(state["moved"], moved).otherwise(state)

    last = F.aggregate(positions(F.lit(rounds)), start, turn)["centers"]
    r, g, b = LUMINOSITY_WEIGHTS
    ranked = F.transform(
        last, lambda c: record(light=c["r"] * r + c["g"] * g + c["b"] * b, r=c["r"], g=c["g"], b=c["b"])
    )
    values = F.transform(F.sort_array(ranked), lambda c: F.array(c["r"], c["g"], c["b"]))
    return F.when(F.size(pixels) > 0, F.flatten(values)).otherwise(F.array().cast("array<double>"))


def _square(p: Column, c: Column) -> Column:
    r, g, b = (p[n] - c[n] for n in BANDS)
    return r * r + g * g + b * b


def _nearest(pixel: Column, near: Column, at: Column) -> Column:
    """The pixel's centre and bounds; the first centre wins a tie."""

    def measured(distances: Column) -> Column:
        return bind(
            F.sort_array(distances),
            lambda o: record(
                i=F.array_position(distances, F.get(o, F.lit(0))).cast("int") - 1,
                most=F.sqrt(F.get(o, F.lit(0))),
                least=F.sqrt(F.coalesce(F.get(o, F.lit(1)), F.lit(_FAR))),
            ),
        )

    # the share spared covers the rounding of the bounds
    apart = lambda n: n["most"] < n["least"] * (1 - 1e-9)
    full = bind(F.transform(at["centers"], lambda c: _square(pixel, c)), measured)
    own = F.sqrt(bind(F.get(at["centers"], near["i"]), lambda c: _square(pixel, c)))
    nearer = bind(
        record(i=near["i"], most=own, least=near["least"] - at["reach"]), lambda n: F.when(apart(n), n).otherwise(full)
    )
    loose = record(i=near["i"], most=near["most"] + F.get(at["shifts"], near["i"]), least=near["least"] - at["reach"])
    return bind(loose, lambda n: F.when(apart(n), n).otherwise(nearer))


def _means(pixels: Column, near: Column, centers: Column) -> Column:
    """The state after moving every centre to the mean of its pixels; one
    without pixels stays."""
    # centre and place of every pixel as one number, in order
    codes = F.sort_array(F.transform(near, lambda n, i: F.shiftleft(n["i"].cast("long"), 32) + i))

    def grouped(ordered: Column) -> Column:
        """Per centre that has pixels: its number and where its pixels begin."""
        center = lambda c: F.shiftright(c, 32).cast("int")

        def start(c: Column, i: Column) -> Column:
            new = (i == 0) | (center(c) != center(F.get(ordered, i - 1)))
            return F.when(new, record(i=center(c), at=i))

        starts = F.filter(F.transform(ordered, start), lambda s: s.isNotNull())
        return bind(starts, lambda s: F.transform(s, lambda one, j: mean_of(ordered, s, one, j)))

    def mean_of(ordered: Column, starts: Column, one: Column, j: Column) -> Column:
        end = F.coalesce(F.get(starts, j + 1)["at"], F.size(ordered))
        own = F.transform(
            F.slice(ordered, one["at"] + 1, end - one["at"]),
            lambda c: F.get(pixels, c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")),
        )
        return bind(
            own,
            lambda mine: record(
                i=one["i"], **{c: total(F.transform(mine, lambda p: p[c])) / F.size(mine) for c in BANDS}
            ),
        )

    def placed(found: Column) -> Column:
        def center(old: Column, i: Column) -> Column:
            return bind(
                F.get(F.filter(found, lambda m: m["i"] == i), F.lit(0)),
                lambda m: F.when(m.isNull(), old).otherwise(record(**{c: m[c] for c in BANDS})),
            )

        return F.transform(centers, center)

    def state(new: Column) -> Column:
        shifts = F.zip_with(centers, new, lambda a, c: F.sqrt(_square(a, c)))
        return bind(shifts, lambda s: record(centers=new, near=near, shifts=s, moved=F.array_max(s) > 0))

    return bind(bind(bind(codes, grouped), placed), state)
