"""Bit strings and hash tokens as column expressions.

A selection's luminosities become one bit each (at or above the mean, or
not), blocks of bits become hash tokens, neighbouring tokens become n-grams.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind, mean, positions, record

# Weights of red, green and blue in the luminosity.
LUMINOSITY_WEIGHTS = (0.21, 0.72, 0.07)

TOKEN_SEPARATOR = "-"


def luminosity(bands: Column) -> Column:
    """One luminosity per pixel from an array of three band arrays."""
    r, g, b = LUMINOSITY_WEIGHTS
    red_green = F.zip_with(
        F.get(bands, F.lit(0)), F.get(bands, F.lit(1)), lambda x, y: x * r + y * g
    )
    return F.zip_with(red_green, F.get(bands, F.lit(2)), lambda x, y: x + y * b)


def bits_at_mean(values: Column) -> Column:
    """'1' for every value at or above the mean, else '0', as one string."""

    def flags(both: Column) -> Column:
        bit = lambda v: F.when(v >= both["average"], F.lit("1")).otherwise(F.lit("0"))
        return F.array_join(F.transform(both["values"], bit), "")

    return bind(values, lambda v: bind(record(values=v, average=mean(v)), flags))


def block_tokens(bits: Column, block_bits: int, keep_last: bool = True) -> Column:
    """md5 of consecutive blocks of ``block_bits`` bits.

    The last block may be shorter. Without ``keep_last`` it is left out, so
    that short pictures have no token at all.
    """

    def hashes(text: Column) -> Column:
        blocks = F.ceil(F.length(text) / block_bits)
        count = blocks if keep_last else blocks - 1
        return F.transform(
            positions(count),
            lambda i: F.md5(F.substr(text, i * block_bits + 1, F.lit(block_bits))),
        )

    return bind(bits, hashes)


def token_ngrams(tokens: Column, length: int, keep_last: bool = True) -> Column:
    """Runs of ``length`` neighbouring tokens, each joined to one string.

    N tokens give N - length + 1 runs, one less without ``keep_last``.
    """
    extra = 1 if keep_last else 0

    def runs(all_tokens: Column) -> Column:
        return F.transform(
            positions(F.size(all_tokens) - length + extra),
            lambda i: F.array_join(F.slice(all_tokens, i + 1, length), TOKEN_SEPARATOR),
        )

    return bind(tokens, runs)
