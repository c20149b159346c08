"""Array arithmetic as column expressions, and repeatable random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends only on ``parts`` (integers, strings).

    It comes from a hash, not from a generator with state, so it does not
    change with partitioning, retries or row order.
    """
    text = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(4294967296.0)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once per row.

    A column that a lambda mentions may be inlined by the optimizer and then
    evaluated for every element; a lambda's own argument never is.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def record(**fields: Column) -> Column:
    """A struct whose field names survive inside generators."""
    parts = []
    for name, value in fields.items():
        parts += [F.lit(name), value]
    return F.named_struct(*parts)


def positions(n: Column) -> Column:
    """[0, 1, … n-1], and an empty array for n <= 0."""
    n = n.cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.array().cast("array<int>")
    )


def idiv(a: Column, b) -> Column:
    """Whole-number quotient of two non-negative numbers."""
    return F.floor(a / b).cast("int")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return bind(values, lambda v: total(v) / F.size(v))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def quantile_of_sorted(values: Column, fraction: float) -> Column:
    """Quantile with linear interpolation of an ascending array.

    ``values`` is looked at twice, so pass a plain or bound column.
    """
    place = F.lit(float(fraction)) * (F.size(values) - 1)
    below = F.get(values, F.floor(place).cast("int"))
    above = F.get(values, F.ceil(place).cast("int"))
    return below + (above - below) * (place - F.floor(place))


def _col(part) -> Column:
    return part if isinstance(part, Column) else F.lit(part)
