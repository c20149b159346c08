"""Eigenvalues and eigenvectors of symmetric 3x3 matrices, row by row.

Closed form, as staged column expressions: the eigenvalues by the
trigonometric formula, the vector of the best separated eigenvalue by cross
products, the other two by a rotation inside the plane at right angles to it.
Equal eigenvalues therefore need no special case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# upper triangle of the matrix, row by row
ENTRIES = ("xx", "xy", "xz", "yy", "yz", "zz")


def eigen_symmetric3(df: DataFrame, matrix: str, values: str, vectors: str) -> DataFrame:
    """Add ``values`` (3, descending) and ``vectors`` (9, row-major).

    ``matrix`` is a struct column with the fields of ``ENTRIES``. In every
    vector the component of largest magnitude is positive.
    """
    m = {name: F.col(matrix)[name] for name in ENTRIES}
    keep = df.columns

    df = df.withColumn("_mid", (m["xx"] + m["yy"] + m["zz"]) / 3)
    shift = {n: (m[n] - F.col("_mid") if n in ("xx", "yy", "zz") else m[n]) for n in ENTRIES}
    df = df.withColumn(
        "_p",
        F.sqrt(
            (
                shift["xx"] * shift["xx"]
                + shift["yy"] * shift["yy"]
                + shift["zz"] * shift["zz"]
                + 2 * (m["xy"] * m["xy"] + m["xz"] * m["xz"] + m["yz"] * m["yz"])
            )
            / 6
        ),
    )
    b = {n: shift[n] / F.col("_p") for n in ENTRIES}
    half_det = (
        b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"])
        - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"])
        + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    ) / 2
    df = df.withColumn(
        "_r",
        F.when(F.col("_p") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half_det)))
        .otherwise(F.lit(0.0)),
    )
    df = df.withColumn("_phi", F.acos("_r") / 3)
    df = df.withColumn("_big", F.col("_mid") + 2 * F.col("_p") * F.cos("_phi"))
    df = df.withColumn(
        "_small",
        F.col("_mid") + 2 * F.col("_p") * F.cos(F.col("_phi") + F.lit(2 * math.pi / 3)),
    )
    df = df.withColumn("_mean3", 3 * F.col("_mid") - F.col("_big") - F.col("_small"))

    # the extreme eigenvalue that lies farther from the middle one
    df = df.withColumn("_far", F.when(F.col("_r") >= 0, F.col("_big")).otherwise(F.col("_small")))
    rows = [
        (m["xx"] - F.col("_far"), m["xy"], m["xz"]),
        (m["xy"], m["yy"] - F.col("_far"), m["yz"]),
        (m["xz"], m["yz"], m["zz"] - F.col("_far")),
    ]
    crosses = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        x, y, z = _cross(rows[i], rows[j])
        crosses.append(F.struct((x * x + y * y + z * z).alias("n"), x.alias("x"), y.alias("y"), z.alias("z")))
    df = df.withColumn("_c", F.greatest(*crosses))
    length = F.sqrt(F.col("_c.n"))
    flat = ~(length > 0)
    df = df.withColumn(
        "_w",
        F.struct(
            F.when(flat, F.lit(1.0)).otherwise(F.col("_c.x") / length).alias("x"),
            F.when(flat, F.lit(0.0)).otherwise(F.col("_c.y") / length).alias("y"),
            F.when(flat, F.lit(0.0)).otherwise(F.col("_c.z") / length).alias("z"),
        ),
    )

    # two unit vectors u, v that complete w to a right-angled frame
    w = _fields("_w")
    steep = F.abs(w[0]) > F.abs(w[1])
    side = F.when(steep, F.sqrt(w[0] * w[0] + w[2] * w[2])).otherwise(
        F.sqrt(w[1] * w[1] + w[2] * w[2])
    )
    df = df.withColumn(
        "_u",
        F.struct(
            F.when(steep, -w[2] / side).otherwise(F.lit(0.0)).alias("x"),
            F.when(steep, F.lit(0.0)).otherwise(w[2] / side).alias("y"),
            F.when(steep, w[0] / side).otherwise(-w[1] / side).alias("z"),
        ),
    )
    vx, vy, vz = _cross(w, _fields("_u"))
    df = df.withColumn("_v", F.struct(vx.alias("x"), vy.alias("y"), vz.alias("z")))

    # rotate u, v onto the remaining eigenvectors
    u, v = _fields("_u"), _fields("_v")
    au = _times(m, u)
    av = _times(m, v)
    uu, uv, vv = _dot(u, au), _dot(u, av), _dot(v, av)
    df = df.withColumn("_turn", F.atan2(2 * uv, uu - vv) / 2)
    cos, sin = F.cos("_turn"), F.sin("_turn")
    df = df.withColumn("_hi", F.array(*[cos * a + sin * c for a, c in zip(u, v)]))
    df = df.withColumn("_lo", F.array(*[cos * c - sin * a for a, c in zip(u, v)]))
    df = df.withColumn("_fa", F.array(*_fields("_w")))

    big_first = F.col("_r") >= 0
    ordered = F.when(big_first, F.array("_fa", "_hi", "_lo")).otherwise(
        F.array("_hi", "_lo", "_fa")
    )
    return df.select(
        *keep,
        F.array("_big", "_mean3", "_small").alias(values),
        F.flatten(F.transform(ordered, _positive_peak)).alias(vectors),
    )


def _positive_peak(vector: Column) -> Column:
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    first = F.get(F.filter(vector, lambda x: F.abs(x) == largest), F.lit(0))
    return F.transform(vector, lambda x: F.when(first < 0, -x).otherwise(x))


def _fields(name: str):
    return tuple(F.col(f"{name}.{axis}") for axis in "xyz")


def _cross(a, b):
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _times(m, v):
    return (
        m["xx"] * v[0] + m["xy"] * v[1] + m["xz"] * v[2],
        m["xy"] * v[0] + m["yy"] * v[1] + m["yz"] * v[2],
        m["xz"] * v[0] + m["yz"] * v[1] + m["zz"] * v[2],
    )
