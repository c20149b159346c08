"""Embedding whitening by Jacobi-Davidson, without forming the covariance.

Vectors become whole numbers x = floor(scale * c) + offset, stored in blocks in
the shared folder. The covariance V of all of them is only ever applied: one
pass over the blocks gives V times several vectors at once, as the sum of
C'(C w) over the centred rows C. What reaches the driver per pass is as long as
those vectors; sums of many partitions are added up in groups first.

The leading eigenvectors come from a small search space:

* Rayleigh-Ritz: the space's best approximations and their residuals;
* the first of them, once its residual is down to double precision, is locked
  and taken out of everything that follows;
* the next ones ask for corrections: (I - QQ')(V - t)(I - QQ') z = -r, with Q
  the locked vectors and the approximation itself, solved by a few steps of
  MINRES for all of them together, one pass a step. The corrections extend the
  space, which is cut back to its best part when it gets large.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import fresh_dir
from .common import bounded_batches

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Largest residual of a locked vector, as a share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Approximations that are kept beside those asked for.
SPARE = 4
INNER_STEPS = 5
MOST_ROUNDS = 500
#: So many partitions' sums are collected as they are.
FAN = 64
BATCH = 4 << 20
#: Entries from here on have no exact whole number.
EXACT = float(1 << 52)


def leading_eigenvectors(apply: Callable, d: int, wanted: int, tolerance: float = TOLERANCE, inner: int = INNER_STEPS, seed: int = 1):
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a
    symmetric positive operator on d dimensions; ``apply`` takes a matrix of
    columns. Equal eigenvalues get some orthogonal vectors of their space."""
    import numpy as np

    wanted = min(wanted, d)
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((d, 0)), []
    space = np.zeros((d, 0))
    images = np.zeros((d, 0))
    fresh = rng.standard_normal((d, min(d, wanted + SPARE)))
    largest = 0.0
    for _ in range(MOST_ROUNDS):
        fresh = _orthonormal(fresh, np.hstack([locked, space]))
        if fresh.shape[1]:
            space, images = np.hstack([space, fresh]), np.hstack([images, apply(fresh)])
        small = space.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        largest = max([largest, *np.abs(theta[:1]).tolist()])
        rest = images - space * theta
        rest -= locked @ (locked.T @ rest)
        sizes = np.linalg.norm(rest, axis=0)
        whole = locked.shape[1] + space.shape[1] >= d
        done = 0
        while done < len(theta) and (whole or sizes[done] <= tolerance * largest):
            # nothing left above the last one asked for
            if len(values) + done >= wanted and theta[done] <= sorted(values + theta[:done].tolist())[-wanted]:
                break
            done += 1
        locked, values = np.hstack([locked, space[:, :done]]), values + theta[:done].tolist()
        space, images, theta, rest = space[:, done:], images[:, done:], theta[done:], rest[:, done:]
        floor = sorted(values)[-wanted] if len(values) >= wanted else None
        if floor is not None and (not len(theta) or theta[0] <= floor + tolerance * largest):
            order = np.argsort(values)[::-1][:wanted]
            return np.asarray(values)[order], locked[:, order]
        if space.shape[1] > 4 * (wanted + SPARE):
            kept = 2 * (wanted + SPARE)
            space, images = space[:, :kept], images[:, :kept]
        asking = max(1, min(wanted - len(values), len(theta)))
        fresh = (
            _corrections(apply, locked, space[:, :asking], theta[:asking], rest[:, :asking], inner)
            if len(theta)
            else rng.standard_normal((d, 1))
        )
        if not np.isfinite(fresh).all() or not fresh.any():
            fresh = rng.standard_normal((d, asking))
    raise RuntimeError(f"no convergence to {tolerance} in {MOST_ROUNDS} rounds")


def _orthonormal(columns, against):
    """``columns`` made orthonormal, to ``against`` as well; without those that
    hold nothing new."""
    import numpy as np

    out = np.zeros((len(columns), 0))
    room = len(columns) - against.shape[1]
    for column in columns.T:
        if out.shape[1] >= room:
            break
        norm = np.linalg.norm(column)
        if not norm:
            continue
        column = column / norm
        for _ in range(3):
            column = column - against @ (against.T @ column)
            column = column - out @ (out.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            out = np.hstack([out, column[:, None]])
    return out


def _corrections(apply, locked, ritz, theta, residuals, steps: int):
    """``steps`` of MINRES on every correction equation, side by side."""
    import numpy as np

    def project(m):
        m = m - locked @ (locked.T @ m)
        return m - ritz * (ritz * m).sum(axis=0)

    def divided(a, b):
        return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)

    b = project(-residuals)
    eta = np.linalg.norm(b, axis=0)
    start = eta.copy()
    v, v_old, x = divided(b, eta), np.zeros_like(b), np.zeros_like(b)
    w1, w0 = np.zeros_like(b), np.zeros_like(b)
    k = b.shape[1]
    cos1, cos0, sin1, sin0, beta = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k), np.zeros(k)
    for _ in range(steps):
        p = project(apply(project(v)) - v * theta)
        alpha = (v * p).sum(axis=0)
        v_new = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(v_new, axis=0)
        delta = cos1 * alpha - cos0 * sin1 * beta
        rho1 = np.hypot(delta, beta_new)
        rho2, rho3 = sin1 * alpha + cos0 * cos1 * beta, sin0 * beta
        cos0, sin0 = cos1, sin1
        cos1, sin1 = divided(delta, rho1), divided(beta_new, rho1)
        w0, w1 = w1, divided(v - rho3 * w0 - rho2 * w1, rho1)
        x = x + cos1 * eta * w1
        eta = -sin1 * eta
        v_old, v, beta = v, divided(v_new, beta_new), beta_new
        if (np.abs(eta) <= 1e-3 * start).all():
            break
    return x


class Blocks:
    """Whole-number vectors in blocks, and sums over all of them."""

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int):
        import numpy as np

        spark = vectors.sparkSession
        bounded_batches(spark, BATCH)
        v = F.col(vector_col)
        scaled = F.transform(v, lambda c: c.cast("double") * scale)
        whole = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < EXACT))
        rows = vectors.where(v.isNotNull() & whole).select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v"))
        self.id_type = rows.schema["id"].dataType.simpleString()

        def pack(batches):
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch.column(1)
                sizes = np.asarray(lists.value_lengths())
                dim = int(sizes.max())
                x = np.full((len(sizes), dim), offset, np.int64)
                inside = np.arange(dim) < sizes[:, None]
                x[inside] = np.floor(lists.flatten().to_numpy() * scale).astype(np.int64) + offset
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type)), pa.array([dim], pa.int32()), pa.array([x.astype("<i8").tobytes()], pa.binary())],
                    ["ids", "dim", "x"],
                )

        path = fresh_dir(spark, "vectors")
        schema = f"ids array<{self.id_type}>, dim int, x binary"
        rows.mapInArrow(pack, schema).write.option("compression", "zstd").parquet(path)
        self.rows = spark.read.schema(schema).parquet(path)
        found = self.rows.agg(F.max("dim"), F.sum(F.size("ids"))).first()
        self.dim, self.n, self.offset = found[0] or 0, found[1] or 0, offset
        self.parts = self.rows.rdd.getNumPartitions()
        self.sums = np.zeros(self.dim, object)
        if self.n:
            # sums of one block fit a double's 53 bits twice: in two halves
            high, low = self.total(lambda x: np.stack([(x >> 26).sum(axis=0), (x & (2**26 - 1)).sum(axis=0)])).tolist()
            self.sums = np.asarray([int(h) * 2**26 + int(l) for h, l in zip(high, low)], object)

    def total(self, function: Callable):
        """Sum of ``function(x)`` over blocks, x being a matrix with a row per
        vector. Always added in the same order."""
        import numpy as np

        width, missing = self.dim, self.offset

        def partial(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            out = None
            for batch in batches:
                for dim, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    got = function(_matrix(data, dim, width, missing))
                    out = got if out is None else out + got
            if out is not None:
                part = TaskContext.get().partitionId()
                kind = "<i8" if out.dtype.kind == "i" else "<f8"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([str(kind)]), pa.array([list(out.shape)], pa.list_(pa.int32())), pa.array([out.astype(kind).tobytes()], pa.binary())],
                    ["part", "kind", "shape", "sums"],
                )

        def together(table):
            import pyarrow as pa

            table = table.sort_by("part")
            kind = table["kind"][0].as_py()
            out = sum(np.frombuffer(b, kind) for b in table["sums"].to_pylist())
            return pa.table({"part": table["part"][:1], "kind": table["kind"][:1], "shape": table["shape"][:1], "sums": pa.array([out.tobytes()], pa.binary())})

        schema = "part int, kind string, shape array<int>, sums binary"
        rows = self.rows.select("dim", "x").mapInArrow(partial, schema)
        if self.parts > FAN:
            size = int(self.parts**0.5) + 1
            rows = rows.groupBy(F.floor(F.col("part") / size)).applyInArrow(together, schema)
        found = sorted(rows.collect(), key=lambda r: r.part)
        return sum(np.frombuffer(r.sums, r.kind).reshape(r["shape"]) for r in found)

    def centre(self) -> Callable:
        """A function that takes S / n off the rows of a block."""
        n = self.n
        quotient, rest = self.sums // n, self.sums % n
        return lambda x: (x - quotient.astype("int64")) - rest.astype("float64") / n


def _matrix(data: bytes, dim: int, width: int, missing: int):
    """A block as a matrix; a shorter vector ends in zeros before scaling."""
    import numpy as np

    x = np.frombuffer(data, "<i8").reshape(-1, dim) if dim else np.zeros((1, 0), np.int64)
    if dim == width:
        return x
    out = np.full((len(x), width), missing, np.int64)
    out[:, :dim] = x
    return out


def _deviation(x, n: int, sums):
    """Sums over dimensions of (n x - S)^2, exact: int64, or Python's whole
    numbers where these would not fit."""
    import numpy as np

    reach = max([abs(v) for v in sums] + [n * int(abs(x).max())] if x.size else [0])
    if reach < 1 << 61:
        apart = n * x - sums.astype(np.int64)
        if int(abs(apart).max() if apart.size else 0) ** 2 * max(1, x.shape[1]) < 1 << 63:
            return (apart * apart).sum(axis=1)
    apart = n * x.astype(object) - sums
    return (apart * apart).sum(axis=1)


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """A row per vector: its id, ``whitened`` (array, one entry a component by
    falling eigenvalue), ``deviation`` decimal(38,0), and the same in every row
    ``n``, ``explained`` (array) and ``identity_error``.

    Vectors that are null or hold a null or non-finite entry, or one of 2^52
    and more after scaling, take no part. A shorter vector ends in zeros. Ids
    may be null or repeated, equal rows stay apart, other columns are not read.
    Components whose eigenvalue is zero to double precision are left out, so
    fewer dimensions, fewer different vectors or a single one give shorter
    arrays. An empty table gives an empty one. Deviations beyond 38 digits are
    null.
    """
    import numpy as np

    blocks = Blocks(vectors, id_col, vector_col, scale, offset)
    n, sums, width = blocks.n, blocks.sums, blocks.dim
    centre = blocks.centre() if n else None
    values, basis, trace = np.zeros(0), np.zeros((width, 0)), 0.0
    if n and width:

        def apply(columns):
            def one(x):
                c = centre(x)
                return c.T @ (c @ columns)

            return blocks.total(one) / n

        trace = float(blocks.total(lambda x: np.square(centre(x)).sum(axis=0)).sum() / n)
        values, basis = leading_eigenvectors(apply, width, components)
        real = values > width * np.finfo(float).eps * trace
        values, basis = values[real], basis[:, real]
    # one sign for all rows: the largest entry is positive
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])]) if basis.size else np.ones(0)
    turn = basis * signs / np.sqrt(values)
    error = 0.0
    if len(values):

        def square(x):
            z = centre(x) @ turn
            return z.T @ z

        error = float(np.abs(blocks.total(square) / n - np.eye(len(values))).max())
    missing = offset

    def project(batches):
        from decimal import Decimal

        import pyarrow as pa

        for batch in batches:
            for ids, dim, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = _matrix(data, dim, width, missing)[: len(ids)]
                if not dim:
                    x = np.full((len(ids), width), missing, np.int64)
                z = centre(x) @ turn
                apart = _deviation(x, n, sums)
                if apart.dtype == object:
                    exact = pa.array([Decimal(v) if v < 10**38 else None for v in apart.tolist()], pa.decimal128(38, 0))
                else:
                    exact = pa.array(apart).cast(pa.decimal128(38, 0))
                ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [ids.values, exact, pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], [id_col, "deviation", "whitened"]
                )

    schema = f"`{id_col}` {blocks.id_type}, deviation decimal(38,0), whitened array<double>"
    shares = F.array(*[F.lit(float(v / trace)) for v in values]) if len(values) else F.array().cast("array<double>")
    return blocks.rows.mapInArrow(project, schema).select(
        id_col,
        "whitened",
        "deviation",
        F.lit(n).cast("long").alias("n"),
        shares.alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def report(vectors: DataFrame) -> DataFrame:
    """A row per vector and component. A deviation that no long holds is null."""
    rows = whiten(vectors)
    one = rows.select("*", F.posexplode("whitened").alias("place", "entry"))
    return one.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        F.col("deviation").try_cast("long").alias("deviation"),
        F.col("entry").alias("whitened"),
        F.get("explained", F.col("place")).alias("explained"),
        "identity_error",
    )
