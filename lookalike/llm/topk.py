"""Exact top-k by inner product, as a Voronoi kNN join.

Vectors get one more component so that the largest inner product becomes the
least distance: with M the largest norm, data get sqrt(M^2 - |x|^2) and
queries 0, and |q - x|^2 = |q|^2 + M^2 - 2 q.x.

1. A bounded number of pivots cuts the space into cells. Data and queries go
   to the cell of their nearest pivot.
2. Each cell is summed up: its data's least distances to the pivot, and its
   queries' largest. With the pivots' distances they bound, per cell of
   queries, how far the k-th neighbour of any of them can be.
3. A data row goes to the cells of queries whose bound it may meet by the
   triangle inequality, and to no other.
4. A cell's queries come in blocks and its data in chunks, so that no task
   gathers a whole cell. A task returns its best k per query; the best of
   those are the result. Scores are computed on integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import fresh_dir

PIVOTS = 32
BLOCK_QUERIES = 4_096
CHUNK_ROWS = 50_000
SCALE = 256
EVERY = 50


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of every component; rows whose vector is null
    or holds a null or a non-finite component are left out."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
    )


def _matrix(series, dim: int):
    """Rows of one length; a shorter vector ends in zeros."""
    import numpy as np

    out = np.zeros((len(series), dim), np.int64)
    for row, values in zip(out, series):
        row[: len(values)] = values
    return out


def _augmented(ints, norm2, of_data: bool):
    """``norm2`` is the largest squared norm, at full precision."""
    import numpy as np

    x = ints.astype(np.float64)
    last = np.sqrt(np.maximum(0.0, norm2 - (x * x).sum(1))) if of_data else np.zeros(len(x))
    return np.column_stack([x, last])


def _distances(a, b):
    import numpy as np

    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` for
    each row of ``queries``, both (id, v array<long>).

    A row with the query's own id is no candidate. Ties go to the smaller id.
    Fewer than ``k`` candidates are all returned. Vectors of unequal length
    are compared as if the shorter one ended in zeros. Rows with a null id take no part;
    a repeated id is a candidate once per row, a repeated query asks once,
    with its least vector. A score beyond a long is given as the nearest long. Empty tables give an
    empty one.
    """
    import numpy as np

    spark = vectors.sparkSession
    vectors = vectors.where("id IS NOT NULL")
    queries = queries.where("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    both = vectors.union(queries)
    as_double = F.transform("v", lambda x: x.cast("double"))
    norm = F.aggregate(as_double, F.lit(0.0), lambda acc, x: acc + x * x)
    bounds = both.agg(
        F.max(F.size("v")).alias("dim"),
        F.max(F.array_max(F.transform(as_double, F.abs))).alias("most"),
        F.max(norm).alias("norm2"),
        F.count("*").alias("n"),
    ).first()
    dim, norm2, most = bounds.dim or 0, bounds.norm2 or 0.0, bounds.most or 0.0
    centres = [r.v for r in vectors.orderBy(F.xxhash64("v", "id"), "id").limit(pivots).collect()]
    centres = _augmented(_matrix(centres, dim), norm2, True) if centres else np.zeros((1, dim + 1))
    packed = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64

    def assign(of_data):
        def run(batches):
            import pandas as pd

            for batch in batches:
                ints = _matrix(batch["v"], dim)
                away = _distances(_augmented(ints, norm2, of_data), centres)
                cell = away.argmin(1)
                yield pd.DataFrame(
                    {"id": batch["id"], "cell": cell, "away": away[range(len(cell)), cell], "v": [r.tobytes() for r in ints.astype(packed)]}
                )

        return run

    schema = "id long, cell int, away double, v binary"
    places = []
    for table, of_data in ((vectors, True), (queries, False)):
        place = fresh_dir(spark, "voronoi")
        table.mapInPandas(assign(of_data), schema).write.parquet(place)
        places.append(place)
    data, asked = (spark.read.schema(schema).parquet(p) for p in places)

    # summaries: at most pivots * (k + 1) and pivots rows
    near = Window.partitionBy("cell").orderBy("away")
    nearest = data.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).select("cell", "away").collect()
    reach = {r.cell: (r.far, r.n) for r in asked.groupBy("cell").agg(F.max("away").alias("far"), F.count("*").alias("n")).collect()}
    apart = _distances(centres, centres)
    slack = 1e-6 * (1 + np.sqrt(norm2))
    limit = {}
    for cell, (far, _) in reach.items():
        tops = sorted(far + apart[cell, r.cell] + r.away for r in nearest)
        limit[cell] = far + (tops[k] if len(tops) > k else np.inf) + slack
    cells = sorted(reach)
    blocks = {c: -(-reach[c][1] // BLOCK_QUERIES) for c in cells}
    chunks = max(1, -(-bounds.n // CHUNK_ROWS))

    def replicate(batches):
        """Rows for the blocks of every cell of queries that a row may serve."""
        import pandas as pd

        for batch in batches:
            home, away = batch["cell"].to_numpy(), batch["away"].to_numpy()
            chunk = batch["id"].to_numpy() % chunks
            for cell in cells:
                keep = np.abs(apart[cell, home] - away) <= limit[cell]
                for block in range(blocks[cell]):
                    yield pd.DataFrame(
                        {"cell": cell, "block": block, "chunk": chunk[keep], "id": batch["id"][keep], "v": batch["v"][keep]}
                    )

    def solve(keys, own, rows):
        import pandas as pd

        found = []
        if len(own) and len(rows):
            exact = dim * most * most < 2**53
            kind = np.float64 if exact else np.int64 if dim * most * most < 2**63 else object

            def matrix(frame):
                return np.frombuffer(b"".join(frame["v"]), packed).reshape(len(frame), dim).astype(kind)

            rows = rows.sort_values("id", kind="stable")
            ids, candidates = rows["id"].to_numpy(), matrix(rows)
            for at in range(0, len(own), 64):
                part = own.iloc[at : at + 64]
                scores = matrix(part) @ candidates.T
                if kind is object:
                    scores = np.clip(scores, -(2**63), 2**63 - 1)
                scores = scores.astype(np.int64)
                for query, line in zip(part["id"], scores):
                    line = np.where(ids == query, np.iinfo(np.int64).min, line)
                    if len(line) > k + 1:
                        least = np.partition(line, len(line) - k - 1)[len(line) - k - 1]
                        best = np.flatnonzero(line >= least)
                    else:
                        best = np.arange(len(line))
                    best = best[ids[best] != query]
                    best = best[np.argsort(-line[best].astype(object) if kind is object else -line[best], kind="stable")][:k]
                    found.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "score": line[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    key = ["cell", "block", "chunk"]
    served = data.mapInPandas(replicate, "cell int, block int, chunk long, id long, v binary")
    per_cell = F.element_at(F.create_map(*[F.lit(x) for c in cells for x in (c, blocks[c])]), F.col("cell")) if cells else F.lit(1)
    placed = asked.select(
        "cell",
        F.pmod(F.xxhash64("id"), per_cell).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"),
        "id",
        "v",
    )
    partial = placed.groupBy(*key).cogroup(served.groupBy(*key)).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def report(vectors: DataFrame, every: int = EVERY, k: int = 5) -> DataFrame:
    """Queries are the rows whose id ``every`` divides."""
    rows = integers(vectors)
    return top_k(rows, rows.where(F.col("id") % every == 0), k)


def oracle() -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
