"""Mixing sources to target weights by the cube method.

A source is to give ``target`` words, so each of its documents is wanted
``target / size of the source`` times. The whole part is taken outright. The
fraction is an inclusion probability, and the cube method turns all of them
into 0 or 1: three documents at a time are moved along the null space of the
constraints (total of words, number of documents) until one of them is
settled, so both totals stay as they were. A block of documents is one task's
work and leaves few open ones; the left-overs of all blocks form the blocks of
the next round. What a source has left in its last block is landed: the number
of documents is given up as a constraint, then one document is rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut_lineage
from .common import WORD, as_bytes, whole

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK_ROWS = 20_000
LADDER = 8
LEAST_BLOCK = 1_000
#: A table of sources is broadcast up to this many rows, and joined beyond.
BROADCAST_SOURCES = 50_000
SEED = 7


def _small(df: DataFrame) -> DataFrame:
    """``df`` (stored), to be broadcast if its count is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def sizes(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, source, size (words; null text: 0), md5 of the text, and
    ``row``, a number that tells rows apart which are alike in all of these."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(whole(), F.lit(WORD)).cast("long").alias("size"),
        F.unhex(F.md5(as_bytes())).alias("digest"),
        (F.lit(0) if row is None else row).cast("long").alias("row"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, docs, target), a row per source.

    Sources by code point, null last, get ``weights`` in turn and share the
    total size. With a common factor f a source gets f * weight, or ``most``
    times its size if that is less; sources in the order of size / weight stop
    one after the other, so f follows from running sums. The windows run over
    one row per source, not over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    factor = left / open_weight  # if all sources before this one have stopped
    return (
        per.withColumn("factor", factor)
        .withColumn("fits", F.col("factor") * F.col("weight") <= F.col("cap"))
        .withColumn("factor", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "factor"))).over(everything)["factor"])
        .select("source", "source_size", "docs", F.least(F.col("factor") * F.col("weight"), F.col("cap").cast("double")).alias("target"))
    )


def fly(sizes: list[int], chances: list[float], random, land: bool) -> list[float]:
    """Settle ``chances`` to 0 or 1, so that the totals of ``sizes`` and of
    documents stay as they are. ``sizes`` descend.

    Two documents stay open, and a ladder: ``LADDER`` documents of each power
    of two. With ``land`` the open ones are then moved in pairs that keep the
    words alone, from large to small, and the last one goes where the words
    come nearest.
    """
    chances, near, rungs = list(chances), 1e-9, {}

    def settle(moved):
        for i in moved:
            if chances[i] < near or chances[i] > 1 - near:
                chances[i] = float(round(chances[i]))
        return [i for i in moved if 0 < chances[i] < 1]

    def move(active, along):
        ahead, back = (
            min(((1 - chances[i]) if d > 0 else chances[i]) / abs(d) for i, d in zip(active, way) if d)
            for way in (along, [-d for d in along])
        )
        step = ahead if random.random() * (ahead + back) < back else -back
        for i, d in zip(active, along):
            chances[i] = min(1.0, max(0.0, chances[i] + step * d))
        return settle(active)

    for i in reversed(range(len(sizes))):
        if sizes[i]:
            rungs.setdefault(sizes[i].bit_length(), []).append(i)
    held = {i for rung in rungs.values() for i in rung[:LADDER]}
    active = []
    for i in (i for i in range(len(sizes)) if i not in held):
        active = settle([*active, i])
        while len(active) == 3:
            a, b, c = (sizes[i] for i in active)
            active = move(active, (b - c, c - a, a - b) if a != b or b != c else (1, -1, 0))
    if land:
        rest = settle(sorted([*active, *held]))
        for i in (i for i in rest if not sizes[i]):
            chances[i] = float(random.random() < chances[i])
        active = []
        for i in (i for i in rest if sizes[i]):
            active = settle([*active, i])
            while len(active) == 2:
                active = move(active, (sizes[active[1]], -sizes[active[0]]))
        for i in active:
            chances[i] = float(chances[i] >= 0.5)
    return chances


def _round(rows: DataFrame, number: int, block_rows: int) -> DataFrame:
    """One flight in every block of every source."""
    counts = cut_lineage(rows.groupBy("source").agg(F.ceil(F.count("*") / block_rows).alias("blocks")))
    named = counts.withColumnRenamed("source", "of")
    blocked = rows.join(_small(named), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    place = F.pmod(F.xxhash64("doc_id", "digest", F.lit(number)), "blocks")

    def settle(keys, group):
        from random import Random

        group = group.sort_values(["size", "mix", "doc_id", "row"], ascending=[False, True, True, True], kind="stable")
        dice = Random(f"{SEED}|{number}|{keys[0]}|{keys[1]}")
        chances = fly(group["size"].tolist(), group["chance"].tolist(), dice, bool(group["blocks"].iloc[0] == 1))
        return group.assign(chance=chances).drop(columns=["mix", "blocks", "block"])

    return (
        blocked.withColumn("block", place)
        .withColumn("mix", F.xxhash64("digest", "doc_id"))
        .groupBy("source", "block")
        .applyInPandas(settle, rows.schema)
    )


def decide(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    block_rows: int = BLOCK_ROWS,
    row: Column | None = None,
) -> DataFrame:
    """A row per row of ``docs``: doc_id, digest, row, source, size, source_size,
    target, copies (0 to ``most``) and taken = size * copies.

    Null sources are a source of their own, null ids and repeated rows are
    documents like others; texts without words count 0. Equal documents are
    told apart by hashes only, so reruns and other partitionings agree. An
    empty table gives an empty one.
    """
    if block_rows < LEAST_BLOCK:
        raise ValueError(f"block_rows must be {LEAST_BLOCK} or more, so that every round leaves fewer rows")
    sized = cut_lineage(sizes(docs, row))
    goals = cut_lineage(targets(sized, weights, most)).withColumnRenamed("source", "of")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sized.join(_small(goals), F.col("source").eqNullSafe(F.col("of")))
        .drop("of", "docs")
        .withColumn("times", F.floor(wanted + 1e-9))
        .withColumn("chance", F.greatest(F.lit(0.0), wanted - F.col("times")))
        .withColumn("chance", F.when(F.col("chance") < 1e-9, 0.0).otherwise(F.col("chance")))
    )
    settled, number = rows.where("chance = 0"), 0
    rows = rows.where("chance > 0")
    while not rows.isEmpty():
        done = cut_lineage(_round(rows, number, block_rows))
        settled = settled.union(done.where("chance IN (0, 1)"))
        rows, number = done.where("chance > 0 AND chance < 1"), number + 1
    copies = (F.col("times") + F.col("chance")).cast("long")
    return settled.select(
        "doc_id", "digest", "row", "source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, under any column names.

    Decisions are joined by id, source, text digest and a hash of all columns.
    Rows alike in all of them are one row with their number of copies added up,
    so a group of repeated rows, or of null ids over one text, is combined and
    never numbered. Null sources, ids and texts are as in ``decide``; an empty
    table gives an empty one.
    """
    columns = [docs[c] for c in docs.columns]
    # a hash skips nulls, so where they are is hashed as well
    told = F.xxhash64(*columns, *[c.isNull() for c in columns])
    chosen = (
        decide(docs, row=told, **settings)
        .groupBy("doc_id", "digest", "source", "row")
        .agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
        .where("copies > 0")
        .withColumnsRenamed({"doc_id": "of_id", "digest": "of_digest", "source": "of_source", "row": "of_row"})
    )
    keys = ["id", "digest", "origin", "told"]
    rows = docs.select(
        F.struct(*columns).alias("whole"),
        docs["doc_id"].cast("long").alias("id"),
        F.unhex(F.md5(as_bytes())).alias("digest"),
        docs["source"].cast("string").alias("origin"),
        told.alias("told"),
    )
    same = (
        F.col("id").eqNullSafe(F.col("of_id"))
        & F.col("origin").eqNullSafe(F.col("of_source"))
        & (F.col("digest") == F.col("of_digest"))
        & (F.col("told") == F.col("of_row"))
    )
    single = rows.join(chosen.where("rows = 1"), same).select("whole", "copies")
    repeated = rows.join(chosen.where("rows > 1"), same).groupBy(*keys).agg(
        F.first("whole").alias("whole"), F.first("copies").alias("copies")
    )
    taken = single.union(repeated.select("whole", "copies"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return taken.select("whole", each.alias("copy")).select("whole.*")


def report(docs: DataFrame) -> DataFrame:
    return decide(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
