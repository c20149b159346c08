"""Best match by two or three tokens at once.

Where every token is common, an item that reaches a candidate's bound still
shares several of its tokens, and few items share the same two or three. Items
are listed under all pairs and triples of their common tokens, candidates ask
with those of theirs that any winner must hit. As a table grows, bounds rise
with it and more tokens are asked for at once, so what a candidate leads to
hardly grows.

Counts above one are levels: an item with m equal tokens owns levels 0 to
log2(m) of it, and a level is a token of its own here. What a candidate gives
an item is at most the sum over the levels the item owns, and never less than
its votes; the few pairs that are found are scored exactly.

A bag's subsets are bounded by ``COMMON``; longer bags, and candidates that
would lead to more than ``HITS`` rows, are left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bind, positions
from ..sources.store import cut_lineage

#: Tokens of at most so many items are listed one by one.
RARE = 128
#: Levels of a bag, and common ones among them, up to which it takes part.
LEVELS, COMMON = 64, 16
#: Rows that a candidate may lead to here.
HITS = 1000

VOTES = "decimal(38,0)"


def _levels(bags: DataFrame, count: str) -> DataFrame:
    """A row per token and level that a count reaches: 0 to log2(count)."""
    return bags.withColumn("_level", F.explode(positions(F.length(F.bin(F.col(count))))))


def _doubled(level: Column) -> Column:
    """2^level, of any size."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level).cast("decimal(20,0)")


def _arrays(rows: DataFrame, owner: str, *fields: str) -> tuple[DataFrame, DataFrame]:
    """Owners with ``_e``, their levels from rare to common, and the owners
    with too many of them."""
    sizes = rows.groupBy(owner).agg(
        F.count("*").alias("_n"), F.count(F.when(F.col("_df") > RARE, 1)).alias("_common")
    )
    long = cut_lineage(sizes.where((F.col("_n") > LEVELS) | (F.col("_common") > COMMON)).select(owner))
    # at most LEVELS rows per owner
    short = rows.join(long, owner, "left_anti").groupBy(owner).agg(
        F.sort_array(F.collect_list(F.struct("_df", "_id", *fields))).alias("_e")
    )
    return cut_lineage(short), long


def _common(e: str = "_e") -> Column:
    return F.filter(e, lambda x: x["_df"] > RARE)


def _subsets(owners: DataFrame, owner: str) -> DataFrame:
    """owner, _q, _last, _h: pairs and triples of an owner's common levels, by
    size, place of the last one (from 1) and hash."""
    ids = owners.select(owner, F.transform(_common(), lambda x: x["_id"]).alias("_ids"))
    one = ids.select(owner, "_ids", F.posexplode("_ids").alias("_i", "_a"))
    two = one.select(
        owner, "_ids", "_i", "_a", F.posexplode(F.slice("_ids", F.col("_i") + 2, COMMON)).alias("_j", "_b")
    ).withColumn("_j", F.col("_i") + F.col("_j") + 1)
    # without a third: the pair itself
    thirds = F.concat(F.array(F.lit(-1).cast("bigint")), F.slice("_ids", F.col("_j") + 2, COMMON))
    three = two.select(owner, "_j", "_a", "_b", F.posexplode(thirds).alias("_l", "_c"))
    return three.select(
        owner,
        F.when(F.col("_l") == 0, 2).otherwise(3).alias("_q"),
        (F.col("_j") + 1 + F.col("_l")).alias("_last"),
        F.xxhash64("_a", "_b", "_c").alias("_h"),
    )


def _total(values: Column) -> Column:
    zero = F.lit(0).cast(VOTES)
    return F.aggregate(values, zero, lambda acc, x: (acc + x["_v"]).cast(VOTES))


def _places(e: Column, q: int) -> Column:
    """The least number of first levels of ``e`` of which every item that may
    win owns q; null where there is none.

    An item with fewer reaches at most the q - 1 largest of these and all
    behind them. If that equals the bound it owns all behind them, so its key
    is not below the first key of any of these.
    """

    def enough(p: Column) -> Column:
        head, rest = F.slice(e, F.lit(1), p), F.slice(e, p + 1, F.lit(LEVELS))
        largest = F.slice(F.reverse(F.array_sort(F.transform(head, lambda x: F.struct(x["_v"].alias("_v"))))), 1, q - 1)
        reach = _total(rest) if q == 1 else (_total(rest) + _total(largest)).cast(VOTES)
        lowest = F.array_max(F.transform(rest, lambda x: x["_first"]))
        loses = (reach == F.col("_bound")) & F.coalesce(lowest >= F.col("_by"), F.lit(False))
        none = (p == F.size(e)) if q == 1 else F.lit(False)
        return (reach < F.col("_bound")) | loses | none

    return F.array_min(F.filter(F.sequence(F.lit(0), F.size(e)), enough))


def _bound_places(e: Column, q: int) -> Column:
    return bind(e, lambda all_of: _places(all_of, q))


def _scored(pairs: DataFrame, asking: DataFrame, items: DataFrame, cand: str, key: str) -> DataFrame:
    """cand, key, votes of pairs that share a token."""
    bags = [
        df.select(owner, F.transform(F.filter("_e", lambda x: x["_level"] == 0), lambda x: F.struct(x["_id"], x[n].alias(n))).alias(n))
        for df, owner, n in ((asking, cand, "w"), (items, key, "m"))
    ]
    zero = F.lit(0).cast(VOTES)

    def product(a: Column, b: Column) -> Column:
        return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(VOTES)

    def met(x: Column) -> Column:
        same = F.filter("m", lambda y: y["_id"] == x["_id"])
        return F.aggregate(same, zero, lambda acc, y: (acc + product(x["w"], y["m"])).cast(VOTES))

    shared = F.exists("w", lambda x: F.exists("m", lambda y: y["_id"] == x["_id"]))
    votes = F.aggregate("w", zero, lambda acc, x: (acc + met(x)).cast(VOTES))
    return pairs.join(bags[0], cand).join(bags[1], key).where(shared).select(cand, key, votes.alias("votes"))


def best_by_subsets(
    c: DataFrame, k: DataFrame, on: list[str], cand: str, key: str, seeds: int, hits: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cand, key, votes of pairs among which is every candidate's winner among
    the short items; the candidates of whom that is not so; the long items.

    ``c`` (cand, on, w) and ``k`` (key, on, m) are bags of equal tokens.
    """
    owned = _levels(k.select(key, *on, "m"), "m")
    largest = k.groupBy(*on).agg(F.max("m").alias("_most"))
    facts = owned.groupBy(*on, "_level").agg(F.count("*").alias("_df"), F.min(key).alias("_first")).join(largest, on)
    # what the level adds to the counts below it, at most
    below = _doubled(F.col("_level")) - 1
    adds = F.least(below * 2 + 1, F.col("_most").cast("decimal(20,0)")) - below
    facts = cut_lineage(
        facts.select(*on, "_level", "_df", "_first", adds.cast("decimal(19,0)").alias("_adds"), F.monotonically_increasing_id().alias("_id"))
    )
    listed = cut_lineage(owned.join(facts.select(*on, "_level", "_df", "_id"), [*on, "_level"]).select(key, "_id", "_df", "_level", "m"))
    value = (F.col("w").cast("decimal(19,0)") * F.col("_adds")).cast(VOTES)
    asked = c.join(facts, on).select(cand, "_id", "_df", "_level", "_first", "w", value.alias("_v"))
    items, long = _arrays(listed, key, "_level", "m")
    asking, other = _arrays(asked, cand, "_level", "_first", "w", "_v")
    if not long.isEmpty():
        listed = listed.join(long, key, "left_anti")

    index = _subsets(items, key).select("_h", key)
    sizes = index.groupBy("_h").agg(F.count("*").alias("_size"), F.min(key).alias("_first"))
    probes = cut_lineage(_subsets(asking, cand).join(sizes, "_h"))
    seeded, bound = _bound(asking, probes, items, cand, key, seeds)
    # who has only long items first has no bound yet
    plan = asking.join(bound, cand, "left").withColumn("_bound", F.coalesce("_bound", F.lit(0).cast(VOTES)))
    places = [_bound_places(F.col("_e"), 1), _bound_places(_common(), 2), _bound_places(_common(), 3)]
    plan = plan.select(cand, "_bound", "_e", *[p.alias(f"_p{q}") for q, p in enumerate(places, 1)])
    df = lambda e: F.aggregate(e, F.lit(0).cast("bigint"), lambda acc, x: acc + x["_df"])
    rare = F.filter("_e", lambda x: x["_df"] <= RARE)
    plan = cut_lineage(plan.withColumns({"_n1": df(F.slice("_e", F.lit(1), F.col("_p1"))), "_rare": df(rare)}))
    wanted = probes.join(plan.select(cand, "_p2", "_p3"), cand).where(
        F.col("_last") <= F.when(F.col("_q") == 2, F.col("_p2")).otherwise(F.col("_p3"))
    )
    led = wanted.groupBy(cand).agg(
        *[F.sum(F.when(F.col("_q") == q, F.col("_size"))).alias(f"_s{q}") for q in (2, 3)]
    )
    costs = [F.col("_n1"), *[F.when(F.col(f"_p{q}").isNotNull(), F.col("_rare") + F.coalesce(f"_s{q}", F.lit(0))) for q in (2, 3)]]
    least = F.least(*costs)
    how = F.when(least == costs[0], 1).when(least == costs[1], 2).otherwise(3)
    plan = plan.join(led, cand, "left").select(
        cand, "_bound", "_e", "_p1", "_p2", "_p3", least.alias("_cost"), how.alias("_how")
    )
    plan = cut_lineage(plan)
    far = cut_lineage(plan.where(F.col("_cost") > hits).select(cand).unionByName(other))
    plan = plan.where(F.col("_cost") <= hits)

    leading = F.when(F.col("_how") == 1, F.slice("_e", F.lit(1), F.col("_p1"))).otherwise(rare)
    lists = plan.select(cand, "_bound", (_total(F.col("_e")) - _total(leading)).cast(VOTES).alias("_rest"), F.explode(leading).alias("_x"))
    lists = lists.select(cand, "_bound", "_rest", "_x._id", "_x._v").join(listed.select("_id", key), "_id")
    found = lists.groupBy(cand, key).agg(
        F.sum("_v").alias("_met"), F.first("_rest").alias("_rest"), F.first("_bound").alias("_bound")
    )
    found = found.where(F.col("_met") + F.col("_rest") >= F.col("_bound")).select(cand, key)
    until = F.when(F.col("_how") == 2, F.col("_p2")).otherwise(F.col("_p3")).alias("_until")
    chosen = plan.where(F.col("_how") > 1).select(cand, F.col("_how").alias("_q"), until)
    together = probes.join(chosen, [cand, "_q"]).where(F.col("_last") <= F.col("_until")).select(cand, "_h")
    found = found.unionByName(together.join(index, "_h").select(cand, key)).distinct()
    whole = seeded.join(far, cand, "left_anti").unionByName(_scored(found, asking, items, cand, key))
    return whole, far, long


def _bound(asking, probes, items, cand, key, seeds) -> tuple[DataFrame, DataFrame]:
    """cand, key, votes of a few promising items per candidate, and the best of
    them as ``_by`` and ``_bound``: those that come first under most of the
    candidate's levels, pairs and triples."""
    singles = asking.select(cand, F.explode("_e").alias("_x")).select(cand, F.col("_x._first").alias(key), F.lit(1).alias("_q"))
    many = probes.select(cand, F.col("_first").alias(key), "_q")
    weight = singles.unionByName(many).groupBy(cand, key).agg(F.sum("_q").alias("_weight"))
    # at most COMMON choose 3, COMMON choose 2 and LEVELS rows per candidate
    order = Window.partitionBy(cand).orderBy(F.desc("_weight"), key)
    picked = weight.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= seeds).select(cand, key)
    seeded = cut_lineage(_scored(picked, asking, items, cand, key))
    top = F.min(F.struct((-F.col("votes")).alias("v"), F.col(key).alias("k"))).alias("_top")
    bound = seeded.groupBy(cand).agg(top).select(cand, F.col("_top.k").alias("_by"), (-F.col("_top.v")).alias("_bound"))
    return seeded, bound
