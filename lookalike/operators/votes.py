"""Votes: which known items share tokens with a candidate, and how many.

A candidate's tokens carry weights, a known item's tokens carry how often
they occur:

    votes(cand, key) = sum over tokens of weight(cand, token) * count(token, key)

Votes are decimal(38,0): a weight and a count fit a bigint, their product may
not. ``vote_counts`` lists every pair, ``votes_of_bags`` only those of
different bags of tokens. ``best_with_total`` needs only the winner and the
sum, and gets both without that list:

* the sum comes from per-token totals, one row per token;
* items with equal bags of tokens (copies) are represented by the one with
  the lowest key, which is also the one that wins among them;
* blocks of candidates meet blocks of items in one task (``vote_grid``) as long
  as the items are few blocks, so that only bags travel;
* of more items, a candidate's tokens are taken from rare to common. The items that hold most
  of its rarest tokens are scored in full, and the best of them is a bound.
  What all tokens from one on can give together is known from each token's
  largest count; once that cannot beat the bound, these tokens lead to no item
  any more and only add to the pairs that the tokens before them found;
* short bags are asked for by two or three tokens at once (``token_subsets``),
  which few items share however common the tokens are;
* of long bags, and for candidates that would lead to many items even so, a
  candidate whose leading tokens are common asks the blocks of ``token_index``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut_lineage, spread
from .token_index import best_by_blocks, likely, signatures
from .token_subsets import HITS, best_by_subsets
from .vote_grid import best_by_grid, votes_by_blocks

#: Rows that a candidate's leading tokens may lead to; it asks the index of
#: blocks beyond. The result is the same either way.
LEADS = 5_000
#: Rarest tokens of a candidate whose strongest item is scored for the bound.
SEEDS = 4


def weigh(tokens: DataFrame, owner: str, on: list[str], weight: str | None = None) -> DataFrame:
    """Equal tokens of one owner as one row with their summed weight ``w``."""
    amount = F.sum(weight) if weight else F.count("*")
    return tokens.groupBy(owner, *on).agg(amount.cast("bigint").alias("w"))


def votes_of_bags(
    cand_tokens: DataFrame,
    key_tokens: DataFrame,
    on: tuple[str, ...] = ("token",),
    cand: str = "cand",
    key: str = "image_id",
    weight: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All votes without repeating them for copies.

    Returns cand, key, votes between representatives, and two tables that
    name every candidate's and every item's representative (``rep``). Items
    with equal bags have equal votes, so the three say everything.
    """
    names = list(on)
    c = cut_lineage(weigh(cand_tokens, cand, names, weight))
    k = cut_lineage(weigh(key_tokens, key, names).withColumnRenamed("w", "m"))
    return _votes_of_weighed(c, k, names, cand, key)


def _votes_of_weighed(c: DataFrame, k: DataFrame, names: list[str], cand: str, key: str):
    c_members, c = represent(c, cand, names, "w")
    k_members, k = represent(k, key, names, "m")
    return _pair_votes(c, k, names, cand, key), c_members, k_members


def vote_counts(
    cand_tokens: DataFrame,
    key_tokens: DataFrame,
    on: tuple[str, ...] = ("token",),
    cand: str = "cand",
    key: str = "image_id",
    weight: str | None = None,
) -> DataFrame:
    """cand, key, votes for every pair that shares a token.

    The result has a row per pair, copies included. ``votes_of_bags`` says
    the same in fewer rows, and ``best_with_total`` needs no pairs. Where many
    pairs share tokens they are summed block by block (``vote_grid``), else by a
    join of the tokens.
    """
    names = list(on)
    c = cut_lineage(weigh(cand_tokens, cand, names, weight))
    k = cut_lineage(weigh(key_tokens, key, names).withColumnRenamed("w", "m"))
    whole = votes_by_blocks(c, k, names, cand, key)
    if whole is not None:
        return whole
    pairs, c_members, k_members = _votes_of_weighed(c, k, names, cand, key)
    return (
        pairs.withColumnsRenamed({cand: "_c", key: "_k"})
        .join(c_members.withColumnRenamed("rep", "_c"), "_c")
        .join(k_members.withColumnRenamed("rep", "_k"), "_k")
        .select(cand, key, "votes")
    )


def _product(weight: str, count: str) -> Column:
    return F.col(weight).cast("decimal(19,0)") * F.col(count).cast("decimal(19,0)")


def _sum_votes() -> Column:
    return F.sum(_product("w", "m")).cast("decimal(38,0)")


def _pair_votes(c: DataFrame, k: DataFrame, on: list[str], cand: str, key: str) -> DataFrame:
    return c.join(k, on).groupBy(cand, key).agg(_sum_votes().alias("votes"))


def represent(bags: DataFrame, owner: str, on: list[str], weight: str) -> tuple[DataFrame, DataFrame]:
    """Owners with equal bags, and the bags of one representative each.

    Returns (owner, rep) and the rows of the representatives. A bag is told by
    its row count and two 64-bit hashes combined over its rows, so no bag is
    ever gathered in one place.
    """
    parts = [F.col(c) for c in (*on, weight)]
    signed = bags.groupBy(owner).agg(
        F.bit_xor(F.xxhash64(*parts)).alias("_h1"),
        F.sum(F.xxhash64(F.lit("second"), *parts).cast("decimal(38,0)")).alias("_h2"),
        F.count("*").alias("_n"),
    )
    same = ["_h1", "_h2", "_n"]
    first = signed.groupBy(*same).agg(F.min(owner).alias("rep"))
    # short rows, read again wherever copies are named
    members = cut_lineage(signed.join(first, same).select(owner, "rep"))
    chosen = members.where(F.col(owner) == F.col("rep")).select(owner)
    return members, bags.join(chosen, owner, "left_semi")


def _best(pairs: DataFrame, cand: str, key: str, votes: str) -> DataFrame:
    """Highest votes per candidate; the lowest key wins a tie."""
    top = F.min(F.struct((-F.col(votes)).alias("v"), F.col(key).alias("k"))).alias("_top")
    return pairs.groupBy(cand).agg(top).select(
        cand, F.col("_top.k").alias(key), (-F.col("_top.v")).alias(votes)
    )


def best_with_total(
    cand_tokens: DataFrame,
    key_tokens: DataFrame,
    on: tuple[str, ...] = ("token",),
    cand: str = "cand",
    key: str = "image_id",
    weight: str | None = None,
    seeds: int = SEEDS,
    leads: int | None = None,
) -> DataFrame:
    """cand, best_match, agree_count, total: the winner without the pair list.

    Blocks of candidates meet blocks of items (``vote_grid``) where the items are
    few blocks. Else, or where ``leads`` is given, the ways are by subsets, leading
    tokens and the index. Exact for any ``seeds`` of 1 or more, which make the
    bound better, and for any ``leads``. Null tokens agree with none.
    """
    names = list(on)
    # both token tables are read several times below; store them once
    k = cut_lineage(weigh(key_tokens, key, names))
    sums = k.groupBy(*names).agg(F.sum("w").alias("m"))
    # from here on a token is a number
    sums = cut_lineage(sums.select(*names, "m", F.monotonically_increasing_id().alias("_token")))
    # tokens that no item has change nothing, and would tell equal bags apart
    c = cut_lineage(weigh(cand_tokens, cand, names, weight).join(sums, names).select(cand, "_token", "w", "m"))
    k = cut_lineage(k.join(sums, names).select(key, "_token", "w"))
    names = ["_token"]
    totals = c.groupBy(cand).agg(_sum_votes().alias("total"))

    cand_reps, c = represent(c.drop("m"), cand, names, "w")
    _, k = represent(k, key, names, "w")
    k = cut_lineage(k.withColumnRenamed("w", "m"))
    winners = _best(_contest(c, k, names, cand, key, seeds, leads), cand, key, "votes")
    return cand_reps.join(winners.withColumnRenamed(cand, "rep"), "rep").join(totals, cand).select(
        cand,
        F.col(key).alias("best_match"),
        F.col("votes").alias("agree_count"),
        "total",
    )


def _contest(c: DataFrame, k: DataFrame, on: list[str], cand: str, key: str, seeds: int, leads: int | None) -> DataFrame:
    """Pairs among which every candidate's winner is, with their full votes."""
    c = cut_lineage(c)
    if leads is None:
        met = best_by_grid(c, k, on[0], cand, key)
        if met is not None:
            return met
        leads = LEADS
    whole, far, long = best_by_subsets(c, k, on, cand, key, seeds, min(leads, HITS))
    short = k
    if not long.isEmpty():
        whole = whole.unionByName(_by_leads(c, k.join(long, key, "left_semi"), on, cand, key, seeds, leads))
        short = k.join(long, key, "left_anti")
    if not far.isEmpty():
        whole = whole.unionByName(_by_leads(c.join(far, cand, "left_semi"), short, on, cand, key, seeds, leads))
    return whole


def _by_leads(c: DataFrame, k: DataFrame, on: list[str], cand: str, key: str, seeds: int, leads: int) -> DataFrame:
    """The same by a candidate's rarest tokens, or by blocks.

    Of two items with equal votes the lower key wins. An item that reaches all
    that a run of tokens can give has every token's largest count, so its key
    is not below the lowest key with that count, of any of these tokens.
    """
    strongest = F.min(F.struct((-F.col("m")).alias("m"), F.col(key).alias("k")))
    facts = k.groupBy(*on).agg(F.count("*").alias("_df"), strongest.alias("_s"))
    facts = cut_lineage(
        facts.select(
            *on, "_df", (-F.col("_s.m")).alias("_top"), F.col("_s.k").alias("_who"),
            F.monotonically_increasing_id().alias("_id"),
        )
    )
    order = Window.partitionBy(cand).orderBy("_df", *on)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    tokens = cut_lineage(
        c.join(facts, on).select(
            cand, *on, "w", "_who", "_df", "_id",
            F.row_number().over(order).alias("_place"),
            F.sum(_product("w", "_top")).over(onward).alias("_left"),
            F.max("_who").over(onward).alias("_lowest"),
        )
    )
    plain = tokens.select(cand, *on, "w")
    signed = cut_lineage(signatures(k, key, on))
    alike = likely(signatures(plain, cand, on), signed, cand, key)
    first = tokens.where(F.col("_place") <= seeds).select(cand, F.col("_who").alias(key)).unionByName(alike).distinct()
    seeded = cut_lineage(
        first.join(plain, cand).join(k, [key, *on]).groupBy(cand, key).agg(_sum_votes().alias("votes"))
    )
    bound = _best(seeded.withColumnRenamed(key, "_by"), cand, "_by", "votes").withColumnRenamed("votes", "_bound")
    bound = cut_lineage(bound)
    more = (F.col("_left") > F.col("_bound")) | (
        (F.col("_left") == F.col("_bound")) & (F.col("_lowest") < F.col("_by"))
    )
    marked = cut_lineage(tokens.join(bound, cand).withColumn("_leads", more))
    far = cut_lineage(
        marked.where("_leads").groupBy(cand).agg(F.sum("_df").alias("_to")).where(F.col("_to") > leads).select(cand)
    )
    near = cut_lineage(marked.join(far, cand, "left_anti"))
    whole = seeded.unionByName(_by_lists(near, k, bound, on, cand, key))
    if far.isEmpty():
        return whole
    numbered = k.join(facts.select(*on, "_id"), on).select(key, "_id", "m")
    asking = marked.join(far, cand, "left_semi").select(cand, "_id", "w")
    return whole.unionByName(best_by_blocks(cut_lineage(asking), cut_lineage(numbered), signed, bound, cand, key))


def _by_lists(marked: DataFrame, k: DataFrame, bound: DataFrame, on: list[str], cand: str, key: str) -> DataFrame:
    """Pairs that the leading tokens of ``marked`` find and that may win."""
    rest = marked.where("NOT _leads")
    # a candidate's few rows lead to thousands
    found = _pair_votes(spread(marked.where("_leads"), cand), k, on, cand, key)
    reach = rest.groupBy(cand).agg(F.max("_left").alias("_rest"))
    hopeful = (
        found.join(bound, cand)
        .join(reach, cand, "left")
        .where(F.col("votes") + F.coalesce("_rest", F.lit(0)) >= F.col("_bound"))
        .select(cand, key, "votes")
    )
    hopeful = cut_lineage(hopeful)
    added = (
        spread(hopeful.select(cand, key), cand)
        .join(rest.select(cand, *on, "w"), cand)
        .join(k, [key, *on])
        .select(cand, key, _product("w", "m").alias("votes"))
    )
    return hopeful.unionByName(added).groupBy(cand, key).agg(F.sum("votes").cast("decimal(38,0)").alias("votes"))


def tagged(kinds: dict[str, DataFrame]) -> DataFrame:
    """Token tables of several kinds as one, with the kind as a column."""
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def best_of_votes(votes: DataFrame, cand: str = "cand", key: str = "image_id") -> DataFrame:
    """cand, best_match, agree_count, total from a stored pair list."""
    top = F.min(F.struct((-F.col("votes")).alias("v"), F.col(key).alias("k"))).alias("_top")
    return votes.groupBy(cand).agg(top, F.sum("votes").cast("decimal(38,0)").alias("total")).select(
        cand, F.col("_top.k").alias("best_match"), (-F.col("_top.v")).alias("agree_count"), "total"
    )


def fused_votes(*votes: DataFrame, cand: str = "cand", key: str = "image_id") -> DataFrame:
    """Pair lists of several kinds added up; a pair may be missing from any."""
    rows = votes[0].select(cand, key, "votes")
    for other in votes[1:]:
        rows = rows.unionByName(other.select(cand, key, "votes"))
    return rows.groupBy(cand, key).agg(F.sum("votes").cast("decimal(38,0)").alias("votes"))


def final_matches(ward_best: DataFrame, phash_best: DataFrame, cand: str = "cand") -> DataFrame:
    """Both kinds' winners per candidate; candidates without either vanish."""

    def named(df: DataFrame, kind: str) -> DataFrame:
        return df.select(
            cand,
            F.col("best_match").alias(f"{kind}_best"),
            F.col("agree_count").alias(f"{kind}_votes"),
            F.col("total").alias(f"{kind}_total"),
        )

    return named(ward_best, "ward").join(named(phash_best, "phash"), cand, "inner")
