"""Best match by blocks: an index of tokens with the largest counts per block.

Where bags consist of common tokens, lists of the items that hold a token lead
everywhere. Here items lie in an order that puts like bags together (by
minimum hashes of their tokens), cut into chunks of neighbours. For every chunk
and token the largest count is known, so a candidate's weights give a bound on
what any item of the chunk can reach, and chunks that cannot beat the best item
known so far are never looked at. Chunks are gathered in larger blocks with
bounds of their own, from the whole table down, so that a block that falls
takes its chunks with it.

A chunk that is left meets blocks of candidates in one task. There the same
happens once more with leaves of a few items each, one candidate after the
other: its leaf with the highest bound is scored first, and of the others only
those that may still win. No pair of a candidate and an item is ever a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut_lineage, spread

#: Rows of an average chunk: items times tokens.
CHUNK_ROWS = 1 << 18
CHUNK_BITS = 14
LEAF = 32
#: A block holds 2^FAN_BITS blocks of the level below; the top has ROOTS at most.
FAN_BITS = 6
ROOTS = 64
CANDIDATES = 1024
HASHES = 9


def signatures(bags: DataFrame, owner: str, on: list[str]) -> DataFrame:
    """owner and minimum hashes ``_h0``, ``_h1``, … of its tokens; bags that
    share most tokens share most of these."""
    return bags.groupBy(owner).agg(*[F.min(F.xxhash64(F.lit(i), *on)).alias(f"_h{i}") for i in range(HASHES)])


def likely(cands: DataFrame, keys: DataFrame, cand: str, key: str) -> DataFrame:
    """cand, key: per three minimum hashes, one item with the candidate's.

    One item stands for each three hashes, so neither side multiplies.
    """
    found = None
    for i in range(0, HASHES, 3):
        same = [f"_h{j}" for j in range(i, i + 3)]
        first = keys.groupBy(*same).agg(F.min(key).alias(key))
        pairs = cands.select(cand, *same).join(first, same).select(cand, key)
        found = pairs if found is None else found.unionByName(pairs)
    return found


def _in_order(k: DataFrame, signed: DataFrame, key: str, bits: int) -> DataFrame:
    """The bags' rows with each item's place ``_at`` in the order of hashes."""
    order = [*(f"_h{i}" for i in range(HASHES)), key]
    placed = signed.repartitionByRange(*order).sortWithinPartitions(*order)
    # partitions begin at multiples of 2^33, so chunks lie within one
    placed = cut_lineage(placed.select(key, F.monotonically_increasing_id().alias("_at")))
    return cut_lineage(k.join(placed, key).withColumn("_block", F.shiftright("_at", bits)))


def _levels(rows: DataFrame, key: str) -> list[tuple[DataFrame, DataFrame]]:
    """From chunks up: (block, token, largest count) and (block, lowest key)."""
    out, source, count, low = [], rows.withColumnRenamed("m", "_top"), "_top", rows.select("_block", key)
    while True:
        top = cut_lineage(source.groupBy("_block", "_id").agg(F.max(count).alias("_top")))
        low = cut_lineage(low.groupBy("_block").agg(F.min(key).alias(key)))
        out.append((top, low))
        if low.count() <= ROOTS:
            return out
        up = F.shiftright("_block", FAN_BITS).alias("_block")
        source, low = top.select(up, "_id", "_top"), low.select(up, key)


def reachable(c: DataFrame, levels, bound: DataFrame, cand: str, key: str) -> DataFrame:
    """cand, _block, _reach, _low: the chunks in which an item may beat the
    candidate's bound, what it may reach there and the chunk's lowest key."""
    frontier = None
    for top, low in reversed(levels):
        if frontier is None:
            met = c.join(top, "_id")
        else:
            inside = top.withColumn("_up", F.shiftright("_block", FAN_BITS))
            met = frontier.select(cand, F.col("_block").alias("_up")).join(c, cand).join(inside, ["_up", "_id"])
        votes = F.sum(F.col("w").cast("decimal(19,0)") * F.col("_top").cast("decimal(19,0)"))
        reach = met.groupBy(cand, "_block").agg(votes.alias("_reach"))
        lowest = low.withColumnRenamed(key, "_low")
        frontier = _hopeful(reach.join(lowest, "_block"), bound, cand)
    return frontier


def _hopeful(reach: DataFrame, bound: DataFrame, cand: str) -> DataFrame:
    """Rows whose ``_reach`` beats the candidate's bound, or equals it with a
    lower key."""
    wins = (F.col("_reach") > F.col("_bound")) | (
        (F.col("_reach") == F.col("_bound")) & (F.col("_low") < F.col("_by"))
    )
    return cut_lineage(reach.join(bound, cand).where(wins).select(cand, "_block", "_reach", "_low"))


def best_by_blocks(
    c: DataFrame,
    k: DataFrame,
    signed: DataFrame,
    bound: DataFrame,
    cand: str,
    key: str,
    chunk_bits: int | None = None,
) -> DataFrame:
    """cand, key, votes of the items that beat their candidate's bound, at
    least the best of them.

    ``c`` (cand, _id, w) and ``k`` (key, _id, m) are bags over numbered tokens,
    ``signed`` the items' ``signatures``, ``bound`` (cand, _bound, _by) a known
    item's votes and key. Equal votes are won by the lower key.
    """
    if chunk_bits is None:
        size = k.count() / max(1, signed.count())
        chunk_bits = max(5, min(CHUNK_BITS, int(CHUNK_ROWS / max(1.0, size)).bit_length() - 1))
    rows = _in_order(k, signed, key, chunk_bits)
    reach = reachable(c, _levels(rows, key), bound, cand, key)
    # the most promising chunk first: what it gives closes most of the others
    home = F.max(F.struct("_reach", (-F.col("_block")).alias("_block"))).alias("_home")
    first = reach.groupBy(cand).agg(home).select(cand, (-F.col("_home._block")).alias("_block"))
    found = cut_lineage(visit(cut_lineage(first), c, rows, bound, cand, key))
    better = found.select(cand, F.col(key).alias("_by2"), F.col("votes").alias("_bound2"))
    raised = bound.join(better, cand, "left").select(
        cand, F.coalesce("_bound2", "_bound").alias("_bound"), F.coalesce("_by2", "_by").alias("_by")
    )
    raised = cut_lineage(raised)
    others = _hopeful(reach.join(first, [cand, "_block"], "left_anti"), raised, cand)
    return found.unionByName(visit(others.select(cand, "_block"), c, rows, raised, cand, key))


def visit(pairs: DataFrame, c: DataFrame, rows: DataFrame, bound: DataFrame, cand: str, key: str) -> DataFrame:
    """cand, key, votes: the best item per candidate and chunk that beats the
    bound. Candidates of a chunk come in blocks, a task for each."""
    parts = pairs.groupBy("_block").agg(F.ceil(F.count("*") / CANDIDATES).alias("_parts"))
    dealt = pairs.join(parts, "_block").select(
        cand, "_block", F.pmod(F.xxhash64(cand), F.col("_parts")).cast("int").alias("_part")
    )
    asking = dealt.join(c, cand).join(bound, cand)
    each = parts.select("_block", F.explode(F.sequence(F.lit(0), (F.col("_parts") - 1).cast("int"))).alias("_part"))
    known = rows.join(each, "_block").select(
        F.col("_block").alias("_chunk"), F.col("_part").alias("_copy"), key, "_at", "_id", "m"
    )
    fields = {f.name: f.dataType.simpleString() for f in (*c.schema, *rows.schema)}
    schema = f"`{cand}` {fields[cand]}, `{key}` {fields[key]}, votes decimal(38,0)"

    def score(asking_rows, known_rows):
        return _scored(asking_rows, known_rows, cand, key)

    asking = asking.select("_block", "_part", cand, "_id", "w", "_bound", "_by")
    return (
        spread(asking, "_block", "_part").groupBy("_block", "_part")
        .cogroup(spread(known, "_chunk", "_copy").groupBy("_chunk", "_copy"))
        .applyInArrow(score, schema)
    )


class _Chunk:
    """The items of a chunk as lists per token, cut at the leaves."""

    def __init__(self, table, key: str):
        import numpy as np

        at, first, place = np.unique(table["_at"].to_numpy(), return_index=True, return_inverse=True)
        keys = table[key].combine_chunks().take(first)
        self.keys = keys.to_pylist()
        self.sorted = sorted(self.keys)
        rank = {name: i for i, name in enumerate(self.sorted)}
        self.rank = np.fromiter((rank[name] for name in self.keys), np.int64, len(at))
        self.leaves = -(-len(at) // LEAF)
        self.lowest = np.minimum.reduceat(self.rank, np.arange(0, len(at), LEAF))
        self.tokens, token = np.unique(table["_id"].to_numpy(), return_inverse=True)
        order = np.lexsort((place, token))
        self.item, self.count, token = place[order], table["m"].to_numpy()[order], token[order]
        leaf = self.item // LEAF
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (leaf[1:] != leaf[:-1])])
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(leaf)))
        self.leaf, self.top = leaf[self.start], np.maximum.reduceat(self.count, self.start)
        self.first = np.searchsorted(token[self.start], np.arange(len(self.tokens) + 1))

    def best(self, ids, weights, bound: int, by):
        """(votes, key) of the item that beats (bound, by) by most, or None."""
        import bisect

        import numpy as np

        spot = np.minimum(np.searchsorted(self.tokens, ids), len(self.tokens) - 1)
        known = self.tokens[spot] == ids
        spot, weights = spot[known], weights[known]
        lists = self.first[spot + 1] - self.first[spot]
        entry, weight = _ragged(self.first[spot], lists), np.repeat(weights, lists)
        leaf = self.leaf[entry]
        # doubles hold these sums exactly below 2^53
        exact = float((weight.astype(float) * self.top[entry]).sum()) < 2.0**52
        reach = _summed(leaf, weight, self.top[entry], self.leaves, exact)
        limit, won = bisect.bisect_left(self.sorted, by), None

        def open_leaves():
            return (reach > bound) | ((reach == bound) & (self.lowest < limit))

        alive = open_leaves()
        if not alive.any():
            return None
        ahead = np.zeros(self.leaves, bool)
        ahead[max(np.flatnonzero(alive), key=lambda i: reach[i])] = True
        done = np.zeros(self.leaves, bool)
        while ahead.any():
            own = ahead[leaf]
            lists = self.size[entry[own]]
            where = _ragged(self.start[entry[own]], lists)
            votes = _summed(self.item[where], np.repeat(weight[own], lists), self.count[where], len(self.rank), exact)
            most = votes.max()
            winner = self.rank[votes == most].min()
            if most > bound or (most == bound and winner < limit):
                bound, limit, won = int(most), winner, self.sorted[winner]
            done |= ahead
            ahead = open_leaves() & ~done
        return None if won is None else (bound, won)


def _ragged(starts, lengths):
    """Places of the elements of many runs, one run after the other."""
    import numpy as np

    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _summed(group, a, b, size: int, exact: bool):
    """Sum of a * b per group; whole numbers of any size where asked for."""
    import numpy as np

    if exact:
        return np.bincount(group, a.astype(float) * b, size)
    out = np.zeros(size, object)
    np.add.at(out, group, a.astype(object) * b.astype(object))
    return out


def _scored(asking, known, cand: str, key: str):
    from decimal import Decimal

    import numpy as np
    import pyarrow as pa

    names, keys, votes = [], [], []
    if asking.num_rows and known.num_rows:
        chunk = _Chunk(known, key)
        who = asking[cand].combine_chunks().dictionary_encode()
        order = np.argsort(who.indices.to_numpy(), kind="stable")
        cuts = np.flatnonzero(np.diff(who.indices.to_numpy()[order])) + 1
        owners = who.dictionary.to_pylist()
        ids, weights = asking["_id"].to_numpy()[order], asking["w"].to_numpy()[order]
        heads = order[np.concatenate([[0], cuts])]
        bounds, by = asking["_bound"].take(heads).to_pylist(), asking["_by"].take(heads).to_pylist()
        for name, i, w, b, k in zip(owners, np.split(ids, cuts), np.split(weights, cuts), bounds, by):
            found = chunk.best(i, w, int(b), k)
            if found:
                names.append(name)
                votes.append(Decimal(found[0]))
                keys.append(found[1])
    return pa.table(
        {
            cand: pa.array(names, asking.schema.field(cand).type),
            key: pa.array(keys, known.schema.field(key).type),
            "votes": pa.array(votes, pa.decimal128(38, 0)),
        }
    )
