"""Votes by a grid: blocks of candidates meet blocks of items.

A join on tokens has a row per pair and shared token, and all of them travel
once more to be summed per pair. Here every block of candidates meets every
block of items in one task, with all tokens of both: a pair's sum is whole where
it is found, and only the bags travel, a row each, as often as the other side has
blocks. A block of items is bounded by owners and by rows and lies in memory as
lists per token; candidates pass by as a stream, a few at a time, so their blocks
have no bound and what a task returns is never in memory at once. There are as
many blocks of candidates as keep all cores busy, not more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..sources.store import cut_lineage
from .token_index import _ragged

#: Owners and rows of an average block of items.
OWNERS, ROWS = 1 << 16, 1 << 20
#: Tasks per core, and candidates that make a task worth while.
TASKS, WORTH = 3, 1 << 10
#: Tokens of a bag that travel as one row; longer bags take several.
PIECE = 256
#: Pairs and products that are in memory at once.
CELLS, AT_ONCE = 1 << 20, 1 << 21
#: Sums below this are exact as doubles.
EXACT = 1 << 52
#: Blocks of items up to which every candidate may meet all of them for its best.
MEETINGS = 32


def votes_by_blocks(c: DataFrame, k: DataFrame, on: list[str], cand: str, key: str) -> DataFrame | None:
    """cand, key, votes of every pair that shares a token, from stored bags
    (cand, on, w) and (key, on, m).

    None where a join is better or needed: where few pairs share tokens, for a
    bag that is no small part of a block, for weights that are null or not
    positive or whose sums a double does not hold, and for owners without name.
    """
    shared = c.groupBy(*on).agg(F.count("*").alias("_c")).join(k.groupBy(*on).agg(F.count("*").alias("_k")), on)
    tokens = cut_lineage(shared.select(*on, "_c", "_k", F.monotonically_increasing_id().alias("_id")))
    products = tokens.agg(F.sum(F.col("_c").cast("decimal(38,0)") * F.col("_k"))).first()[0]
    if products is None:
        return None
    asking = cut_lineage(c.join(tokens, on).select(cand, "_id", F.col("w").alias("n")))
    known = cut_lineage(k.join(tokens, on).select(key, "_id", F.col("m").alias("n")))
    grid = _grid(asking, known, cand, key)
    if grid is None or products <= grid["travel"]:
        return None
    return _meet(asking, known, cand, key, grid, _All)


def best_by_grid(c: DataFrame, k: DataFrame, on: str, cand: str, key: str) -> DataFrame | None:
    """cand, key, votes of the best item per candidate and block of items, from
    stored bags (cand, on, w) and (key, on, m) over numbered tokens.

    None where the items are more than ``MEETINGS`` blocks or the bags are none
    that a grid holds.
    """
    asking = c.select(cand, F.col(on).alias("_id"), F.col("w").alias("n"))
    known = k.select(key, F.col(on).alias("_id"), F.col("m").alias("n"))
    grid = _grid(asking, known, cand, key)
    if grid is None or grid["items"] > MEETINGS:
        return None
    return _meet(asking, known, cand, key, grid, _Best)


def _grid(asking: DataFrame, known: DataFrame, cand: str, key: str) -> dict[str, int] | None:
    """Blocks of candidates and items, rows per bag, and rows that travel."""
    if any(isinstance(df.schema[owner].dataType, (ArrayType, MapType, StructType)) for df, owner in ((asking, cand), (known, key))):
        return None
    mine, theirs = _facts(asking, cand), _facts(known, key)
    if not (mine["fit"] and theirs["fit"]) or mine["most"] * theirs["top"] >= EXACT:
        return None
    cores = asking.sparkSession.sparkContext.defaultParallelism
    items = max(-(-theirs["owners"] // OWNERS), -(-theirs["size"] // ROWS))
    cands = max(1, min(-(-TASKS * cores // items), -(-mine["owners"] // min(WORTH, OWNERS))))
    return {
        "cands": cands, "items": items, "pieces": -(-max(mine["longest"], theirs["longest"]) // PIECE),
        "travel": mine["size"] * items + theirs["size"] * cands,
    }


def _facts(bags: DataFrame, owner: str):
    """Size, owners, the largest count and sum of a bag, and whether all of it
    can go by blocks."""
    each = bags.groupBy(owner).agg(
        F.count("*").alias("size"), F.count("n").alias("counted"), F.max("n").alias("top"), F.min("n").alias("low"),
        F.sum(F.col("n").cast("decimal(38,0)")).alias("most"),
    )
    plain = F.col(owner).isNotNull() & (F.col("counted") == F.col("size")) & (F.col("low") > 0) & (F.col("size") * 8 <= ROWS)
    return each.agg(
        F.sum("size").alias("size"), F.count("*").alias("owners"), F.max("top").alias("top"), F.max("most").alias("most"),
        F.max("size").alias("longest"), F.min(F.coalesce(plain, F.lit(False))).alias("fit"),
    ).first()


def _meet(asking: DataFrame, known: DataFrame, cand: str, key: str, grid: dict[str, int], work) -> DataFrame:
    """What ``work`` finds where a block of candidates meets a block of items."""
    fields = {f.name: f.dataType.simpleString() for f in (*asking.schema, *known.schema)}
    schema = f"`{cand}` {fields[cand]}, `{key}` {fields[key]}, votes decimal(38,0)"

    def bags(rows: DataFrame, owner: str) -> DataFrame:
        piece = F.pmod(F.xxhash64("_id"), F.lit(grid["pieces"])).alias("_piece")
        # at most PIECE tokens or so
        return rows.groupBy(owner, piece).agg(F.collect_list(F.struct("_id", "n")).alias("_bag"))

    def block(owner: str, n: int):
        return F.pmod(F.xxhash64(owner), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    bag = [F.col("_bag._id").alias("_ids"), F.col("_bag.n").alias("_ns")]
    left = bags(asking, cand).select(cand, *bag, block(cand, grid["cands"]).alias("_a"), every(grid["items"]).alias("_b"))
    right = bags(known, key).select(key, *bag, every(grid["cands"]).alias("_a"), block(key, grid["items"]).alias("_b"))
    at = (F.col("_a") * grid["items"] + F.col("_b")).alias("_at")
    rows = right.select(at, F.lit(None).cast(fields[cand]).alias("_cand"), F.col(key).alias("_key"), "_ids", "_ns").unionByName(
        left.select(at, F.col(cand).alias("_cand"), F.lit(None).cast(fields[key]).alias("_key"), "_ids", "_ns")
    )
    met = rows.repartitionById(grid["cands"] * grid["items"], "_at").sortWithinPartitions("_at", F.asc_nulls_first("_cand"))
    return met.mapInArrow(lambda batches: _passed(batches, cand, key, work), schema)


def _passed(batches, cand: str, key: str, work):
    """Blocks one after the other: first the items, then the candidates, whose
    bags may be cut at the end of a batch."""
    import numpy as np
    import pyarrow as pa

    at, items, met, held = None, [], None, []

    def ask(rows, whole: bool):
        """Score all candidates of ``rows`` but the last, unless it is ``whole``."""
        nonlocal held, met
        if not rows or at is None:
            held = []
            return
        table = pa.concat_tables(rows).combine_chunks()
        who = table["_cand"].combine_chunks().dictionary_encode().indices.to_numpy()
        end = len(who) if whole else int(np.flatnonzero(who != who[-1])[-1]) + 1 if (who != who[-1]).any() else 0
        held = [table.slice(end)] if end < len(who) else []
        if not end or not items:
            return
        if met is None:
            met = work(_flat(pa.concat_tables(items), "_key", key), key)
        for found in met.ask(_flat(table.slice(0, end), "_cand", cand), cand):
            yield from found.to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        block, is_item = table["_at"].to_numpy(), table["_key"].is_valid().to_numpy()
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(is_item.astype(int)) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(block)]):
            if a == b:
                continue
            if block[a] != at:
                yield from ask(held, True)
                at, items, met, held = block[a], [], None, []
            part = table.slice(a, b - a)
            if is_item[a]:
                items.append(part)
            else:
                yield from ask([*held, part], False)
    yield from ask(held, True)


def _flat(table, owner: str, name: str):
    """A row per token of the bags: name, _id, n."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table = table.combine_chunks()
    lists = table["_ids"].combine_chunks()
    places = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    return pa.table(
        {name: table[owner].combine_chunks().take(pa.array(places)), "_id": lists.flatten(), "n": table["_ns"].combine_chunks().flatten()}
    )


class _All:
    """Every pair of a block of items with the candidates that pass."""

    def __init__(self, known, key: str):
        self.lists, self.key = _lists(known, key), key

    def ask(self, asking, cand: str):
        import numpy as np

        who = asking[cand].combine_chunks().dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(who)) + 1)][:: max(1, CELLS // len(self.lists[0]))]
        for a, b in zip(cuts, [*cuts[1:], len(who)]):
            yield _summed(asking.slice(a, b - a), self.lists, cand, self.key)


class _Best:
    """The best item of a block for every candidate that passes.

    Tokens are taken from rare to common and give their votes to the items that
    own them, until one of these has more than all tokens left could give. Of the
    others only items that may still reach it are looked up in the lists left.
    Equal votes are won by the lower key.
    """

    def __init__(self, known, key: str):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        whom = known[key].combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(whom.dictionary)
        self.keys = whom.dictionary.take(order)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        item, ids = rank[whom.indices.to_numpy()], known["_id"].to_numpy()
        order = np.lexsort((item, ids))
        self.item, self.count = item[order], known["n"].to_numpy()[order].astype(float)
        self.tokens, first = np.unique(ids[order], return_index=True)
        self.first = np.append(first, len(order))
        self.top = np.maximum.reduceat(self.count, first)
        self.votes = np.zeros(len(self.keys))
        self.key, self.type = key, pa.decimal128(38, 0)

    def ask(self, asking, cand: str):
        import numpy as np
        import pyarrow as pa

        who = asking[cand].combine_chunks().dictionary_encode()
        ids, weight = asking["_id"].to_numpy(), asking["n"].to_numpy().astype(float)
        spot = np.minimum(np.searchsorted(self.tokens, ids), len(self.tokens) - 1)
        owner, known = who.indices.to_numpy(), self.tokens[spot] == ids
        owner, spot, weight = owner[known], spot[known], weight[known]
        if not len(owner):
            return
        long = self.first[spot + 1] - self.first[spot]
        order = np.lexsort((spot, long, owner))
        owner, spot, weight = owner[order], spot[order], weight[order]
        cuts = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner))
        # what the tokens from each one on can give at most
        reach = np.append(np.cumsum((weight * self.top[spot])[::-1])[::-1], 0)
        left = (reach[:-1] - np.repeat(reach[cuts[1:]], np.diff(cuts))).tolist()
        starts, ends, weight = self.first[spot].tolist(), self.first[spot + 1].tolist(), weight.tolist()
        found = [self._best(starts[a:b], ends[a:b], weight[a:b], left[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        most, winner = zip(*found)
        yield pa.table(
            {
                cand: who.dictionary.take(pa.array(owner[cuts[:-1]])),
                self.key: self.keys.take(pa.array(winner)),
                "votes": pa.array([int(v) for v in most], pa.int64()).cast(self.type),
            }
        )

    def _best(self, starts, ends, weights, left):
        import numpy as np

        votes, most, lists, rest = self.votes, 0.0, [], 0.0
        for j, (a, b, w) in enumerate(zip(starts, ends, weights)):
            rest = left[j]
            if most > rest:
                break
            item = self.item[a:b]
            got = votes[item] + w * self.count[a:b]
            votes[item] = got
            lists.append(item)
            most, rest = max(most, got.max()), 0.0
        done = len(lists)
        found = np.concatenate(lists)
        got = votes[found]
        votes[found] = 0.0
        near = got >= most - rest
        found, place = np.unique(found[near], return_index=True)
        got = got[near][place]
        for a, b, w in zip(starts[done:], ends[done:], weights[done:]):
            spot = np.minimum(np.searchsorted(self.item[a:b], found), b - a - 1)
            got += np.where(self.item[a:b][spot] == found, w * self.count[a:b][spot], 0.0)
        best = got.max()
        return best, found[np.argmax(got == best)]


def _scored(asking, known, cand: str, key: str):
    """All pairs of two tables of bags with a row per token."""
    return _summed(asking, _lists(known, key), cand, key)


def _lists(known, key: str):
    """The owners, and owner and count per token in the order of the tokens."""
    import numpy as np

    whom, ids = known[key].combine_chunks().dictionary_encode(), known["_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    return whom.dictionary, ids[order], whom.indices.to_numpy()[order], known["n"].to_numpy()[order].astype(float)


def _summed(asking, lists, cand: str, key: str):
    import numpy as np
    import pyarrow as pa

    keys, ids, item, count = lists
    who = asking[cand].combine_chunks().dictionary_encode()
    votes = np.zeros((len(who.dictionary), len(keys)))
    if asking.num_rows and len(ids):
        order = np.argsort(who.indices.to_numpy(), kind="stable")
        row, weight, token = who.indices.to_numpy()[order], asking["n"].to_numpy()[order], asking["_id"].to_numpy()[order]
        first = np.searchsorted(ids, token, "left")
        lists = np.searchsorted(ids, token, "right") - first
        ends = np.cumsum(lists)
        cuts = np.searchsorted(ends, np.arange(AT_ONCE, int(ends[-1]) + AT_ONCE, AT_ONCE), "left") + 1
        for a, b in zip([0, *cuts[:-1]], cuts):
            part = slice(a, min(b, len(row)))
            if not lists[part].sum():
                continue
            low, high = row[part][0], row[part][-1] + 1
            entry = _ragged(first[part], lists[part])
            place = np.repeat((row[part] - low).astype(np.int64) * votes.shape[1], lists[part]) + item[entry]
            amount = np.repeat(weight[part].astype(float), lists[part]) * count[entry]
            votes[low:high] += np.bincount(place, amount, (high - low) * votes.shape[1]).reshape(high - low, -1)
    # weights and counts are positive: a pair without votes shares no token
    mine, theirs = np.divmod(np.flatnonzero(votes), max(1, len(keys)))
    return pa.table(
        {
            cand: who.dictionary.take(pa.array(mine)),
            key: keys.take(pa.array(theirs)),
            "votes": pa.array(votes[mine, theirs].astype(np.int64)).cast(pa.decimal128(38, 0)),
        }
    )
