"""Region tokens: merge neighbouring values of a selection into few regions,
then hash the shape of each region.

In one round every region picks its cheapest neighbour, and pairs that picked
each other merge; the cheapest edge of a selection is always such a pair, so
every round makes progress. Merging many pairs per round can give another
partition than one merge at a time would, but always the same one for the same
values.

A selection's lattice is bounded by the resize step and stays on its row. The
rounds are column expressions over arrays: what a loop would look up per
region comes from sorting whole numbers made of a region and a place. Regions
are renumbered after every round, so rounds get shorter as regions get fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, idiv, positions, record

#: Two whole numbers below this make one.
_HALF = 1 << 32


def _pair(first: Column, second: Column) -> Column:
    return F.shiftleft(first.cast("long"), 32) + second


def _first(code: Column) -> Column:
    return F.shiftright(code, 32).cast("int")


def _second(code: Column) -> Column:
    return code.bitwiseAND(F.lit(_HALF - 1)).cast("int")


def flat_values(selections: DataFrame, out: str = "values") -> DataFrame:
    """All values of a selection, pixel by pixel and band by band."""

    def flat(bands: Column) -> Column:
        n = F.size(F.get(bands, F.lit(0))) * 3
        return F.transform(positions(n), lambda i: F.get(F.get(bands, i % 3), idiv(i, 3)))

    return selections.withColumn(out, bind(F.col("bands"), flat))


def _lattice_edges(width: Column, count: Column, adjacency: str) -> Column:
    """Pairs of neighbouring positions.

    ``lattice``: next pixel in flat order, next band of the same pixel.
    ``grid2d``: right and lower pixel of the picture, next band.
    """

    def pair(a: Column, b: Column) -> Column:
        return record(a=a, b=b)

    every = positions(count)
    bands = F.transform(F.filter(every, lambda i: i % 3 < 2), lambda i: pair(i, i + 1))
    if adjacency == "lattice":
        along = F.transform(F.filter(every, lambda i: i + 3 < count), lambda i: pair(i, i + 3))
        return F.concat(bands, along)
    if adjacency == "grid2d":
        right = F.transform(
            F.filter(every, lambda i: (idiv(i, 3) % width) < width - 1), lambda i: pair(i, i + 3)
        )
        below = F.transform(
            F.filter(every, lambda i: i + width * 3 < count), lambda i: pair(i, i + width * 3)
        )
        return F.concat(bands, right, below)
    raise ValueError(f"unknown adjacency {adjacency!r}")


def region_tokens(
    selections: DataFrame,
    regions: int = 5,
    adjacency: str = "lattice",
    out: str = "ward",
) -> DataFrame:
    """Add ``out``: one token per region, in order of first position.

    A token hashes the member positions relative to the first one.
    """
    wide = flat_values(selections, "_values")
    edges = bind(F.col("_values"), lambda v: _lattice_edges(F.col("width"), F.size(v), adjacency))
    start = record(values=F.col("_values"), edges=F.transform(edges, lambda e: _pair(e["a"], e["b"])))
    tokens = bind(start, lambda s: bind(_merged(s["values"], s["edges"], regions), _shapes))
    return wide.withColumn(out, tokens).drop("_values")


def _merged(values: Column, edges: Column, regions: int) -> Column:
    """The region of every position; regions are numbered by first position.

    The state holds, per region, its first position (``name``), size and mean,
    the region of every position, and the edges between regions.
    """
    every = positions(F.size(values))
    start = record(
        label=every,
        name=every,
        size=F.transform(values, lambda v: F.lit(1.0)),
        mean=values,
        edges=edges,
    )

    def turn(state: Column, _) -> Column:
        over = (F.size(state["name"]) <= regions) | (F.size(state["edges"]) == 0)
        return F.when(over, state).otherwise(_round(state, regions))

    # at least one pair merges per round
    return F.aggregate(positions(F.size(values) - regions), start, turn)["label"]


def _round(state: Column, regions: int) -> Column:
    def cost(edge: Column) -> Column:
        a, b = _first(edge), _second(edge)
        ends = record(
            a=a, b=b, sa=F.get(state["size"], a), sb=F.get(state["size"], b),
            gap=F.get(state["mean"], a) - F.get(state["mean"], b),
        )
        return bind(
            ends,
            lambda e: record(
                cost=e["sa"] * e["sb"] / (e["sa"] + e["sb"]) * e["gap"] * e["gap"], tie=F.lit(""), a=e["a"], b=e["b"]
            ),
        )

    def hashed(edge: Column) -> Column:
        names = F.concat_ws("|", F.get(state["name"], edge["a"]), F.get(state["name"], edge["b"]))
        return record(cost=edge["cost"], tie=F.md5(names), a=edge["a"], b=edge["b"])

    def told_apart(priced: Column) -> Column:
        # the hash tells equal costs apart, or a flat image would merge one
        # pair per round; without equal costs it changes nothing
        equal = F.size(F.array_distinct(priced["cost"])) < F.size(priced)
        return F.sort_array(F.when(equal, F.transform(priced, hashed)).otherwise(priced))

    def merge(ranked: Column) -> Column:
        return bind(_mutual(ranked, F.size(state["name"]) - regions), lambda pairs: _renumbered(state, pairs))

    return bind(bind(F.transform(state["edges"], cost), told_apart), merge)


def _mutual(ranked: Column, most: Column) -> Column:
    """The first ``most`` edges that are the cheapest of both their ends."""

    def ends(edge: Column, rank: Column) -> Column:
        return F.array(_pair(edge["a"], rank), _pair(edge["b"], rank))

    def firsts(codes: Column) -> Column:
        new = lambda c, i: (i == 0) | (_first(c) != _first(F.get(codes, i - 1)))
        return F.sort_array(F.transform(F.filter(codes, new), _second))

    def twice(ranks: Column) -> Column:
        return F.filter(ranks, lambda r, i: (i > 0) & (r == F.get(ranks, i - 1)))

    codes = F.sort_array(F.flatten(F.transform(ranked, ends)))
    chosen = F.slice(bind(bind(codes, firsts), twice), F.lit(1), most)
    return F.transform(chosen, lambda r: F.get(ranked, r))


def _renumbered(state: Column, pairs: Column) -> Column:
    """The state after merging ``pairs``, with regions numbered anew."""
    every = positions(F.size(state["name"]))
    # region, then 0 and its partner in a pair or 1 and itself
    itself = F.transform(every, lambda i: _pair(i * 2 + 1, i))
    met = F.flatten(F.transform(pairs, lambda e: F.array(_pair(e["a"] * 2, e["b"]), _pair(e["b"] * 2, e["a"]))))

    def partners(codes: Column) -> Column:
        alone = lambda c, i: (i == 0) | (F.shiftright(c, 33) != F.shiftright(F.get(codes, i - 1), 33))
        return F.transform(F.filter(codes, alone), _second)

    def numbered(partner: Column) -> Column:
        stays = F.filter(every, lambda i: F.get(partner, i) >= i)
        goes = F.filter(every, lambda i: F.get(partner, i) < i)
        codes = F.concat(F.transform(stays, lambda i, n: _pair(i, n)), F.transform(goes, lambda i: _pair(i, F.lit(0))))
        places = F.transform(F.sort_array(codes), _second)
        to = bind(places, lambda new: F.transform(partner, lambda p, i: F.get(new, F.least(p, i))))
        return bind(record(partner=partner, stays=stays, to=to), after)

    def after(new: Column) -> Column:
        size = lambda i: F.get(state["size"], i)
        mean = lambda i: F.get(state["mean"], i)

        def united(i: Column) -> Column:
            return bind(
                record(i=i, p=F.get(new["partner"], i)),
                lambda at: F.when(at["p"] == at["i"], record(s=size(at["i"]), m=mean(at["i"]))).otherwise(
                    record(
                        s=size(at["i"]) + size(at["p"]),
                        m=(size(at["i"]) * mean(at["i"]) + size(at["p"]) * mean(at["p"]))
                        / (size(at["i"]) + size(at["p"])),
                    )
                ),
            )

        def moved(edge: Column) -> Column:
            ends = record(a=F.get(new["to"], _first(edge)), b=F.get(new["to"], _second(edge)))
            return bind(
                ends, lambda e: F.when(e["a"] != e["b"], _pair(F.least(e["a"], e["b"]), F.greatest(e["a"], e["b"])))
            )

        kept = F.filter(F.transform(state["edges"], moved), lambda e: e.isNotNull())
        return bind(
            F.transform(new["stays"], united),
            lambda both: record(
                label=F.transform(state["label"], lambda r: F.get(new["to"], r)),
                name=F.transform(new["stays"], lambda i: F.get(state["name"], i)),
                size=F.transform(both, lambda u: u["s"]),
                mean=F.transform(both, lambda u: u["m"]),
                # two merged regions may touch along several edges
                edges=F.array_distinct(kept),
            ),
        )

    return bind(bind(F.sort_array(F.concat(itself, met)), partners), numbered)


def _shapes(label: Column) -> Column:
    every = positions(F.size(label))

    def token(region: Column) -> Column:
        own = F.filter(every, lambda p: F.get(label, p) == region)
        shape = lambda m: F.transform(m, lambda p: (p - F.get(m, F.lit(0))).cast("string"))
        return F.md5(F.array_join(bind(own, shape), ","))

    return F.transform(positions(F.coalesce(F.array_max(label), F.lit(-1)) + 1), token)
