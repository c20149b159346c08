"""Best match by several tokens at once against plain counting."""

import random

import pytest

from brute import best_of, literal_votes
from lookalike.operators import token_subsets, votes
from lookalike.operators.votes import best_with_total


def bags(seed, n, kinds, lengths, own=0):
    rng = random.Random(seed)
    rows = []
    for owner in range(n):
        mine = random.Random(owner) if owner % 2 else rng
        length = mine.choice(lengths)
        rows += [(f"t{mine.randrange(kinds)}", owner) for _ in range(length)]
        rows += [(f"r{owner % 7}-{i}", owner) for i in range(own)]
    return rows


def plain(cand, known):
    return best_of(literal_votes([(0, t, c) for t, c in cand], [(0, "any")], known))


def found(spark, cand, known, **more):
    got = best_with_total(
        spark.createDataFrame(cand, "token string, cand int"),
        spark.createDataFrame(known, "token string, image_id int"),
        **more,
    ).collect()
    return {r.cand: (r.best_match, r.agree_count, r.total) for r in got}


@pytest.mark.parametrize("kinds, lengths, own", [(20, (5, 6, 14), 1), (4, (3, 9), 0)])
def test_pairs_and_triples_are_exact(spark, monkeypatch, kinds, lengths, own):
    """Rare and common tokens, repeated ones, long bags, candidates left over."""
    monkeypatch.setattr(token_subsets, "RARE", 8)
    monkeypatch.setattr(token_subsets, "COMMON", 7)
    cand, known = bags(1, 60, kinds, lengths, own), bags(2, 160, kinds, lengths, own)
    assert found(spark, cand, known, leads=60) == plain(cand, known)


def test_common_tokens_need_no_blocks(spark, monkeypatch):
    """Each token leads to a tenth of the items, few share three of them."""

    def blocks(*_):
        raise AssertionError("blocks were asked")

    monkeypatch.setattr(votes, "best_by_blocks", blocks)
    monkeypatch.setattr(token_subsets, "RARE", 16)
    cand, known = bags(3, 80, 60, (6,)), bags(4, 400, 60, (6,))
    assert found(spark, cand, known, leads=60) == plain(cand, known)
