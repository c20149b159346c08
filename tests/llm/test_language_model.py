"""The tries and the scores against plain counting."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from lookalike.llm import language_model as lm
from lookalike.llm.elias_fano import EliasFano, codes, values


@pytest.mark.parametrize("n,most", [(0, 9), (1, 0), (1, 2**63), (50, 60), (300, 2**20), (2000, 2**63)])
def test_lists_give_back_and_find(n, most):
    r = random.Random(n)
    numbers = sorted(r.randint(0, most) for _ in range(n)) if most < 2 * n else sorted({r.randint(0, most) for _ in range(n)})
    array = np.array(numbers, np.uint64)
    packed = EliasFano(len(array), *EliasFano.parts(array))
    if n:
        assert packed.get(np.arange(len(array))).tolist() == numbers
        assert array[packed.find(array)].tolist() == numbers
    absent = np.array([x for x in (0, 1, 7, most, most + 5, 2**63 + 1) if x not in set(numbers)], np.uint64)
    assert (packed.find(absent) == -1).all()


def test_codes_are_close():
    p = np.array([0, 1, 0.5, 1e-3, 1e-5])
    assert values(codes(p)) == pytest.approx(p, rel=0.03)


def rows():
    r = random.Random(9)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    out = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 30, 200])))) for i in range(60)]
    return out + [(100, None), (101, ""), (None, "W1 É é"), (5, "w1 w1"), (5, "w1 w1"), (102, "word " * 30_000)]


def plain(docs):
    texts = [(d, (t or "").encode().lower().split() + [1]) for d, t in docs]
    out = lambda d: d is not None and crc32(str(d).encode()) % 7 == 2
    ones, pairs = Counter(), Counter()
    for d, tokens in texts:
        if not out(d):
            ones.update(tokens)
            pairs.update(zip([0, *tokens], tokens))
    total, kinds = sum(ones.values()), len(ones)
    after, many = Counter(), Counter()
    for (c, _), n in pairs.items():
        after[c] += n
        many[c] += 1
    for d, tokens in texts:
        alone = [(ones[w] + 1) / (total + kinds + 1) for w in tokens]
        together = [
            max(pairs[c, w] - 0.75, 0) / after[c] + 0.75 * many[c] / after[c] * p if after[c] else p
            for c, w, p in zip([0, *tokens], tokens, alone)
        ]
        yield (str(d), out(d), len(tokens), sum(ones[w] > 0 for w in tokens), total, sum(map(math.log10, alone)), sum(map(math.log10, together)))


def test_scores_equal_plain_counting(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS slice").repartition(6)
    got = sorted((str(r[0]), *r[1:]) for r in lm.score(df).collect())
    want = sorted(plain(rows()))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5])
        assert g[6] == pytest.approx(w[6], abs=0.013 * w[2])
    assert lm.score(df.limit(0)).count() == 0


def test_counts_beyond_32_bits_and_too_many_words():
    import numpy as np

    from lookalike.llm import elias_fano
    from lookalike.llm.packing import pack, unpack

    words = np.array([3, 9], np.uint64)
    levels = elias_fano.Trie.levels(words, np.array([2**32 + 5, 1]), np.array([0]), np.array([9], np.uint64), np.array([4]), 0.5)
    _, counts, _ = elias_fano.Trie(levels).word(words)
    assert unpack(pack(counts, np.uint64), np.uint64).tolist() == [2**32 + 5, 1]


def test_a_shard_says_when_its_keys_run_out(monkeypatch):
    import numpy as np

    from lookalike.llm import elias_fano

    monkeypatch.setattr(elias_fano, "MOST_WORDS", 1)
    none = np.zeros(0, np.int64)
    with pytest.raises(ValueError, match="shuffle.partitions"):
        elias_fano.Trie.levels(np.array([1, 2], np.uint64), np.array([1, 1]), none, none.astype(np.uint64), none, 0.5)
