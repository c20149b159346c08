"""Runs by tiles against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lookalike.llm import periodic


def plain_runs(words, exponent=4, least=6):
    n, found = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                part = words[i : i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    found.add((i, q, length))
            i = max(j, i + 1)
    return sorted(found)


def solved(words, core, together, exponent=4):
    """Tiles one after the other, stitched in Python."""
    ids = np.unique(np.asarray(words, object).astype(str), return_inverse=True)[1].astype(np.int32) if words else np.zeros(0, np.int32)
    spans = {}
    for t in periodic.tiles_of(ids, exponent, 6, core):
        part = ids[t["low"] : t["high"]]
        for q, a, b in periodic.solve_tile(part, t["low"], t["octave"], t["first"], t["last"], exponent, together):
            spans.setdefault(q, []).append((a, b))
    out = []
    for q, seen in spans.items():
        merged = []
        for a, b in sorted(seen):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out += [(a, q, b - a + q) for a, b in merged if b - a + q >= max(6, exponent * q)]
    return sorted(out)


def samples():
    r = random.Random(5)
    yield from ([], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 400, ["a", "b"] * 4, ["a", "b"] * 3, ["x"] + ["a", "b", "a"] * 40 + ["y"])
    for _ in range(250):
        words = []
        while len(words) < r.choice([10, 60, 300, 700]):
            kind, size = r.random(), r.choice([1, 2, 3, 5, 8, 17, 33, 64, 90])
            unit = [r.choice("abcd" if kind < 0.5 else "abcdefghijklmnopqrstuvwxyz") for _ in range(size)]
            words += unit * r.choice([1, 1, 2, 4, 5, 9]) + unit[: r.randrange(size + 1)]
            words += [str(r.random()) for _ in range(r.choice([0, 0, 1, 7]))]
        yield words


@pytest.mark.parametrize("core,together", [(1024, 64), (8, 0), (1, 64), (64, 8)])
def test_tiles_find_exactly_the_runs(core, together):
    for words in samples():
        assert solved(words, core, together) == plain_runs(words), words


def test_both_ways_of_the_z_functions_agree():
    r = np.random.default_rng(3)
    for s in (2, 4, 16, 64):
        for n in (1, 2, 5, 40, 300):
            words = r.integers(0, 3, n).astype(np.int32)
            at = np.arange(0, n, s)
            for a, b in zip(periodic._reach_by_boundary(words, at, s), periodic._reach_by_shift(words, at, s)):
                assert np.array_equal(np.minimum(a, s), np.minimum(b, s))


def test_equal_words_need_few_fragments():
    ids = np.zeros(50_000, np.int32)
    tiles = periodic.tiles_of(ids)
    assert len(tiles) < 1_000
    got = [f for t in tiles for f in periodic.solve_tile(ids[t["low"] : t["high"]], t["low"], t["octave"], t["first"], t["last"])]
    assert {q for q, _, _ in got} == {1} and len(got) < 100


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, q, length in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *found, sha(listed), sha(kept))


def test_query_against_the_plain_search(spark):
    texts = [" ".join(w) for w in samples()] + [None, "", " \n\t ", "a\x0bb\x0cc\x85d", "é " * 30, "a " * 2_000, "a b\n" * 900]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b " * 8), (None, "b " * 8), (3, "c " * 9), (3, "c " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS uid", "1 AS runs", "2 AS plain", "3 AS words")
    got = sorted(map(str, map(tuple, periodic.report(df.repartition(5)).collect())))
    assert got == sorted(str(expected(*r)) for r in rows)
    assert sum(r[1] > 0 for r in map(lambda r: expected(*r), rows)) > 100
    assert periodic.report(df.limit(0)).count() == 0


def test_collapsed_text_is_whole(spark):
    df = spark.createDataFrame([(1, "x a b a b a b a b y"), (2, "nothing  here"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: (r.text, r.n_words, [tuple(x) for x in r.runs]) for r in periodic.collapse(df).collect()}
    assert got == {1: ("x a b y", 10, [(1, 2, 8)]), 2: ("nothing here", 2, []), 3: ("", 0, [])}
