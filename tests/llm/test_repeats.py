"""Removed bytes against a plain table of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lookalike.llm import repeats


def plain(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        yield str(d), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("period", sorted(repeats.COVERS))
def test_covers_hold_every_distance(period):
    cover = repeats.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_equal_strings_have_equal_names():
    r = random.Random(1)
    data = np.array([r.choice(b"ab") for _ in range(3000)], np.uint8)
    for width in (1, 5, 8, 13):
        got, raw = repeats.names(data, width, chunk=100), data.tobytes()
        of = {}
        for i, name in enumerate(got.tolist()):
            assert of.setdefault(raw[i : i + width], name) == name
        assert len(set(of.values())) == len(of)


@pytest.mark.parametrize("length,seed", [(200, 1), (200, 2), (20, 3), (12, 4)])
def test_equals_plain_counting(spark, length, seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdeé \n") for _ in range(n))
    shared = [text(r.choice([length - 2, length - 1, length, length + 1, 3 * length])) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [text(r.choice([0, 3, length, 4 * length]))]
        for _ in range(r.choice([0, 1, 3])):
            parts += [r.choice(shared), text(r.choice([0, 1, length]))]
        rows.append((i, "".join(parts)))
    rows += [(50, rows[0][1]), rows[1], (None, rows[2][1]), (60, None), (61, ""), (62, "z" * (length - 1)), (63, "y" * (3 * length)), (64, "short"), (65, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS slice").repartition(5)
    got = [(str(x[0]), *x[1:]) for x in repeats.remove_repeats(df, length=length).drop("kept").collect()]
    assert sorted(got) == sorted(plain(rows, length))


def test_empty_table_and_kept_bytes(spark):
    df = spark.createDataFrame([(1, "a" * 300), (2, "é")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(df).collect()}
    assert got == {1: b"", 2: "é".encode()}
    assert repeats.report(df.limit(0)).count() == 0
