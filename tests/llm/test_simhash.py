"""SimHash groups against all pairs on small inputs."""

import random

import pytest
from xxhash import xxh64_intdigest

from lookalike.llm import simhash
from lookalike.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, most=2):
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = [plain_fingerprint(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(((d, f"{fps[i]:016x}", least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for base in range(12):
        text = [r.choice(words) for _ in range(r.choice([3, 30, 300, 900]))]
        for copy in range(r.choice([1, 2, 6])):
            rows.append((len(rows) * 7 % 101 + 101 * (len(rows) // 101), " ".join(text)))
            text[r.randrange(len(text))] = r.choice(words)
    return rows + [(900, ""), (901, None), (902, "One"), (903, "ONE\tTwo"), (904, "one two"), (905, "é " * 50)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_all_pairs(spark, seed):
    rows = corpus(seed)
    rows += rows[:3]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS entry")
    assert sorted(map(tuple, simhash.report(df).collect()), key=str) == plain_groups(rows)
    leaders = simhash.keep_leaders(df)
    assert leaders.columns == df.columns
    assert sorted(r.doc_id for r in leaders.collect()) == sorted({g[2] for g in plain_groups(rows)})


@pytest.mark.parametrize("most,segments,bucket", [(0, 2, 32), (1, 2, 1), (2, 2, 32), (2, 2, 1), (3, 4, 1), (4, 3, 32)])
def test_links_connect_all_close_fingerprints(spark, most, segments, bucket):
    r = random.Random(most)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
    signed = sorted(f - (1 << 64) if f >= 1 << 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long").coalesce(1)
    found = {r.node: r.component for r in components(simhash.links(df, most, segments, bucket)).collect()}
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= most
    for f in signed:
        reach, todo = {f}, [f]
        while todo:
            here = todo.pop()
            fresh = [g for g in signed if near(here, g) and g not in reach]
            reach.update(fresh)
            todo += fresh
        assert found.get(f, f) == min(reach)


@pytest.mark.parametrize("bucket", [4, 1000])
def test_a_crowded_segment_value_is_split(spark, bucket):
    """Many fingerprints with one lower half: chains, stars and loners."""
    r = random.Random(bucket)
    low, fps = 0x12345678, set()
    for _ in range(15):
        x = r.getrandbits(32)
        fps |= {x << 32 | low, (x ^ 1 << r.randrange(32)) << 32 | low, (x ^ 3 << r.randrange(31)) << 32 | low ^ 1}
        fps |= {x << 32 | low ^ 1 << r.randrange(32), (x ^ 7) << 32 | low}
    signed = sorted(f - (1 << 64) if f >= 1 << 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    table = simhash._table(df, 2, 2)
    crowded = table.groupBy("segment", "value").count().where(f"count > {bucket}")
    assert crowded.isEmpty() == (bucket == 1000)
    found = {r.node: r.component for r in components(simhash.links(df, 2, bucket=bucket)).collect()}
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    for f in signed:
        reach, todo = {f}, [f]
        while todo:
            here = todo.pop()
            fresh = [g for g in signed if near(here, g) and g not in reach]
            reach.update(fresh)
            todo += fresh
        assert found.get(f, f) == min(reach)


def test_segments_make_the_balls_small(spark):
    """What a fingerprint asks for follows its segments, not all 64 bits."""
    assert simhash.radii(2, 2) == [1, 0] and simhash.radii(1, 4) == [0, 0, -1, -1] and simhash.radii(7, 4) == [1] * 4
    df = spark.createDataFrame([(0,), (-1,)], "fp long")
    asked = {r.fp: r["count"] for r in simhash._probes(df, 2, 2).groupBy("fp").count().collect()}
    assert asked == {0: 34, -1: 2}  # the side whose lowest differing bit is clear asks
    assert simhash._probes(df, 7, 4).where("fp = 0").count() == 4 * 17
    with pytest.raises(ValueError):
        simhash.links(df, 2, segments=1)


def test_columns_under_internal_names_stay(spark):
    names = ["row", "id", "digest", "text_digest", "lead_id", "fp", "leader", "lead", "component", "no_id", "t", "_text_digest"]
    rows = [(i, "a b c d e" if i < 3 else f"other {i} words", *range(i, i + len(names))) for i in range(6)] + [(None, None, *[None] * len(names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = simhash.keep_leaders(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], *rows[3:]], key=str)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "zzz")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.report(df).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}
    assert simhash.keep_leaders(df).count() == 2
    assert simhash.report(df.limit(0)).count() == 0


def test_a_long_text_is_read_in_pieces():
    text = ("alpha beta gamma delta " * 60_000).encode()
    assert simhash.fingerprint(text) == plain_fingerprint(text[: len(text)].decode())


def test_components_of_a_long_chain(spark):
    df = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in components(df).collect()} == {0}
