"""Held-out accuracy, and the odd inputs."""

from pathlib import Path
from zlib import crc32

import pytest

from lookalike.llm import classifier

TABLES = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not TABLES.exists(), reason="no tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.93 * len(held) and len(held) > 50
    ranks = [(a.score > b.score) + (a.score == b.score) / 2 for a in held if a.quality for b in held if not b.quality]
    assert sum(ranks) / len(ranks) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_nulls_empty_texts_and_few_labels(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (3, "x " * 9, None), (None, "y", "c"), (3, "x " * 9, None), (4, "long " * 30_000, "d")],
        "doc_id long, text string, label string",
    )
    for rows, low, high in (([], 0.5, 0.5), ([(3, 1), (3, None), (None, 0), (99, 0)], 0.6, 1)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        got = classifier.classify(docs, labels).collect()
        assert len(got) == 6 and all(low <= r.score <= high for r in got)
        assert not any(r.held_out for r in got if r.doc_id is None)
    assert classifier.classify(docs.limit(0), labels).count() == 0


def test_rules_read_statistics_only(spark):
    names = classifier.statistics(spark.createDataFrame([(1, "a B! a.")], "doc_id long, text string")).columns
    assert names == ["doc_id", *classifier.FEATURES]
    rule = classifier.Rule((("upper", 0.1, 0.5), ("marks", float("-inf"), 1.0)), 2.0)
    df = spark.createDataFrame([(0.3, 1.0), (0.6, 0.0), (0.1, 0.0)], "upper double, marks double")
    assert [r[0] for r in df.select(rule.holds()).collect()] == [True, False, False]
