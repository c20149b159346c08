"""The pipeline on a small corpus, stage by stage against plain rules."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from lookalike.llm import bpe, secrets
from test_simhash import plain_groups


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(3)
    words = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(120):
        text = " ".join(r.choice(words) for _ in range(r.choice([5, 40, 200]))) + r.choice(["", " token=abcdef0123456789"])
        rows.append((i, text, "en", r.choice(["a", "b", None]), len(text)))
    rows += [(200 + i, rows[i][1], "en", "c", 0) for i in range(20)] + rows[:2]
    rows += [(300, None, None, None, None), (None, rows[5][1], "x", "a", 1), (301, "", "en", "a", 0), (302, "buy " * 100, "en", "a", 400)]
    folder = str(tmp_path_factory.mktemp("tables"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_stages_in_turn(spark, corpus, tmp_path):
    folder, rows = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = [(d, t) for d, t, *_ in rows if len((t or "").split()) >= 20 and not (t or "").startswith("buy")]
    assert sorted((str(r.doc_id), r.text) for r in seen["quality_rules"]) == sorted((str(d), t) for d, t in good)
    leaders = {g[2] for g in plain_groups(good)}
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted(leaders)
    clean = {r.doc_id: r.text for r in seen["secrets"]}
    for r in seen["near_duplicates"]:
        assert clean[r.doc_id] == r.text.replace("token=abcdef0123456789", secrets.MARK)
    assert all(r.n_chars == len(r.text) for r in seen["secrets"] if secrets.MARK in r.text)
    assert {r.text for r in seen["mixing"]} <= set(clean.values())
    sizes = sum(len(t.split()) for t in clean.values())
    assert sum(len(r.text.split()) for r in seen["mixing"]) == pytest.approx(sizes, rel=0.2)
    assert sorted(r.decoded.decode() for r in seen["tokens"]) == sorted(r.text for r in seen["mixing"])


def test_run_equals_the_stages(spark, corpus):
    folder, _ = corpus
    first, again = (sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert first == again and first
    path, pattern = bpe.default_vocabulary()
    library = bpe._tables(bpe.read_ranks(path), pattern)[0]
    for r in corpus_pipeline.run(spark, folder).limit(20).collect():
        assert list(r.tokens) == library.encode_ordinary(r.decoded.decode())


def test_empty_tables(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
