"""Encoding, decoding and counting against the libraries themselves."""

import random
import unicodedata

import pytest
import tiktoken
from tokenizers import Tokenizer

from lookalike.llm import bpe, token_counts


def texts():
    r = random.Random(4)
    parts = ["the", " of", "'s", "'LL", "don't", "  ", "\n\n ", "\t", " 12", "³¼Ⅷ", "ß", "日本語", " 　x", "\x85a", "\xa0b", " ", "🙂", "é", "é", "_", "!?", " <|", "<|endoftext|>", "|>", "\x00", "\x1f", "ñandú", "ﬁ", "A" * 30]
    parts += [chr(c) for c in (0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000, 0x1C, 0x200B, 0xFEFF)]
    rows = [None, "", " ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "   x", "x   ", "z" * 20_000, "word " * 30_000]
    return rows + ["".join(r.choice(parts) for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 40, 400) for _ in range(12)]


def frame(spark):
    rows = [(i % 90, t) for i, t in enumerate(texts())] + [(None, "no id"), (1, ""), (1, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS tokens", "'q' AS digest").repartition(5)


@pytest.fixture(scope="module")
def encoder():
    path, pattern = bpe.default_vocabulary()
    return bpe._tables(bpe.read_ranks(path), pattern)[0]


def test_ids_and_bytes_equal_the_library(spark, encoder):
    df = frame(spark)
    want = sorted((str(r.doc_id), encoder.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in df.collect())
    got = sorted((str(r.doc_id), list(r.tokens), bytes(r.decoded)) for r in bpe.encode(df).collect())
    assert got == want
    assert bpe.report(df.limit(0)).count() == 0


def every_code_point(spark):
    """Each one between letters, digits, marks and white space."""
    chars = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = [f"{c}'s a{c}b 1{c}2 !{c}? {c} {c}{c}\n {c}x" for c in chars]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_ids_of_every_code_point(spark, encoder):
    texts, df = every_code_point(spark)
    got = dict(bpe.encode(df).select("doc_id", "tokens").collect())
    assert [t for i, t in enumerate(texts) if got[i] != encoder.encode_ordinary(t)] == []


def test_counts_of_every_code_point(spark, tmp_path):
    texts, df = every_code_point(spark)
    library = Tokenizer.from_file(token_counts.default_tokenizer())
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, str(tmp_path / "cache")).collect()}
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for i, t in enumerate(texts) if got[i] != len(want[i])] == []


def test_pattern_belongs_to_the_file(spark, tmp_path):
    """A tokenizer that splits otherwise is used as it is, under its own version."""
    import public_tokenizers

    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    df = frame(spark)
    want = sorted(str((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False)))) for r in df.collect())
    for _ in range(2):
        got = token_counts.token_counts(df, cache, tokenizer_path=path).select("doc_id", "n_tokens").collect()
        assert sorted(str(tuple(r)) for r in got) == want
    usual = token_counts.token_counts(df, cache).select("doc_id", "n_tokens").collect()
    assert sorted(str(tuple(r)) for r in usual) != want
    assert spark.read.parquet(cache).select("version").distinct().count() == 2


def test_other_vocabulary_is_a_parameter(spark):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    own = bpe._tables(bpe.read_ranks(path), pattern)[0]
    df = spark.createDataFrame([(1, "Größe und ñandú")], "doc_id long, text string")
    assert list(bpe.encode(df, ranks_path=path).first().tokens) == own.encode_ordinary("Größe und ñandú")


def test_counts_equal_the_library(spark, tmp_path):
    library = Tokenizer.from_file(token_counts.default_tokenizer())
    df = frame(spark)
    cache = str(tmp_path / "cache")
    got = sorted(map(str, token_counts.token_counts(df, cache).collect()))
    want = [
        (r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False)))
        for r in df.collect()
    ]
    assert got == sorted(f"Row(doc_id={d}, n_bytes={b}, n_tokens={n})" for d, b, n in want)
    assert token_counts.report(df.limit(0)).count() == 0


def test_only_misses_are_encoded_and_appended(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, "two")], "doc_id long, text string")
    token_counts.token_counts(first, cache)
    stored = spark.read.parquet(cache)
    assert stored.count() == 2
    # a wrong count in the cache is believed: the text is not encoded again
    planted = stored.where("n_tokens = 2").selectExpr("version", "sha2('three', 256) AS digest", "77L AS n_tokens")
    planted.limit(1).write.mode("append").parquet(cache)
    later = spark.createDataFrame([(4, "three"), (5, "two"), (6, "four four")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(later, cache).collect()}
    assert got[4] == 77 and got[6] == 2
    assert spark.read.parquet(cache).count() == 4
