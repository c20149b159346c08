"""Token counts from a cache keyed by digests.

A text is known by the SHA-256 of its bytes, a tokenizer by that of its file and pattern.
Counts found in the cache under both are taken from there. Of the other texts
every distinct one is encoded once, and its count is appended to the cache,
from which all documents then get theirs.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import fresh_dir
from .common import as_bytes, bounded_batches, whole
from .pretokens import java_pattern, pretokens, tokenizers_class

LIMIT = 512
#: Counts of distinct words that a Python worker remembers.
REMEMBERED = 400_000
#: Fixed value: what byte-level tokenizer files split by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_SCHEMA = "version string, digest string, n_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def own_pattern(content: str) -> str | None:
    """The expression that a tokenizer file splits by, if its pieces may be
    encoded one by one; None means that texts are encoded whole."""
    spec = json.loads(content)
    split = spec["pre_tokenizer"] or {}
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["special"] for t in spec["added_tokens"])
    return BYTE_LEVEL if byte_level and plain and spec["normalizer"] is None else None


@lru_cache(maxsize=2)
def _library(content: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, {}


def _pieces(text: Column, specials: list[str], pattern: str) -> Column:
    """Pre-tokens of ``text``; a special token is a piece of its own."""
    plain = pretokens(text, pattern)
    if not specials:
        return plain
    quoted = "|".join(rf"\Q{s}\E" for s in sorted(specials, key=len, reverse=True))
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){quoted}|.+?(?=(?:{quoted})|\z)"), 0)
    split = F.flatten(
        F.transform(parts, lambda p: F.when(p.isin(specials), F.array(p)).otherwise(pretokens(p, pattern)))
    )
    found = F.lit(False)
    for special in specials:
        found = found | F.contains(text, F.lit(special))
    return F.when(found, split).otherwise(plain)


def count_texts(texts: DataFrame, content: str, pattern: str | None) -> DataFrame:
    """(digest, n_tokens) of every row (digest, t): the library encodes the
    distinct pieces of a batch, and the counts are added up per text. Without
    a pattern a text is one piece."""
    spark = texts.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(content)
    specials = [t["content"] for t in json.loads(content)["added_tokens"] if t["special"]]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        tokenizer, known = _library(held.value)
        for batch in batches:
            pieces = batch.column(1)
            flat = pieces.flatten().dictionary_encode()
            words = flat.dictionary.to_pylist()
            fresh = [w for w in words if w not in known]
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                fresh = words
            for at in range(0, len(fresh), 20_000):
                part = fresh[at : at + 20_000]
                for word, got in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                    known[word] = len(got)
            counts = np.fromiter((known[w] for w in words), np.int64, len(words))
            running = np.concatenate([[0], np.cumsum(counts[flat.indices.to_numpy()])])
            ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(running[ends] - running[starts], pa.int64())], ["digest", "n_tokens"]
            )

    if pattern is None:
        pieces = F.array("t")
    else:
        pieces = _pieces(F.col("t"), specials, java_pattern(spark, pattern, tokenizers_class))
    rows = texts.select("digest", pieces.alias("pieces"))
    return rows.mapInArrow(run, "digest string, n_tokens long")


def token_counts(
    docs: DataFrame,
    cache: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): a row per row of ``docs``.

    ``cache`` is a Parquet folder of ``CACHE_SCHEMA``, made if it is not there
    and appended to. Null texts are empty and have no tokens; empty ones are
    cached like others. Ids may repeat or be null. Other columns are not read.
    An empty table gives an empty one. Special tokens inside texts count as
    one token, as the library has it. Pieces are those of ``pattern``, or what
    the tokenizer's file says; both are part of the version.
    """
    spark = docs.sparkSession
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as file:
        content = file.read()
    pattern = pattern or own_pattern(content)
    version = hashlib.sha256(f"{pattern}\n{content}".encode()).hexdigest()
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)

    def cached() -> DataFrame:
        """A text that two runs have added at the same time counts once."""
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
        return known.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    digest = F.sha2(as_bytes(text_col), 256).alias("digest")
    texts = docs.select(digest, whole(text_col).alias("t"))
    misses = texts.join(cached().select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    counted = count_texts(misses, content, pattern)
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), digest, F.octet_length(as_bytes(text_col)).cast("long").alias("n_bytes")
    )
    return rows.join(cached(), "digest").select("doc_id", "n_bytes", "n_tokens")


def report(docs: DataFrame) -> DataFrame:
    """With a cache of its own, so every distinct text is a miss."""
    counts = token_counts(docs, fresh_dir(docs.sparkSession, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
