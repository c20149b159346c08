"""Byte-level BPE: every distinct word is encoded once, then joined back.

1. Documents become pre-tokens. A batch of them is a slice: its distinct words
   go out in packed lists, one per bucket of words, and its documents keep the
   place of each of their pre-tokens in the slice's dictionary.
2. A bucket gathers the lists of all slices. Equal words meet there, and each
   distinct word is encoded once. The ids go back in the order of the lists.
3. A slice gathers the ids of its words and puts the documents together by
   position. Decoding joins ids with the table of token bytes, which the
   vocabulary bounds.

A frequent word is one entry per slice, however often it occurs, so no key is
hot. What step 1 makes is stored in the shared folder, so that the two ways
from there agree whatever is lost.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import fresh_dir
from .common import bounded_batches, whole
from .packing import pack, unpack
from .pretokens import java_pattern, pretokens, ragged

SLICE_BYTES = 32 << 20


def default_vocabulary() -> tuple[str, str]:
    """Place of the rank file, and the pattern that belongs to it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def _tables(ranks: bytes, pattern: str):
    """The library's encoder, and the bytes of each id."""
    import tiktoken

    rows = {base64.b64decode(t): int(i) for t, i in map(bytes.split, ranks.splitlines())}
    of_id = {i: t for t, i in rows.items()}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=rows, special_tokens={}), of_id


def _slices(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """Rows of two kinds: documents of a slice (bucket -1), and its words.

    ``a`` and ``b`` hold lengths and letters of the words, or number of
    pre-tokens of each document and their places; ``c`` of a slice holds, for
    its words in the order of the lists, their places in the dictionary.
    """
    key = docs.columns[0]

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            pieces = batch.column(1)
            flat = pieces.flatten().cast(pa.binary()).dictionary_encode()
            words, index = flat.dictionary, flat.indices.to_numpy()
            # frequent words get small places, which pack well
            ranks = np.empty(len(words), np.uint32)
            ranks[np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")] = np.arange(len(words))
            order = pc.sort_indices(words).to_numpy()
            words = words.take(pa.array(order)).to_pylist()
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            by_bucket = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
            rows = [
                (-1, batch.column(0), pack(pc.list_value_length(pieces).to_numpy(), np.uint32),
                 pack(ranks[index], np.uint32), pack(ranks[order[by_bucket]], np.uint32))
            ]
            for b in range(buckets):
                own = [words[i] for i in by_bucket[cuts[b] : cuts[b + 1]]]
                if own:
                    rows.append((b, [], pack([len(w) for w in own], np.uint32), pack(np.frombuffer(b"".join(own), np.uint8), np.uint8), b""))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{number}"] * len(rows)),
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1].to_pylist() if r[0] < 0 else [] for r in rows], pa.list_(batch.column(0).type)),
                    *[pa.array([r[k] for r in rows], pa.binary()) for k in (2, 3, 4)],
                ],
                ["slice", "bucket", "ids", "a", "b", "c"],
            )

    texts = docs.select(key, pretokens(F.col("t"), java_pattern(docs.sparkSession, pattern)).alias("pieces"))
    kind = docs.schema[key].dataType.simpleString()
    return texts.mapInArrow(run, f"slice string, bucket int, ids array<{kind}>, a binary, b binary, c binary")


def _stored(slices: DataFrame, buckets: int) -> DataFrame:
    """Written once to the shared folder, in buckets by slice: what comes back
    for a slice then meets it without moving it again."""
    spark, place = slices.sparkSession, fresh_dir(slices.sparkSession, "bpe_slices")
    table = place.rsplit("/", 1)[-1].replace("-", "_")
    writer = slices.write.format("parquet").bucketBy(buckets, "slice").option("compression", "none")
    writer.option("path", place).saveAsTable(table)
    return spark.table(table)


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """(doc_id, tokens array<int>, decoded binary): a row per row of ``docs``.

    Null texts are empty and have no tokens. Ids need not be unique or known;
    equal rows stay apart. Other columns are not read. An empty table gives an
    empty one. Pieces are those of ``pattern``; special tokens are plain text.
    """
    return _assembled(docs, id_col, text_col, ranks_path, pattern, digest=False)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path=None, pattern=None) -> DataFrame:
    """Like ``encode``, with the tokens' number and SHA-256 of ids and text."""
    return _assembled(docs, id_col, text_col, ranks_path, pattern, digest=True)


def _assembled(docs, id_col, text_col, ranks_path, pattern, digest) -> DataFrame:
    spark = docs.sparkSession
    path, usual = default_vocabulary()
    pattern = pattern or usual
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path or path))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounded_batches(spark, SLICE_BYTES)
    keyed = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("t"))
    stored = _stored(_slices(keyed, pattern, buckets), buckets)

    def encode_bucket(table):
        import numpy as np
        import pyarrow as pa

        encoder, _ = _tables(ranks.value, pattern)
        single, known, out = encoder._core_bpe.encode_single_piece, {}, []
        for sizes, letters in zip(table["a"].to_pylist(), table["b"].to_pylist()):
            letters, at, counts, ids = unpack(letters, np.uint8).tobytes(), 0, [], []
            for size in unpack(sizes, np.uint32).tolist():
                word = letters[at : at + size]
                at += size
                got = known.get(word)
                if got is None:
                    got = known[word] = single(word)
                counts.append(len(got))
                ids += got
            out.append((pack(counts, np.uint32), pack(ids, np.uint32)))
        return pa.table(
            {
                "slice": table["slice"],
                "bucket": table["bucket"],
                "counts": pa.array([o[0] for o in out], pa.binary()),
                "tokens": pa.array([o[1] for o in out], pa.binary()),
            }
        )

    id_type = keyed.schema["doc_id"].dataType.simpleString()
    result = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "tokens array<int>, decoded binary"

    def assemble(slices, coded):
        import hashlib

        import numpy as np
        import pyarrow as pa

        _, of_id = _tables(ranks.value, pattern)
        bytes_of = of_id.__getitem__
        coded = coded.sort_by("bucket")
        empty = np.zeros(0, np.uint32)
        counts = np.concatenate([empty, *[unpack(c, np.uint32) for c in coded["counts"].to_pylist()]])
        tokens = np.concatenate([empty, *[unpack(t, np.uint32) for t in coded["tokens"].to_pylist()]])
        for row in slices.select(["a", "b", "c"]).to_pylist():
            places = unpack(row["c"], np.uint32)
            starts, lengths = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
            lengths[places] = counts
            starts[places] = np.cumsum(counts, dtype=np.int64) - counts
            words, at, rows = unpack(row["b"], np.uint32), 0, []
            for n in unpack(row["a"], np.uint32).tolist():
                own = words[at : at + n]
                at += n
                ids = tokens[ragged(starts[own], lengths[own])]
                text = b"".join(map(bytes_of, ids.tolist()))
                if digest:
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
                else:
                    rows.append((ids.astype(np.int32), text))
        doc_ids = slices["ids"].combine_chunks().flatten()
        columns = list(zip(*rows)) or [[]] * (3 if digest else 2)
        if digest:
            types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        else:
            types = {"tokens": pa.list_(pa.int32()), "decoded": pa.binary()}
        return pa.table({"doc_id": doc_ids} | {n: pa.array(list(c), t) for (n, t), c in zip(types.items(), columns)})

    coded = (
        stored.where("bucket >= 0")
        .select("slice", "bucket", "a", "b")
        .groupBy("bucket")
        .applyInArrow(encode_bucket, "slice string, bucket int, counts binary, tokens binary")
    )
    slices = stored.where("bucket < 0").select("slice", "ids", "a", "b", "c")
    return slices.groupBy("slice").cogroup(coded.groupBy("slice")).applyInArrow(assemble, f"doc_id {id_type}, {result}")


def report(docs: DataFrame) -> DataFrame:
    return digests(docs)
