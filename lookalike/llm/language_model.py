"""Scores of texts under a bigram model kept as Elias-Fano tries.

1. Documents come in slices. A slice sorts its distinct words and pairs, with
   their counts in training documents, into lists by shard of the (context)
   word. It keeps its own tokens, stored once in the shared folder.
2. A shard adds up the lists of all slices, smooths the counts by absolute
   discounting, builds its trie, maps it into memory, and looks the slices'
   words and pairs up in it.
3. A slice gathers the answers and adds them up per document.

Lists hold distinct words and pairs, so what a common word sends is bounded by
the kinds of its successors. Words are known by 64-bit hashes, and successors
within a context by 40 bits of them.

P(w | c) = max(n(c, w) - D, 0) / n(c) + D kinds(c) / n(c) P(w), and
P(w) = (n(w) + 1) / (N + V + 1). Both parts of the sum are quantised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import fresh_dir
from .common import as_bytes, bounded_batches, held_out_rows, word_lists
from .packing import pack, unpack

SLICE_BYTES = 8 << 20
SHARDS_A_PARTITION = 2
DISCOUNT = 0.75
MODULUS, REST = 7, 2
BEGIN, END = 0, 1  # stand for hashes
ANSWERS = "slice string, shard int, counts binary, backoffs binary, codes binary, n long, v long"


def _pairs(stream, sizes, begin: int):
    """Distinct (context, word) places of a slice in order, and each token's
    pair. Every document's first token follows ``begin``."""
    import numpy as np

    contexts = np.empty_like(stream)
    contexts[1:] = stream[:-1]
    contexts[np.cumsum(sizes) - sizes] = begin
    span = np.int64(max(int(stream.max(initial=0)), begin) + 1)
    keys, inverse = np.unique(contexts.astype(np.int64) * span + stream, return_inverse=True)
    return keys // span, keys % span, inverse


def _slices(docs: DataFrame, shards: int) -> DataFrame:
    """Rows of two kinds. Shard -1: the slice's documents and tokens. Other
    shards: ``a`` words, ``b`` their counts, ``c`` kinds of successors, ``d``
    successors and ``e`` their counts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        from .elias_fano import WORD_BITS

        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            known, hashes, sizes = {}, [], []
            for text in batch.column(2):
                size = 1
                for words in word_lists(text.as_py().lower()):
                    for w in words:
                        h = known.get(w)
                        if h is None:
                            h = known[w] = xxh64_intdigest(w)
                        hashes.append(h)
                    size += len(words)
                hashes.append(END)
                sizes.append(size)
            del known
            tokens, sizes = np.array(hashes, np.uint64), np.array(sizes, np.int64)
            del hashes
            words = np.unique(np.append(tokens, np.uint64(BEGIN)))
            words = words[np.argsort(words % np.uint64(shards), kind="stable")]
            order = np.argsort(words)
            place = lambda x: order[np.searchsorted(words, x, sorter=order)]
            stream, begin = place(tokens), int(place(np.array([BEGIN], np.uint64))[0])
            contexts, successors, inverse = _pairs(stream, sizes, begin)
            taught = np.repeat(~np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool), sizes)
            counts = np.bincount(stream[taught], minlength=len(words))
            seen = np.bincount(inverse[taught], minlength=len(contexts))
            kinds = np.bincount(contexts, minlength=len(words))
            short = words[successors] & np.uint64((1 << WORD_BITS) - 1)
            rows = [(-1, b"", pack(sizes, np.uint32), pack(stream, np.uint32), pack([begin], np.uint32), b"")]
            cuts = np.searchsorted(words % np.uint64(shards), np.arange(shards + 1, dtype=np.uint64))
            ends = np.concatenate([[0], np.cumsum(kinds)])
            for s in range(shards):
                a, z = cuts[s], cuts[s + 1]
                if a < z:
                    p, q = ends[a], ends[z]
                    rows.append((s, pack(words[a:z], np.uint64), pack(counts[a:z], np.uint32), pack(kinds[a:z], np.uint32), pack(short[p:q], np.uint64), pack(seen[p:q], np.uint32)))
            ids = batch.column(0).to_pylist()
            flags = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{number}"] * len(rows)),
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([ids if r[0] < 0 else [] for r in rows], pa.list_(pa.int64())),
                    pa.array([flags if r[0] < 0 else [] for r in rows], pa.list_(pa.bool_())),
                    *[pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6)],
                ],
                ["slice", "shard", "ids", "flags", *"abcde"],
            )

    kinds = ", ".join(f"{c} binary" for c in "abcde")
    return docs.mapInArrow(run, f"slice string, shard int, ids array<long>, flags array<boolean>, {kinds}")


def _trained(lists: list[dict], discount: float) -> dict:
    """Levels of a shard's trie from the lists of all slices."""
    import numpy as np

    from .elias_fano import Trie

    each = [[unpack(r[k], t) for k, t in (("a", np.uint64), ("b", np.uint32), ("c", np.uint32), ("d", np.uint64), ("e", np.uint32))] for r in lists]
    every, inverse = np.unique(np.concatenate([e[0] for e in each]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([e[1] for e in each]), minlength=len(every)).astype(np.int64)
    contexts = np.repeat(inverse, np.concatenate([e[2] for e in each]))
    successors, seen = (np.concatenate([e[k] for e in each]) for k in (3, 4))
    taught = seen > 0
    contexts, successors, seen = contexts[taught], successors[taught], seen[taught]
    order = np.lexsort((successors, contexts))
    contexts, successors, seen = contexts[order], successors[order], seen[order]
    first = np.ones(len(order), bool)
    first[1:] = (contexts[1:] != contexts[:-1]) | (successors[1:] != successors[:-1])
    seen = np.add.reduceat(seen.astype(np.int64), np.flatnonzero(first)) if len(order) else seen
    contexts, successors = contexts[first], successors[first]
    # the model knows what training has shown: words, and the beginning
    known = counts > 0
    known[contexts] = True
    renumber = np.cumsum(known) - 1
    return Trie.levels(every[known], counts[known], renumber[contexts], successors, seen, discount)


def _mapped(levels: dict, folder: str):
    """The levels as files of a task's own temporary folder, mapped."""
    import os

    import numpy as np

    from .elias_fano import Trie

    def one(name, array):
        if not array.size:
            return array
        path = os.path.join(folder, name)
        array.tofile(path)
        return np.memmap(path, array.dtype, "r", shape=array.shape)

    return Trie({f: tuple(one(f"{f}{k}", x) for k, x in enumerate(v)) if isinstance(v, tuple) else one(f, v) for f, v in levels.items()})


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = MODULUS,
    rest: int = REST,
    discount: float = DISCOUNT,
) -> DataFrame:
    """A row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score, both sums of log10.

    Texts with crc32(id) mod ``modulus`` = ``rest`` teach nothing; null ids
    teach. Null and empty texts are one token, the end. Repeated rows count
    and are scored as often. Other columns are not read. An empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = SHARDS_A_PARTITION * partitions
    bounded_batches(spark, SLICE_BYTES)
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out_rows(doc_id, modulus, rest).alias("out"), as_bytes(text_col).alias("t"))
    place = fresh_dir(spark, "lm_slices")
    table = place.rsplit("/", 1)[-1].replace("-", "_")
    slices = _slices(rows, shards).write.format("parquet").bucketBy(partitions, "slice")
    slices.option("compression", "none").option("path", place).saveAsTable(table)

    def answer(lists):
        import tempfile

        import numpy as np
        import pyarrow as pa

        rows = lists.to_pylist()
        levels, out = _trained(rows, discount), []
        with tempfile.TemporaryDirectory() as folder:
            trie = _mapped(levels, folder)
            for r in rows:
                at, counts, backoffs = trie.word(unpack(r["a"], np.uint64))
                found = trie.pair(np.repeat(at, unpack(r["c"], np.uint32)), unpack(r["d"], np.uint64))
                out.append((pack(counts, np.uint64), pack(backoffs, np.uint8), pack(found, np.uint8)))
            del trie
        total, kinds = int(levels["counts"].sum()), int((levels["counts"] > 0).sum())
        first = [1] + [0] * (len(rows) - 1)
        return pa.table(
            {
                "slice": lists["slice"],
                "shard": lists["shard"],
                **{n: pa.array([o[k] for o in out], pa.binary()) for k, n in enumerate(("counts", "backoffs", "codes"))},
                "n": pa.array([total * f for f in first], pa.int64()),
                "v": pa.array([kinds * f for f in first], pa.int64()),
            }
        )

    answers = fresh_dir(spark, "lm-answers")
    lists = spark.table(table).where("shard >= 0").select("slice", "shard", *"abcde")
    lists.groupBy("shard").applyInArrow(answer, ANSWERS).write.option("compression", "none").parquet(answers)
    answered = spark.read.schema(ANSWERS).parquet(answers)
    tokens, kinds = answered.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def assemble(own, found):
        import numpy as np
        import pyarrow as pa

        from .elias_fano import values

        found = found.sort_by("shard").to_pylist()
        counts, backoffs, codes = (
            np.concatenate([unpack(f[k], t) for f in found]) for k, t in (("counts", np.uint64), ("backoffs", np.uint8), ("codes", np.uint8))
        )
        row = own.to_pylist()[0]
        sizes, stream = unpack(row["b"], np.uint32).astype(np.int64), unpack(row["c"], np.uint32).astype(np.int64)
        contexts, successors, inverse = _pairs(stream, sizes, int(unpack(row["d"], np.uint32)[0]))
        alone = (counts.astype(np.float64) + 1) / (tokens + kinds + 1)
        together = values(codes) + values(backoffs)[contexts] * alone[successors]
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, starts) if len(x) else x
        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "held_out": pa.array(row["flags"], pa.bool_()),
                "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(add((counts[stream] > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array([tokens] * len(sizes), pa.int64()),
                "base_score": pa.array(add(np.log10(alone)[stream]), pa.float64()),
                "score": pa.array(add(np.log10(together)[inverse]), pa.float64()),
            }
        )

    kept = spark.table(table).where("shard < 0").select("slice", "ids", "flags", "b", "c", "d")
    back = answered.select("slice", "shard", "counts", "backoffs", "codes")
    return kept.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(
        assemble,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
