"""Repeated byte strings by blockwise suffix sorting with a difference cover.

Only strings of ``length`` bytes are compared, so a suffix counts by its first
``length`` bytes, and only ties matter: suffixes are sorted by names (hashes)
of what they begin with, which puts equal beginnings side by side as the
alphabet would.

1. Texts come in slices, stored once in the shared folder.
2. The places whose residue belongs to a difference cover of period v are
   named by their first ``length`` - v + 1 bytes and ranked across all slices.
   Any two suffixes have a distance below v at which both are in the cover, so
   a suffix that ties over ``length`` bytes meets a rank held twice within v
   bytes. All others are settled by these ranks and sorted no further.
3. The remaining suffixes go to buckets by the range of their names. A task
   sorts one bucket at a time; what ties is repeated. Whole copies of a
   document are known from its digest: one of them is sorted for all.
4. A slice marks the bytes that its repeated suffixes begin with.

Names and answers travel as packed lists per slice and bucket, a name once per
slice, so a passage in a third of all texts makes no bucket larger than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import fresh_dir
from .common import as_bytes, bounded_batches
from .packing import pack, unpack

LENGTH = 200
SLICE_BYTES = 8 << 20
RANK_BITS = 40  # a false tie of ranks costs time only
NAME_BITS = 64
#: Perfect difference sets, by period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)}
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def period_for(length: int) -> int:
    """The longest period that leaves at least a third of ``length``."""
    fit = [v for v in COVERS if 3 * (length - v + 1) >= length]
    if not fit:
        raise ValueError("strings must have 10 bytes or more")
    return max(fit)


def names(data, width: int, chunk: int = 1 << 16):
    """64-bit names of all strings of ``width`` bytes (numpy), by doubling.

    Works through ``data`` in chunks that stay in the processor's cache.
    """
    import numpy as np

    dice = np.random.default_rng(2024)
    letters = dice.integers(0, 2**64, 256, dtype=np.uint64)
    odd = dice.integers(0, 2**63, (2, 2 * width.bit_length() + 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def joined(a, b, level):
        x = a * odd[0, level]
        x ^= x >> np.uint64(32)
        x += b
        x *= odd[1, level]
        x ^= x >> np.uint64(29)
        return x

    n = max(0, len(data) - width + 1)
    out = np.empty(n, np.uint64)
    for at in range(0, n, chunk):
        size = min(chunk, n - at)
        h, k, level, done, whole = letters[data[at : at + size + width - 1]], 1, 0, 0, None
        while True:
            if width & k:
                part = h[done : done + size]
                whole = part if whole is None else joined(whole, part, odd.shape[1] // 2 + level)
                done += k
            if 2 * k > width:
                break
            h, k, level = joined(h[:-k], h[k:], level), 2 * k, level + 1
        out[at : at + size] = whole
    return out


def _slices(docs: DataFrame) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{number}"]),
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([pack([len(t) for t in texts], np.uint64)], pa.binary()),
                    pa.array([pack(np.frombuffer(b"".join(texts), np.uint8), np.uint8)], pa.binary()),
                ],
                ["slice", "ids", "sizes", "text"],
            )

    return docs.mapInArrow(run, "slice string, ids array<long>, sizes binary, text binary")


class _Slice:
    """A slice's bytes, and what every step works out of them again."""

    def __init__(self, sizes: bytes, text: bytes, length: int, period: int):
        import numpy as np

        self.length, self.period = length, period
        self.sizes = unpack(sizes, np.uint64).astype(np.int64)
        self.data = unpack(text, np.uint8)
        self.ends = np.cumsum(self.sizes)
        # bytes from each place to the end of its document
        self.room = (np.repeat(self.ends, self.sizes) - np.arange(len(self.data))).astype(np.int32)

    def digests(self) -> list[bytes]:
        """Of the documents long enough to hold a string."""
        from xxhash import xxh3_128_digest

        return [
            xxh3_128_digest(self.data[e - n : e]) if n >= self.length else b"" for e, n in zip(self.ends.tolist(), self.sizes.tolist())
        ]

    def cover(self):
        """Places in the cover, and their ranks, in the order of ranks."""
        import numpy as np

        width = self.length - self.period + 1
        inside = np.zeros(self.period, bool)
        inside[list(COVERS[self.period])] = True
        mask = np.resize(inside, len(self.data)) if len(self.data) else np.zeros(0, bool)
        places = np.flatnonzero(mask & (self.room >= width) & np.repeat(self.sizes >= self.length, self.sizes))
        ranks = names(self.data, width)[places] >> np.uint64(NAME_BITS - RANK_BITS)
        order = np.argsort(ranks, kind="stable")
        return places[order], ranks[order]

    def open_suffixes(self, places, twice, codes):
        """Suffixes that the ranks do not settle, and their distinct names."""
        import numpy as np

        near = np.zeros(len(self.data) + self.period + 1, np.int32)
        near[places[twice]] = 1
        near = np.concatenate([[0], np.cumsum(near)])
        n = len(self.data)
        some = near[self.period : self.period + n] > near[:n]
        some &= (self.room >= self.length) & np.repeat(codes != 2, self.sizes)
        starts = np.flatnonzero(some)
        if not len(starts):
            return starts, np.zeros(0, np.uint64), starts, starts
        distinct, inverse, counts = np.unique(names(self.data, self.length)[starts], return_inverse=True, return_counts=True)
        return starts, distinct, inverse, counts


def _lists(values, bits: int, buckets: int) -> list[bytes]:
    """Ascending ``values`` below 2^bits as packed differences per bucket."""
    import numpy as np

    edges = np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)
    cuts = [*np.searchsorted(values, edges).tolist(), len(values)]
    out = []
    for b in range(buckets):
        own = values[cuts[b] : cuts[b + 1]].copy()
        own[1:] -= own[:-1].copy()
        if len(own):
            own[0] -= edges[b]
        out.append(pack(own, np.uint64) if len(own) else b"")
    return out


def _ties(lists: list[bytes]) -> list[bytes]:
    """For each list a bit per value: whether the bucket has it twice."""
    import numpy as np

    own = [np.cumsum(unpack(x, np.uint64)) if x else np.zeros(0, np.uint64) for x in lists]
    _, inverse, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    bits, at, out = counts[inverse] > 1, 0, []
    for x in own:
        out.append(np.packbits(bits[at : at + len(x)]).tobytes())
        at += len(x)
    return out


def _bits(lists: list[bytes], values, bits: int, buckets: int):
    """The answers of all buckets in the order of ``values``."""
    import numpy as np

    edges = np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)
    sizes = np.diff([*np.searchsorted(values, edges).tolist(), len(values)])
    got = [np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for x, n in zip(lists, sizes)]
    return np.concatenate([np.zeros(0, np.uint8), *got]).astype(bool)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, the
    kept bytes and their SHA-256.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere
    else as well, in another document or in the same one. Null texts are
    empty. Repeated rows are documents like others, so long ones go whole.
    Ids may repeat or be null. Other columns are not read. An empty table
    gives an empty one. A task holds about 40 bytes per byte of a slice, which
    is 8 MB of texts or one longer text.
    """
    spark, period = docs.sparkSession, period_for(length)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounded_batches(spark, SLICE_BYTES)
    place = fresh_dir(spark, "repeat_slices")
    table = place.rsplit("/", 1)[-1].replace("-", "_")
    writer = _slices(docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"))).write
    writer.bucketBy(buckets, "slice").option("compression", "none").option("path", place).saveAsTable(table)
    slices = spark.table(table)

    def rows(pa, names_, *columns):
        types = {"slice": pa.string(), "bucket": pa.int32(), "step": pa.int32()}
        return {n: pa.array(c, types.get(n, pa.binary())) for n, c in zip(names_, columns)}

    def rank(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                here = _Slice(row["sizes"], row["text"], length, period)
                digests = [[] for _ in range(buckets)]
                for d in here.digests():
                    if d:
                        digests[int.from_bytes(d[:4], "big") % buckets].append(d)
                lists = _lists(here.cover()[1], RANK_BITS, buckets)
                columns = [row["slice"]] * buckets, range(buckets), lists, [b"".join(d) for d in digests]
                yield pa.RecordBatch.from_pydict(rows(pa, ("slice", "bucket", "list", "digests"), *columns))

    def rank_bucket(table):
        import pyarrow as pa

        seen, first = {}, set()
        cut = [[d[i : i + 16] for i in range(0, len(d), 16)] for d in table["digests"].to_pylist()]
        for digests in cut:
            for d in digests:
                seen[d] = seen.get(d, 0) + 1
        codes = []
        for digests in cut:
            own = bytearray()
            for d in digests:
                own.append(0 if seen[d] == 1 else 2 if d in first else 1)
                first.add(d)
            codes.append(bytes(own))
        ties = _ties(table["list"].to_pylist())
        return pa.table({"slice": table["slice"], "bucket": table["bucket"]} | rows(pa, ("ties", "codes"), ties, codes))

    def opened(own, ranked):
        """The slice, its documents' codes and its open suffixes."""
        import numpy as np

        row = own.select(["slice", "ids", "sizes", "text"]).to_pylist()[0]
        here = _Slice(row["sizes"], row["text"], length, period)
        ranked = ranked.sort_by("bucket").to_pylist()
        answers = [iter(r["codes"]) for r in ranked]
        codes = np.array([next(answers[int.from_bytes(d[:4], "big") % buckets]) if d else 0 for d in here.digests()], np.uint8)
        places, ranks = here.cover()
        twice = _bits([r["ties"] for r in ranked], ranks, RANK_BITS, buckets)
        return row, here, codes, here.open_suffixes(places, twice, codes)

    def send(own, ranked):
        import pyarrow as pa

        row, _, _, (_, distinct, _, _) = opened(own, ranked)
        columns = [row["slice"]] * buckets, range(buckets), _lists(distinct, NAME_BITS, buckets)
        return pa.table(rows(pa, ("slice", "bucket", "list"), *columns))

    def sort_bucket(table):
        import pyarrow as pa

        ties = _ties(table["list"].to_pylist())
        columns = [2] * len(ties), ties, [b""] * len(ties)
        return pa.table({"slice": table["slice"], "bucket": table["bucket"]} | rows(pa, ("step", "ties", "codes"), *columns))

    def mark(own, answers):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        of = lambda step: answers.filter(pc.equal(answers["step"], step))
        row, here, codes, (starts, distinct, inverse, counts) = opened(own, of(1))
        ties = _bits(of(2).sort_by("bucket")["ties"].to_pylist(), distinct, NAME_BITS, buckets)
        again = starts[(ties | (counts > 1))[inverse]] if len(starts) else starts
        edge = np.zeros(len(here.data) + 1, np.int32)
        edge[again] += 1
        edge[again + length] -= 1
        gone = (np.cumsum(edge[:-1]) > 0) | np.repeat(codes > 0, here.sizes)
        out = []
        for end, size in zip(here.ends.tolist(), here.sizes.tolist()):
            own_gone = gone[end - size : end]
            kept = here.data[end - size : end][~own_gone].tobytes()
            spans = int(own_gone[:1].sum()) + int((own_gone[1:] & ~own_gone[:-1]).sum())
            out.append((size, size - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        types = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()
        columns = zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), types, zip(*out))
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64())} | {n: pa.array(list(c), t) for n, t, c in columns})

    ranked_place = fresh_dir(spark, "repeat-ranks")
    lists = slices.select("slice", "sizes", "text").mapInArrow(rank, "slice string, bucket int, list binary, digests binary")
    answered = lists.groupBy("bucket").applyInArrow(rank_bucket, "slice string, bucket int, ties binary, codes binary")
    answered.write.parquet(ranked_place)
    ranked = spark.read.parquet(ranked_place)
    by_slice = slices.groupBy("slice")
    sent = by_slice.cogroup(ranked.groupBy("slice")).applyInArrow(send, "slice string, bucket int, list binary")
    ties = sent.groupBy("bucket").applyInArrow(sort_bucket, "slice string, bucket int, step int, ties binary, codes binary")
    answers = ranked.select("slice", "bucket", F.lit(1).alias("step"), "ties", "codes").union(ties)
    return by_slice.cogroup(answers.groupBy("slice")).applyInArrow(mark, RESULT)


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
