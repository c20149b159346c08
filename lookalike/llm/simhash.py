"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments, and a table holds its value under every
segment. Of two fingerprints within ``max_distance`` bits some segment differs
by few bits: with d = segments * r + a, one of the first a + 1 segments by at
most r, or one of the others by at most r - 1. So each fingerprint asks, per
segment, for the values in that small Hamming ball around its own; of two sides
the one whose lowest differing bit is clear asks for the other. What the table
returns is compared on all 64 bits.

A segment value shared by more than ``BUCKET`` fingerprints is crowded and
would return too many. It is split by the bits outside the segment: each of its
fingerprints is entered at the points around these bits within half of the
distance, and those who ask come with what is left of the distance. Whoever
meets at a point is within reach, so each asker is linked to the least entry of
the point and no list of pairs arises. Nothing is left out either way.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut_lineage
from .common import as_bytes, bounded_batches, word_lists
from .components import components

SHINGLE = 3
MAX_DISTANCE = 2
SEGMENTS = 2
#: Fingerprints that one segment value returns; it is split beyond.
BUCKET = 32
SEED = 42


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes; zero without words.

    Works through the text in pieces, so memory does not follow its length.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    ones, n, words = np.zeros(64, np.int64), 0, []

    def add(texts) -> int:
        hashes = np.fromiter((xxh64_intdigest(t, SEED) for t in texts), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones.__iadd__(bits.sum(0, dtype=np.int64))
        return len(hashes)

    for piece in word_lists(data.lower()):
        words += piece
        n += add(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
        words = words[max(0, len(words) - shingle + 1) :]
    if not n and words:
        n = add([b" ".join(words)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """(doc_id, fp, digest): the 64 bits as a long, and md5 of the text.

    A row per row of ``docs``; a null text counts as empty. Other columns of
    ``docs`` are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            bits = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            digests = [hashlib.md5(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bits, pa.int64()), pa.array(digests, pa.binary())],
                ["doc_id", "fp", "digest"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long, digest binary")


def ball(radius: int, bits: range) -> list[tuple[int, int]]:
    """(XOR mask, bits set) of all masks of ``radius`` bits or fewer among ``bits``."""
    return [(sum(1 << b for b in some), n) for n in range(radius + 1) for some in combinations(bits, n)]


def segment_bits(segment: int, segments: int) -> range:
    return range(64 * segment // segments, 64 * (segment + 1) // segments)


def radii(max_distance: int, segments: int) -> list[int]:
    """How far to look in each segment; -1 where it need not be asked."""
    near, more = divmod(max_distance, segments)
    return [near if s <= more else near - 1 for s in range(segments)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def _rows(columns: tuple[str, ...], rows: list[tuple[int, ...]]) -> Column:
    """One row per tuple, as a column to explode."""
    return F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(columns, row)]) for row in rows]))


def _table(fps: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """(segment, value, fp): every fingerprint under its segments."""
    asked = [s for s, radius in enumerate(radii(max_distance, segments)) if radius >= 0]
    parts = [(s, _mask(segment_bits(s, segments))) for s in asked]
    cut = fps.select("fp", _rows(("segment", "bits"), parts).alias("p"))
    return cut.select("p.segment", F.col("fp").bitwiseAND(F.col("p.bits")).alias("value"), "fp")


def _probes(fps: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """(segment, value, fp, spent): values that ``fp`` asks for, and how many
    bits of the distance they take."""
    asked = []
    for s, radius in enumerate(radii(max_distance, segments)):
        bits = segment_bits(s, segments)
        asked += [(s, _mask(bits), _signed(m), _signed(m & -m), n) for m, n in ball(radius, bits)]
    found = fps.select("fp", _rows(("segment", "bits", "flip", "low", "spent"), asked).alias("p"))
    return found.where(F.col("fp").bitwiseAND(F.col("p.low")) == 0).select(
        "p.segment",
        F.col("fp").bitwiseAND(F.col("p.bits")).bitwiseXOR(F.col("p.flip")).alias("value"),
        "fp",
        "p.spent",
    )


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _points(rows: DataFrame, radius: Column, most: int, segments: int) -> DataFrame:
    """(segment, point, fp): the row's segment value, and its other bits with
    up to ``radius`` of them flipped."""
    flips = []
    for s in range(segments):
        inside = segment_bits(s, segments)
        flips += [(s, _mask(inside), _signed(m), n) for m, n in ball(most, [b for b in range(64) if b not in inside])]
    around = rows.select("*", _rows(("of", "bits", "flip", "n"), flips).alias("p"))
    around = around.where((F.col("p.of") == F.col("segment")) & (F.col("p.n") <= radius))
    rest = F.col("fp").bitwiseAND(F.bitwise_not("p.bits")).bitwiseXOR(F.col("p.flip"))
    return around.select("segment", F.col("value").bitwiseOR(rest).alias("point"), "fp")


def _split_links(entered: DataFrame, asking: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """(a, b) within crowded values, by points around the other bits."""
    half = max_distance // 2
    entries = _points(entered, F.lit(half), half, segments)
    asks = _points(asking, max_distance - half - F.col("spent"), max_distance - half, segments)
    least = entries.groupBy("segment", "point").agg(F.min("fp").alias("a"))
    return asks.withColumnRenamed("fp", "b").join(least, ["segment", "point"]).select("a", "b")


def links(
    fps: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET
) -> DataFrame:
    """(a, b) fingerprints within ``max_distance``; enough of them to connect
    any two distinct ones that are that close. ``fps`` holds distinct values.

    Any ``segments`` of 2 or more and any ``bucket`` give the same components.
    """
    if segments < 2:
        raise ValueError("segments must be 2 or more")
    spark = fps.sparkSession
    # a number keeps Spark from merging these short rows, which grow below
    fps = cut_lineage(fps.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp"))
    at = ["segment", "value"]
    table, probes = _table(fps, max_distance, segments), _probes(fps, max_distance, segments)
    crowded = cut_lineage(table.groupBy(*at).count().where(F.col("count") > bucket).select(*at))
    few = table.join(crowded, at, "left_anti").withColumnRenamed("fp", "a")
    found = probes.withColumnRenamed("fp", "b").join(few, at)
    # within one value both sides ask
    found = found.where((F.col("spent") > 0) | (F.col("a") < F.col("b"))).select("a", "b")
    if not crowded.isEmpty():
        some = (rows.join(crowded, at, "left_semi") for rows in (table, probes))
        found = found.union(_split_links(*some, max_distance, segments))
    return found.where((F.col("a") != F.col("b")) & (distance(F.col("a"), F.col("b")) <= max_distance)).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """(doc_id, fp, digest, component_id, leader): the least doc_id reachable
    over links of at most ``max_distance`` bits, and whether the row is the one
    of its group to keep (least doc_id, then least digest).

    Copies share a fingerprint and are settled by one grouping. Repeated rows
    stay; of rows alike in id and text, each is a leader if one is. Null ids
    come last in their group; a group of only such rows has a null id. An
    empty table gives an empty one.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    own = rows.groupBy("fp").agg(F.min(first).alias("first"))
    joined = components(links(own.select("fp"), max_distance)).withColumnRenamed("node", "fp")
    own = own.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    group = own.groupBy("component").agg(F.min("first").alias("lead"))
    of = own.join(group, "component").select("fp", "lead")
    return rows.join(of, "fp").select(
        "doc_id",
        "fp",
        "digest",
        F.col("lead.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("digest") == F.col("lead.digest"))).alias("leader"),
    )


def keep_leaders(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One document of each group, with all its columns, whatever their names.

    The group's least doc_id stays, nulls last, then the least digest of the
    text; of rows alike in both, any one. Null and empty texts have the
    fingerprint zero and form a group; an empty table gives an empty one.
    """
    lead = (
        near_duplicates(docs, shingle=shingle, max_distance=max_distance)
        .where("leader")
        .select(F.col("doc_id").alias("lead_id"), "digest")
        .distinct()
    )
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs["doc_id"].cast("long").alias("id"),
        F.unhex(F.md5(as_bytes())).alias("text_digest"),
    )
    same = F.col("id").eqNullSafe(F.col("lead_id")) & (F.col("text_digest") == F.col("digest"))
    return rows.join(lead, same, "left_semi").dropDuplicates(["id", "text_digest"]).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal, component_id."""
    found = near_duplicates(docs)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
