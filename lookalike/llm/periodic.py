"""Runs: stretches of words that repeat with a period, by tiles per octave.

A run of period q has at least ``exponent`` times q words, and words q apart
are the same in it. Octave k has the periods from 2^k to 2^(k+1) - 1; with
S = 2^(k+1), its *boundaries* are the word numbers divisible by S.

1. Inside a run every word after the first period has occurred at most q words
   before. Where too few words in a row have occurred so recently, no run of
   the octave can be. The other stretches are exploded into tiles: some
   boundaries, with the S words before and the 2S words after them, so that
   neighbouring tiles overlap.
2. Tiles are dealt out and solved alone. At each boundary Z-functions give, for
   every shift q, how far words q apart agree to the right and to the left. A
   run of the octave has a boundary in it. What reaches the next boundary is a
   fragment. One whose words repeat with a divisor of q is dropped: if two
   periods' worth of words do so, the whole run does.
3. Fragments go to their document and period, and those that touch become one
   run there. Only documents with tiles have their words read a second time.

A tile's work grows with its words, whatever they are, and a document has as
many tiles as its length asks for, so a long document is spread over tasks.
The first step is stored in the shared folder, so the ways from there agree
whatever is lost. A document, its words and its list of runs have to fit one
row (2 GB); a longer one fails with Spark's error for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import fresh_dir
from .common import as_bytes, bounded_batches, word_lists

EXPONENT = 4
LEAST_WORDS = 6
#: Words between a tile's first and last boundary; longer where S is longer.
CORE = 1024
#: Up to this S a tile's boundaries are solved together, one shift at a time.
TOGETHER = 64
BATCH = 8 << 20
#: Words of tiles that a task gets, and the most tasks to deal them to.
TASK_WORDS = 1 << 20
MOST_TASKS = 20_000

_TILES = "array<struct<octave:int,first:bigint,last:bigint,low:bigint,high:bigint>>"


def _recent(ids):
    """How many words ago each word occurred; a large number if never."""
    import numpy as np

    back = np.full(len(ids), np.iinfo(np.int64).max)
    small = ids.astype(np.uint16) if len(ids) and int(ids.max()) < 65536 else ids
    order = np.argsort(small, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    return back


def tiles_of(ids, exponent: int = EXPONENT, least: int = LEAST_WORDS, core: int = CORE) -> list[dict]:
    """Tiles of one document, whose words are given as numbers: octave, first
    and last boundary, and the words [low, high) that the tile needs."""
    import numpy as np

    n, found, octave = len(ids), [], 0
    if n < least:
        return found
    back = _recent(ids)
    while exponent << octave <= n:
        s = 2 << octave
        near = np.zeros(n + 2, np.int8)
        near[1:-1] = back < s
        edges = np.flatnonzero(np.diff(near))
        starts, ends = edges[::2], edges[1::2]
        # a run has this many words after its first period
        need = max((exponent - 1) << octave, least - s + 1)
        long = ends - starts >= need
        reached = -1
        for u, v in zip(starts[long].tolist(), ends[long].tolist()):
            first = max(0, (u - s) // s, reached + 1)
            last = reached = (v - 1) // s
            step = max(1, core // s)
            for a in range(first, last + 1, step):
                b = min(last, a + step - 1)
                found.append(
                    {"octave": octave, "first": a * s, "last": b * s, "low": max(0, (a - 1) * s), "high": min(n, (b + 2) * s)}
                )
        octave += 1
    return found


def _z(x: list) -> list:
    """Length of the longest common start of ``x`` and each of its tails."""
    n, left, right = len(x), 0, 0
    z = [0] * n
    z[0] = n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _reach_by_boundary(words, at, s: int):
    """(left, right) per boundary and shift 0..s-1: how many words before, and
    from, the boundary equal those a shift further on."""
    import numpy as np

    left, right = np.zeros((len(at), s), np.int64), np.zeros((len(at), s), np.int64)
    for row, c in enumerate(at.tolist()):
        after = words[c : c + 2 * s].tolist()
        z = _z(after)[:s] if after else []
        right[row, 1 : len(z)] = z[1:]
        before = words[max(0, c - s) : c][::-1].tolist()
        end = min(len(words), c + s)
        if before and end > c:
            back = words[max(0, c - s) : end][::-1].tolist()
            z = _z([*before, -1, *back])[len(before) + 1 :]
            # the tail of ``back`` that starts with word c + q - 1
            shifts = np.arange(1, min(s, end - c + 1))
            left[row, shifts] = np.asarray(z)[end - c - shifts]
    return left, right


def _reach_by_shift(words, at, s: int):
    """The same, for all boundaries of a tile at once."""
    import numpy as np

    left, right = np.zeros((len(at), s), np.int64), np.zeros((len(at), s), np.int64)
    for q in range(1, min(s, len(words))):
        stop = len(words) - q
        breaks = np.concatenate([[-1], np.flatnonzero(words[:stop] != words[q:]), [stop]])
        inside = np.minimum(at, stop)
        place = np.searchsorted(breaks, inside)
        right[:, q] = breaks[place] - inside
        left[:, q] = np.where(at <= stop, inside - 1 - breaks[place - 1], 0)
    return left, right


def solve_tile(words, low: int, octave: int, first: int, last: int, exponent: int = EXPONENT, together: int = TOGETHER):
    """Fragments (period, a, b): words i and i + period agree for a <= i < b.

    Given are a tile's words from number ``low`` on. A fragment is a whole
    run's, or it reaches an end of the tile.
    """
    import numpy as np

    s = 2 << octave
    at = np.arange(first, last + 1, s) - low
    left, right = (_reach_by_shift if s <= together else _reach_by_boundary)(words, at, s)
    shifts = np.arange(s)
    short_l, short_r = np.minimum(left, s), np.minimum(right, s)
    whole = short_l + short_r >= (exponent - 1) * shifts
    keep = (short_r > 0) & (whole | (short_l == s) | (short_r == s)) & (shifts >= s // 2)
    spans: dict[int, list] = {}
    for row in np.flatnonzero(keep.any(axis=1)).tolist():
        q = np.flatnonzero(keep[row])
        l, r, all_l, all_r = short_l[row], short_r[row], left[row], right[row]
        # shifts that repeat at least as far as any q of this octave must
        for g in np.flatnonzero((all_l + all_r >= s) & (shifts > 0) & (shifts <= s // 2)).tolist():
            finer = (q % g == 0) & (q > g) & (all_l[g] >= l[q]) & (all_r[g] >= r[q] + q - g)
            q = q[~finer]
            if not len(q):
                break
        c = int(at[row]) + low
        for period, a, b in zip(q.tolist(), (c - l[q]).tolist(), (c + r[q]).tolist()):
            seen = spans.setdefault(period, [])
            if seen and a <= seen[-1][1]:
                seen[-1][0], seen[-1][1] = min(a, seen[-1][0]), max(b, seen[-1][1])
            else:
                seen.append([a, b])
    return [
        (period, a, b)
        for period, seen in spans.items()
        for a, b in seen
        if b - a >= (exponent - 1) * period or a <= first - s or b >= last + s
    ]


def _numbered(data: bytes):
    """Distinct words, and the words of a text as numbers of these."""
    import numpy as np

    table: dict[bytes, int] = {}
    parts = [
        np.fromiter((table.setdefault(w, len(table)) for w in words), np.int32, len(words)) for words in word_lists(data)
    ]
    return list(table), np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _prepared(docs: DataFrame, id_col, text_col, seed: Column | None, rewrite, keep_text: bool, exponent, least):
    """Stored rows, one per document: uid, doc_id, n_words, digest of the words
    (no tiles), the words joined and as numbers (tiles), and the tiles."""
    spark = docs.sparkSession
    bounded_batches(spark, BATCH)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tile_type = pa.list_(
            pa.struct([("octave", pa.int32()), *((c, pa.int64()) for c in ("first", "last", "low", "high"))])
        )
        for number, batch in enumerate(batches):
            counts, plain, joined, numbers, tiles = [], [], [], [], []
            for text, seeded in zip(batch.column(1), batch.column(2).to_pylist()):
                vocabulary, ids = _numbered(text.as_py())
                if rewrite is not None and seeded is not None and len(ids):
                    places = rewrite(len(ids), seeded)
                    ids = ids if places is None else ids[places]
                own = tiles_of(ids, exponent, least)
                words = b" ".join([vocabulary[i] for i in ids.tolist()])
                counts.append(len(ids))
                plain.append(None if own else hashlib.sha256(words).hexdigest())
                joined.append(words if own or keep_text else None)
                numbers.append(ids.astype("<i4").tobytes() if own else None)
                tiles.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{number}-{i}" for i in range(batch.num_rows)]),
                    batch.column(0),
                    pa.array(np.asarray(counts, np.int64)),
                    pa.array(plain, pa.string()),
                    pa.array(joined, pa.large_binary()).cast(pa.binary()),
                    pa.array(numbers, pa.binary()),
                    pa.array(tiles, tile_type),
                ],
                ["uid", "doc_id", "n_words", "plain", "words", "numbers", "tiles"],
            )

    given = docs.select(
        F.col(id_col).alias("doc_id"),
        as_bytes(text_col).alias("t"),
        (F.lit(None) if seed is None else seed).cast("long").alias("seed"),
    )
    schema = f"uid string, doc_id {kind}, n_words long, plain string, words binary, numbers binary, tiles {_TILES}"
    path = fresh_dir(spark, "periodic")
    given.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _fragments(prepared: DataFrame, exponent: int) -> DataFrame:
    """(uid, period, a, b): every tile is a row of its own, dealt out evenly."""
    size = F.aggregate("tiles", F.lit(0).cast("long"), lambda total, t: total + t["high"] - t["low"])
    words = prepared.agg(F.sum(size)).first()[0] or 0
    tasks = min(words // TASK_WORDS + 1, MOST_TASKS)
    tile = F.explode("tiles").alias("tile")
    width = ((F.col("tile.high") - F.col("tile.low")) * 4).cast("int")
    tiles = (
        prepared.where("plain IS NULL")
        .select("uid", "numbers", tile)
        .select("uid", "tile.*", F.substring("numbers", (F.col("tile.low") * 4 + 1).cast("int"), width).alias("words"))
        .repartition(tasks, "uid", "octave", "first")
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            uids, rows = [], []
            for r in batch.to_pylist():
                words = np.frombuffer(r["words"], "<i4")
                got = solve_tile(words, r["low"], r["octave"], r["first"], r["last"], exponent)
                uids += [r["uid"]] * len(got)
                rows += got
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids, pa.string()), *[pa.array(c, pa.int64()) for c in columns]], ["uid", "period", "a", "b"]
            )

    return tiles.mapInArrow(run, "uid string, period long, a long, b long")


def _stitched(fragments: DataFrame, exponent: int, least: int) -> DataFrame:
    """(uid, runs): fragments of a document and period that touch are one run."""
    per = Window.partitionBy("uid", "period").orderBy("a", "b")
    before = F.max("b").over(per.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("_new", F.coalesce((F.col("a") > before).cast("int"), F.lit(1)))
    islands = marked.withColumn("_island", F.sum("_new").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("uid", "period", "_island").agg(F.min("a").alias("start"), F.max("b").alias("b"))
    runs = runs.withColumn("length", F.col("b") + F.col("period") - F.col("start"))
    runs = runs.where(F.col("length") >= F.greatest(F.lit(least), F.col("period") * exponent))
    # at most as many as the document has words
    return runs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def _without_repeats(words: bytes, runs) -> bytes:
    """The words no run contains after its first period, joined by a space."""
    import numpy as np

    parts = words.split(b" ")
    change = np.zeros(len(parts) + 1, np.int32)
    for run in runs:
        change[run["start"] + run["period"]] += 1
        change[run["start"] + run["length"]] -= 1
    keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([parts[i] for i in keep.tolist()])


def _collapsed(docs, id_col, text_col, seed, rewrite, keep_text, exponent, least) -> DataFrame:
    """doc_id, n_words, runs, collapsed (null if not kept), collapsed_sha256."""
    prepared = _prepared(docs, id_col, text_col, seed, rewrite, keep_text, exponent, least)
    runs = _stitched(_fragments(prepared, exponent), exponent, least)
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    plain = prepared.where("plain IS NOT NULL").select(
        "doc_id", "n_words", none.alias("runs"), F.col("words").alias("collapsed"), F.col("plain").alias("collapsed_sha256")
    )
    names, schema = plain.columns, plain.schema
    tiled = prepared.where("plain IS NULL").select("uid", "doc_id", "n_words", "words").join(runs, "uid", "left")
    tiled = tiled.select("doc_id", "n_words", F.coalesce("runs", none).alias("runs"), "words")

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            texts = [_without_repeats(w.as_py(), r.as_py()) for w, r in zip(batch.column(3), batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(texts if keep_text else [None] * len(texts), pa.binary()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ],
                names,
            )

    return plain.unionByName(tiled.mapInArrow(run, schema))


def collapse(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    exponent: int = EXPONENT,
    least: int = LEAST_WORDS,
) -> DataFrame:
    """(doc_id, n_words, runs, text): a row per row of ``docs``. ``runs`` holds
    (start, period, length) by start, then period; ``text`` has the words that
    no run contains after its first period, joined by one space.

    Null and empty texts have no words, no runs and an empty text. Ids may be
    null or repeated; equal rows stay apart. Other columns are not read, so
    their names do not matter. An empty table gives an empty one.
    """
    if exponent < 3:
        raise ValueError("an octave's boundaries meet every run from exponent 3 on only")
    rows = _collapsed(docs, id_col, text_col, None, None, True, exponent, least)
    return rows.select("doc_id", "n_words", "runs", F.decode("collapsed", "utf-8").alias("text"))


def repeated_tail(n: int, seed: int):
    """Places of the words after planting: for one seed in ten, the words from
    some place on repeat with a period; None where nothing is planted."""
    import numpy as np

    if seed % 10:
        return None
    g = seed // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % period])


def report(docs: DataFrame) -> DataFrame:
    """Runs of every document with planted periods, longest run and digests.

    Nothing is planted where the id is null.
    """
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = _collapsed(docs, "doc_id", "text", seed, repeated_tail, False, EXPONENT, LEAST_WORDS)
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(ranked)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    listed = F.array_join(F.transform("runs", line), "")
    return rows.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.s").alias("start"),
        (-F.col("_best.l")).alias("length"),
        F.col("_best.p").alias("period"),
        F.floor(F.lit(1000) * -F.col("_best.l") / F.col("_best.p")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
