"""Token ids as length-delimited binary records, with an offset index.

A file is a row of records, each one framed as

    length     8 bytes, little-endian: bytes of the payload
    checksum   4 bytes: masked CRC-32C of the length
    payload
    checksum   4 bytes: masked CRC-32C of the payload

(masked: rotated right by 15 bits, plus 0xa282ead8, modulo 2^32), which common
readers of training data know. A payload is the document's id (8 bytes,
signed), one byte that is 1 if the id is null, one byte with the width of a
token id (2 or 4), and the token ids, all little-endian.

Writing: documents are dealt out by ranges of their id, sorted, encoded and
written, one file per range, through the file system of the shared folder. The
rows that a task returns are its part of the index: file, offset, length,
number of ids and of ids before it. Only the index says which files count, and
Spark commits the index of one attempt per task, so a lost or repeated task
leaves at most a file that nothing names.

Reading: index rows name the records. In file order they are read in long
stretches; dealt out by a hash they give a shuffled read of single records.
Both check all checksums.
"""

from __future__ import annotations

import struct
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import fresh_dir
from .common import as_bytes, bounded_batches, word_lists
from .pretokens import ragged

#: Fixed values of the format.
MASK = 0xA282EAD8
POLYNOMIAL = 0x82F63B78
HEADER = "<qBB"
HEADER_BYTES = struct.calcsize(HEADER)
END_ID = 2
#: Bytes whose checksum is worked out alone; many at once, 8 bytes a step.
CHUNK = 512
#: Words whose ids a Python worker remembers.
REMEMBERED = 1_000_000
#: Words that are looked up together.
GROUP_WORDS = 200_000
STRETCH = 16 << 20
BATCH = 8 << 20

INDEX = "shard int, place long, doc_id long, file string, offset long, length long, n_tokens long, start_in_shard long"


@lru_cache(maxsize=1)
def _crc_tables():
    """Tables of 1 to 8 bytes ahead, and of CHUNK zero bytes after a state."""
    import numpy as np

    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    ahead = [table]
    for _ in range(7):
        ahead.append(table[ahead[-1] & 255] ^ (ahead[-1] >> 8))
    states = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).reshape(-1)
    for _ in range(CHUNK):
        states = table[states & 255] ^ (states >> 8)
    return ahead, states.reshape(4, 256).tolist()


def crc32c(parts: list[bytes]):
    """CRC-32C of every one of ``parts``, as numpy numbers.

    With its first four bytes inverted and zero bytes before it, a part has a
    checksum that is linear, so its chunks' checksums are found side by side
    and put together in order.
    """
    import numpy as np

    ahead, shift = _crc_tables()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    chunks = -(-np.maximum(sizes, 4) // CHUNK)
    ends = np.cumsum(chunks)
    flat = np.zeros(int(ends[-1]) * CHUNK if len(parts) else 0, np.uint8)
    for part, end, size in zip(parts, (ends * CHUNK).tolist(), sizes.tolist()):
        if size >= 4:
            flat[end - size : end] = np.frombuffer(part, np.uint8)
            flat[end - size : end - size + 4] ^= 255
    rows = flat.view("<u4").reshape(-1, CHUNK // 4)
    state = np.zeros(len(rows), np.uint32)
    for step in range(0, CHUNK // 4, 2):
        low, high = rows[:, step] ^ state, rows[:, step + 1]
        state = ahead[7][low & 255] ^ ahead[6][(low >> 8) & 255] ^ ahead[5][(low >> 16) & 255] ^ ahead[4][low >> 24]
        state = state ^ ahead[3][high & 255] ^ ahead[2][(high >> 8) & 255] ^ ahead[1][(high >> 16) & 255] ^ ahead[0][high >> 24]
    out, state, at = np.empty(len(parts), np.uint32), state.tolist(), 0
    a, b, c, d = shift
    table = ahead[0].tolist()
    for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
        if size < 4:
            crc = 0xFFFFFFFF
            for byte in parts[i]:
                crc = table[(crc ^ byte) & 255] ^ (crc >> 8)
        else:
            crc = state[at]
            for k in range(at + 1, end):
                crc = a[crc & 255] ^ b[(crc >> 8) & 255] ^ c[(crc >> 16) & 255] ^ d[crc >> 24] ^ state[k]
        out[i] = crc ^ 0xFFFFFFFF
        at = end
    return out


def masked(crc):
    """The checksum as it is stored (numpy numbers)."""
    import numpy as np

    crc = crc.astype(np.uint64)
    return ((((crc >> np.uint64(15)) | (crc << np.uint64(17))) + np.uint64(MASK)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def frames(payloads: list[bytes]) -> list[bytes]:
    """Payloads as records."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, bodies = masked(crc32c(lengths)), masked(crc32c(payloads))
    return [b"".join((n, h.tobytes(), p, b.tobytes())) for n, h, p, b in zip(lengths, heads, payloads, bodies)]


def unframed(records: list[bytes]) -> list[bytes]:
    """The payloads of records; ValueError if a length or checksum is wrong."""
    import numpy as np

    payloads = [r[12:-4] for r in records]
    for r, p in zip(records, payloads):
        if len(r) < 16 or struct.unpack_from("<Q", r)[0] != len(p):
            raise ValueError("a record is cut off or has another length than its index row says")
    heads = np.frombuffer(b"".join(r[8:12] for r in records), "<u4")
    bodies = np.frombuffer(b"".join(r[-4:] for r in records), "<u4")
    if (heads != masked(crc32c([r[:8] for r in records]))).any() or (bodies != masked(crc32c(payloads))).any():
        raise ValueError("a record's checksum is wrong")
    return payloads


def file_system(folder: str):
    """pyarrow's file system for a folder that Spark names, and the path there."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _library(content: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, Words(tokenizer) if drops_white_space(content) else None


class Words:
    """Token ids of words, for a tokenizer that drops white space: a text's
    ids are those of its words one after the other.

    Words of plain letters and marks go through the library many at once, with
    a space between them: their pieces are known without it, and each piece
    ends in a token that says so. All others are encoded one by one.
    """

    #: Lower and upper case stay letters and do not join what follows.
    LETTERS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
    MARKS = r"!-&(-/:-;=-@\[-`{}~"

    def __init__(self, tokenizer):
        import re

        import numpy as np

        self.tokenizer = tokenizer
        self.plain = re.compile(f"[{self.LETTERS}0-9{self.MARKS}]+").fullmatch
        self.pieces = re.compile(f"[{self.LETTERS}]+|[0-9]|[{self.MARKS}]+").findall
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, i in tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.clear()

    def clear(self):
        import numpy as np

        self.places: dict[bytes, int] = {}
        self.offsets = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.seen = np.zeros(0, np.int64)

    def forget(self):
        """Only words that came more than once stay; none if most did."""
        import numpy as np

        kept = np.flatnonzero(self.seen > 1)
        if 2 * len(kept) > REMEMBERED:
            return self.clear()
        words = list(self.places)
        sizes = np.diff(self.offsets)[kept]
        self.ids = self.ids[ragged(self.offsets[kept], sizes)]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.places = {words[i]: place for place, i in enumerate(kept.tolist())}
        self.seen = np.ones(len(kept), np.int64)

    def learn(self, words: list[bytes]) -> None:
        import numpy as np

        texts = [w.decode() for w in words]
        plain = [self.plain(t) is not None for t in texts]
        joined = [t for t, p in zip(texts, plain) if p]
        alone = [t for t, p in zip(texts, plain) if not p]
        coded = self.tokenizer.encode_batch_fast([" ".join(joined), *alone], add_special_tokens=False)
        ids = np.asarray(coded[0].ids, np.uint32)
        stops = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        pieces = np.fromiter((len(self.pieces(t)) for t in joined), np.int64, len(joined))
        if int(pieces.sum()) != len(stops) - 1 or stops[-1] != len(ids):
            raise AssertionError("pieces of plain words are not those of the library")
        cuts = stops[np.concatenate([[0], np.cumsum(pieces)])]
        others = [c.ids for c in coded[1:]]
        ordered = [w for w, p in zip(words, plain) if p] + [w for w, p in zip(words, plain) if not p]
        at = len(self.places)
        self.places.update(zip(ordered, range(at, at + len(ordered))))
        sizes = np.concatenate([np.diff(cuts), np.fromiter(map(len, others), np.int64, len(others))])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids, *[np.asarray(o, np.uint32) for o in others]])

    def encode(self, words: list[bytes]):
        """Ids of the words one after the other, and how many each one has."""
        import numpy as np

        known = self.places
        fresh = [w for w in set(words) if w not in known]
        if len(known) + len(fresh) > REMEMBERED:
            self.forget()
            known = self.places
            fresh = [w for w in set(words) if w not in known]
        if fresh:
            self.learn(fresh)
        place = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.seen = np.bincount(place, minlength=len(known)) + np.pad(self.seen, (0, len(known) - len(self.seen)))
        starts = self.offsets[place]
        sizes = self.offsets[place + 1] - starts
        return self.ids[ragged(starts, sizes)], sizes


def _ids_of(texts: list[bytes], tokenizer, words: Words | None):
    """Token ids of each text, without special tokens added; by words where
    the tokenizer allows it (``Words``)."""
    import numpy as np

    if words is None:
        coded = tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.asarray(c.ids, np.uint32) for c in coded]
    parts: list[list] = [[] for _ in texts]
    group, owners = [], []

    def flush():
        ids, sizes = words.encode(group)
        ends = np.cumsum(sizes)
        cuts = np.cumsum([n for _, n in owners])
        for (text, _), piece in zip(owners, np.split(ids, ends[cuts - 1][:-1])):
            parts[text].append(piece)
        group.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for piece in word_lists(text):
            if piece:
                group += piece
                owners.append((i, len(piece)))
            if len(group) >= GROUP_WORDS:
                flush()
    if group:
        flush()
    return [np.concatenate([np.zeros(0, np.uint32), *p]) for p in parts]


def drops_white_space(content: str) -> bool:
    """Whether a tokenizer file says that words may be encoded one by one:
    its pieces match an expression that no white space meets, every special
    token is free of white space and of rules about its surroundings, and no
    normaliser looks beyond white space."""
    import json

    spec = json.loads(content)
    split = spec["pre_tokenizer"] or {}
    first = (split.get("pretokenizers") or [split])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    alone = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    # fixed value: the expression of the word tokenizer
    words = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    norm = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = norm.get("normalizers", [norm])
    usual = all(s["type"] in ("NFC", "Lowercase") or s.get("pattern") == {"Regex": r"\s+"} for s in steps)
    tokens = all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].split() == [t["content"]]
        for t in spec["added_tokens"]
    )
    return alone and words and usual and tokens


def write(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    shards: int | None = None,
) -> DataFrame:
    """Write every row's ids and ``end_id`` below ``folder``, in ascending
    order of the id (nulls first); returns the stored index (``INDEX``).

    Null texts are empty: their record holds the end id alone. Ids have to be
    integers; they may be null or repeated, and rows with equal ids are in the
    order of a hash of their text. Other columns are not read. An empty table
    gives an empty index. Equal ids may fill several files, so one id may have
    any share of the rows. ``shards`` is the number of ranges, the session's
    shuffle partitions if not given: raise it with the input. A text has to
    fit one row (2 GB).
    """
    spark = docs.sparkSession
    bounded_batches(spark, BATCH)
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as file:
        content = file.read()
    held = spark.sparkContext.broadcast(content)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = as_bytes(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.rand(1).alias("deal"), text.alias("t")
    )
    order = ["doc_id", "h", "deal"]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "t")

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        tokenizer, words = _library(held.value)
        wide = max(tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        width = 4 if wide else 2
        kind, end = np.dtype(f"<u{width}"), np.asarray([end_id], np.uint32)
        shard = TaskContext.get().partitionId()
        name = f"ids-{shard:06d}-{uuid.uuid4().hex}.tfrecord"
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        file, offset, place, before = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file = file or system.open_output_stream(f"{path}/{name}")
            keys = batch.column(0).to_pylist()
            ids = [np.concatenate([i, end]) for i in _ids_of(batch.column(1).to_pylist(), tokenizer, words)]
            records = frames(
                [struct.pack(HEADER, k or 0, k is None, width) + i.astype(kind).tobytes() for k, i in zip(keys, ids)]
            )
            for record in records:
                file.write(record)
            sizes = np.asarray([len(r) for r in records], np.int64)
            counts = np.asarray([len(i) for i in ids], np.int64)
            offsets, starts = offset + np.cumsum(sizes) - sizes, before + np.cumsum(counts) - counts
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * n, pa.int32()),
                    pa.array(np.arange(place, place + n)),
                    batch.column(0),
                    pa.array([name] * n),
                    pa.array(offsets),
                    pa.array(sizes),
                    pa.array(counts),
                    pa.array(starts),
                ],
                ["shard", "place", "doc_id", "file", "offset", "length", "n_tokens", "start_in_shard"],
            )
            offset, before, place = offset + int(sizes.sum()), before + int(counts.sum()), place + n
        if file:
            file.close()

    dealt.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return index_of(spark, folder)


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    """The index that ``write`` has stored, and ``start``: the ids of all
    documents before. A shard is one row of the table this sums over."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return index.join(bases, "shard").withColumn("start", F.col("base") + F.col("start_in_shard")).drop("base")


def read(index: DataFrame, folder: str, shuffle_seed: int | None = None, digest: bool = False) -> DataFrame:
    """Records that ``index`` names: doc_id, start, n_tokens and ``tokens``,
    or with ``digest`` the unsigned crc32 of the ids as 32-bit numbers.

    All but ``start`` comes from the files. With ``shuffle_seed`` the rows are
    dealt out and read in the order of a hash of the seed and their place.
    """
    bounded_batches(index.sparkSession, BATCH)
    rows = index.select("file", "offset", "length", "start")
    if shuffle_seed is not None:
        mixed = rows.withColumn("h", F.xxhash64(F.lit(shuffle_seed), "file", "offset"))
        rows = mixed.repartition("h").sortWithinPartitions("h").drop("h")

    def stretches(rows):
        """Neighbouring records of a file, up to STRETCH bytes of them."""
        own = []
        for row in rows:
            if own and (
                row["file"] != own[-1]["file"]
                or row["offset"] != own[-1]["offset"] + own[-1]["length"]
                or row["offset"] + row["length"] - own[0]["offset"] > STRETCH
            ):
                yield own
                own = []
            own.append(row)
        if own:
            yield own

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        system, path = file_system(folder)
        name, file = None, None
        for batch in batches:
            for own in stretches(batch.to_pylist()):
                if own[0]["file"] != name:
                    if file:
                        file.close()
                    name = own[0]["file"]
                    file = system.open_input_file(f"{path}/{name}")
                first = own[0]["offset"]
                data = file.read_at(own[-1]["offset"] + own[-1]["length"] - first, first)
                payloads = unframed([data[r["offset"] - first : r["offset"] - first + r["length"]] for r in own])
                keys, ids = [], []
                for p in payloads:
                    key, null, width = struct.unpack_from(HEADER, p)
                    keys.append(None if null else key)
                    ids.append(np.frombuffer(p, f"<u{width}", offset=HEADER_BYTES).astype("<u4"))
                if digest:
                    last = pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(
                        pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array([r["start"] for r in own], pa.int64()),
                        pa.array([len(i) for i in ids], pa.int64()),
                        last,
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "tokens"],
                )
        if file:
            file.close()

    last = "ids_crc32 long" if digest else "tokens array<int>"
    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def report(docs: DataFrame) -> DataFrame:
    """Write all documents to the shared folder and read the files back."""
    folder = fresh_dir(docs.sparkSession, "records")
    return read(write(docs, folder), folder, digest=True)

