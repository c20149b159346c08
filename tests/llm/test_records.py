"""Records, checksums, order and ids against the library itself."""

import random
import unicodedata
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lookalike.llm import records
from lookalike.sources.store import fresh_dir


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (records.POLYNOMIAL if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    r = random.Random(1)
    parts = [r.randbytes(n) for n in (0, 1, 3, 4, 5, 8, 12, 63, 64, 65, 511, 512, 513, 1024, 1500, 5000)]
    assert records.crc32c(parts).tolist() == [plain_crc32c(p) for p in parts]
    # known values of the polynomial
    assert records.crc32c([b"123456789", bytes(32)]).tolist() == [0xE3069283, 0x8A9136AA]
    assert records.crc32c([]).tolist() == []
    crc = np.asarray([0xE3069283], np.uint32)
    assert records.masked(crc).tolist() == [(((0xE3069283 >> 15) | (0xE3069283 << 17)) + records.MASK) & 0xFFFFFFFF]


def test_damage_is_noticed():
    whole = records.frames([b"abcdef", b""])
    assert records.unframed(whole) == [b"abcdef", b""]
    for place in range(len(whole[0])):
        bad = bytearray(whole[0])
        bad[place] ^= 4
        with pytest.raises(ValueError):
            records.unframed([bytes(bad)])
    with pytest.raises(ValueError):
        records.unframed([whole[0][:-1]])


def texts():
    r = random.Random(8)
    parts = ["the", " of", "'s", "'LL", "Don't", "  ", "\n\n ", "\t", " 12", "³¼Ⅷ", "ẞ", "ΣΑΣ", "日本語", "　x", "\x85a", "\xa0b", "🙂", "é", "é", "̈", "_", "!?", "<|", "<|endoftext|>", "<|startoftext|>", "|>", "\x00", "\x1f", "\x0b", "\x0c", "İ", "ﬁ", "A" * 30, " ", "​"]
    rows = [None, "", " ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "   x", "z" * 20_000, "word " * 30_000]
    return rows + ["".join(r.choice(parts) for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 40, 400) for _ in range(12)]


def frame(spark):
    rows = [(i % 60 - 20, t) for i, t in enumerate(texts())] + [(None, "no id"), (None, "no id"), (1, ""), (1, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "'q' AS t", "2 AS deal").repartition(5)


def test_files_hold_what_the_library_says(spark):
    df = frame(spark)
    library = Tokenizer.from_file(records.default_tokenizer())
    ids = {t: library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts() + ["no id"]}
    folder = fresh_dir(spark, "records")
    index = records.write(df, folder, shards=6)
    rows = sorted(records.read(index, folder).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys)
    want = sorted((str(r.doc_id), ids[r.text]) for r in df.collect())
    assert sorted((str(r.doc_id), r.tokens) for r in rows) == want
    shuffled = records.read(index, folder, shuffle_seed=3).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, rows))
    assert [r.start for r in shuffled] != sorted(r.start for r in shuffled)
    digests = records.read(index, folder, digest=True).collect()
    crc = {(r.start, r.doc_id): zlib.crc32(np.asarray(r.tokens, "<u4").tobytes()) for r in rows}
    assert {(r.start, r.doc_id): r.ids_crc32 for r in digests} == crc


def test_query_and_empty_table(spark):
    df = frame(spark)
    assert records.report(df).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert records.report(df.limit(0)).count() == 0


def test_files_that_no_index_row_names_do_not_count(spark):
    folder = fresh_dir(spark, "records")
    index = records.write(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), folder)
    system, path = records.file_system(folder)
    with system.open_output_stream(f"{path}/ids-000000-lost.tfrecord") as file:
        file.write(b"half a record")
    assert records.read(index, folder).count() == 2
    names = [r.file for r in index.collect()]
    with system.open_input_file(f"{path}/{names[0]}") as file:
        data = bytearray(file.read())
    data[-6] ^= 1
    with system.open_output_stream(f"{path}/{names[0]}") as file:
        file.write(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        records.read(index, folder).collect()


def test_words_alone_only_where_white_space_is_dropped():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        assert not records.drops_white_space(file.read())
    with open(records.default_tokenizer(), encoding="utf-8") as file:
        assert records.drops_white_space(file.read())


def test_every_code_point_as_the_library_has_it():
    tokenizer, words = records._library(open(records.default_tokenizer(), encoding="utf-8").read())
    chars = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = [f"x{c}'s,{c}Z {c}1{c}\u0331" for c in chars]
    got = records._ids_of([t.encode() for t in texts], tokenizer, words)
    want = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, g, w in zip(texts, got, want) if g.tolist() != w.ids] == []


def test_forgotten_words_are_learnt_again(monkeypatch):
    monkeypatch.setattr(records, "REMEMBERED", 5)
    monkeypatch.setattr(records, "GROUP_WORDS", 3)
    tokenizer, _ = records._library(open(records.default_tokenizer(), encoding="utf-8").read())
    words = records.Words(tokenizer)
    some = [t or "" for t in texts()]
    got = records._ids_of([t.encode() for t in some], tokenizer, words)
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_tokenizers_that_keep_white_space(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = fresh_dir(spark, "records")
    index = records.write(spark.createDataFrame([(1, "a  b\n c")], "doc_id long, text string"), folder, tokenizer_path=path)
    assert records.read(index, folder).first().tokens == Tokenizer.from_file(path).encode("a  b\n c", add_special_tokens=False).ids + [2]
