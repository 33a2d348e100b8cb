"""Encoding, binary records and packing against the tokenizers library."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from segscope.llm import binary_output, packing
from segscope.llm.common import shared_path
from segscope.llm.queries import tokenizer_path
from segscope.llm.tokens import Encoder

ODD = ["a", "B", " ", "  ", "\n", "\t", "'s", "'re", "1", "23", "é", "é", ".", "!?", " ", "\x1c", "\0", "\1", "ß", "Σ", "İ", "日本",
       "<|endoftext|>", "\r\n", "\x85", "🎉", " \n", "word", " word",
       " Été,", " straße!?", "\nÀÇÞÿ..", "\nPlain", " ÖL;", " o\u0308l", "µ", " Ÿ", "×", " don't,", "...", "\u0301"]


def ids_of(name, text):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name,drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_chunks_give_the_ids_of_the_whole_text(name, drops, monkeypatch):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(ODD, k=rnd.randrange(25))) for _ in range(1500)] + ["", " ", "\n", " a", "a ", "\0a", "x" * 300]
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for entries, rows in ((1_000_000, 2000), (3, 7), (100, 50)):  # with a cache, and with generations that are full at once
        monkeypatch.setattr("segscope.llm.tokens.GENERATION", entries)
        encoder = Encoder(tokenizer_path(name), drops)
        got = [b for at in range(0, len(texts), rows) for b in encoder.encode(texts[at:at + rows])]
        assert [np.frombuffer(b, "<u2").tolist() for b in got] == want
        assert entries > 100 or len(encoder.words.young) <= entries and len(encoder.words.old) > 0


@pytest.mark.parametrize("name,drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_every_plain_letter_and_mark(name, drops):
    """Words of the letters that go to the model itself, after a space and after a line break."""
    rnd = random.Random(8)
    letters, marks = [chr(c) for c in range(256) if chr(c).isalpha()], [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    words = ["".join(rnd.choices(letters, k=rnd.randrange(1, 12))) + "".join(rnd.choices(marks, k=rnd.randrange(5))) for _ in range(4000)]
    texts = [a + w for w in words + letters for a in ("x ", "x\n", "")]
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u2").tolist() for b in Encoder(tokenizer_path(name), drops).encode(texts)] == want


def test_frequent_chunks_stay_while_new_ones_pass(monkeypatch):
    monkeypatch.setattr("segscope.llm.tokens.GENERATION", 50)
    encoder, asked = Encoder(tokenizer_path("word_bpe_49k.json"), True), []
    real = encoder._chunks
    encoder._chunks = lambda keys: asked.extend(keys) or real(keys)
    for i in range(200):
        encoder.encode([f"often used q{i} r{i}x"])
    assert asked.count("often") == 1 and len(asked) == 2 + 400


ROWS = [(5, "Hello world"), (None, "no id"), (3, None), (4, ""), (5, "again 5"), (2, "x " * 3000), (9, "Hello world"), (5, "Hello world")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, "clash", b"") for d, t in rows], "doc_id long, text string, start string, ids binary").repartition(3)


def test_records_round_trip(spark):
    path = shared_path(spark, "test-records")
    binary_output.write_records(frame(spark), path, tokenizer_path("word_bpe_49k.json"), 2, shards=3, records_per_file=2)
    index = binary_output.read_index(spark, path)
    rows = index.join(binary_output.file_starts(index), "file").orderBy("file_no", "part_no", "offset").collect()
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in rows] == [d for d, _ in want]
    before = 0
    contents = {r["path"]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()}
    for r, (d, t) in zip(rows, want):
        ids = np.array(ids_of("word_bpe_49k.json", t or "") + [2], "<u4")
        assert (r["n_tokens"], r["ids_crc32"], r["file_start"] + r["start_in_file"]) == (len(ids), zlib.crc32(ids.tobytes()), before)
        got = binary_output.read_record(contents[r["file"]], r["offset"])  # a shuffled read by the index
        assert got[0] == d and got[1].tolist() == ids.tolist()
        before += len(ids)
    broken = bytearray(next(iter(contents.values())))
    broken[20] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(binary_output.frames(bytes(broken)))


def test_records_of_an_empty_table(spark):
    path = shared_path(spark, "test-records")
    binary_output.write_records(frame(spark).limit(0), path, tokenizer_path("word_bpe_49k.json"), 2)
    assert binary_output.read_index(spark, path).collect() == []


@pytest.mark.parametrize("max_len", [1024, 8])
def test_packing_keeps_every_id_once(spark, max_len):
    out = packing.pack_documents(frame(spark), tokenizer=tokenizer_path("byte_bpe_50k.json"), end_id=0, max_len=max_len)
    rows = out.withColumnRenamed("ids_crc32", "crc").collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= max_len for r in rows)
    want = {}
    for d, t in ROWS:
        ids = ids_of("byte_bpe_50k.json", t or "") + [0]
        for at, n in packing.cuts(len(ids), max_len):
            key = (d, at, n, len(ids), zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["crc"])
        got[key] = got.get(key, 0) + 1
    assert got == want
    empty = packing.pack_documents(frame(spark).limit(0), tokenizer=tokenizer_path("byte_bpe_50k.json"), end_id=0)
    assert empty.collect() == []


def test_cuts_cover_every_length():
    for n in range(1, 200):
        cuts = packing.cuts(n, 16)
        assert [c[0] for c in cuts] == [sum(c[1] for c in cuts[:i]) for i in range(len(cuts))] and sum(c[1] for c in cuts) == n
        assert sum(c[1] < 16 for c in cuts) == bin(n % 16).count("1")
