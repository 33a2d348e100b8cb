"""Byte-level BPE against the library on whole texts."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from segscope.llm import byte_bpe
from segscope.llm.queries import op11_byte_bpe, tokenizer_path

RANKS, PATTERN = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["a", "B", " ", "  ", "\n", "\t", "'s", "'re", "'", "1", "23", "é", "é", ".", "!?", " ", "\x1c", "\0", "ß", "日本", "。",
       "<|endoftext|>", "\r\n", "\x85", "🎉", " \n", "word", " word", "²", "_", "\U00020000"]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(RANKS, PATTERN)


def whole(codec, text):
    return np.array(codec.library.encode_ordinary(text), "<u4").tobytes()


def test_cut_texts_give_the_ids_of_the_whole_text(codec, monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(byte_bpe, "PIECE_CHARS", 4)
    for _ in range(3000):
        text = "".join(rnd.choices(ODD, k=rnd.randrange(40)))
        assert "".join(p for p, _ in byte_bpe.pieces(text)) == text
        assert codec.encode(text) == whole(codec, text)
        assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("white", [" ", "\n", "\t \n", " ", "　 "])
@pytest.mark.parametrize("after", ["", "x", ".", " x", "\x1c"])
def test_runs_of_white_space_are_matches_of_their_own(codec, monkeypatch, white, after):
    monkeypatch.setattr(byte_bpe, "PIECE_CHARS", 100)
    text = "one two." + white * 1500 + after + ("and more " * 30 if after else "")
    assert sum(single for _, single in byte_bpe.pieces(text)) == 1
    assert codec.encode(text) == whole(codec, text)


def test_very_long_texts(codec):
    for text in ("word " * 400_000, "日本語" * 300_000, "ab" * 500_000, "x" + " " * 2_000_000 + "y", "\n" * 1_500_000, "#$%" * 300_000):
        ids = codec.encode(text)
        assert codec.decode(ids) == text.encode()
    text = " ".join(random.Random(5).choices(["alpha", "βeta", "12", "it's", "。", "\n\n"], k=200_000))
    assert codec.encode(text) == whole(codec, text)


def test_a_cut_inside_a_character_decodes_to_its_bytes(codec):
    ids = codec.encode("\U00020000")
    assert len(ids) > 4 and codec.decode(ids[:4]) + codec.decode(ids[4:]) == "\U00020000".encode()


def test_rows(spark):
    rows = [(1, "Hello  world"), (None, "no id"), (2, None), (3, ""), (1, "Hello  world"), (4, "日本 <|endoftext|>")]
    df = spark.createDataFrame([(d, t, "clash", b"") for d, t in rows], "doc_id long, text string, bytes string, ids binary")
    own = byte_bpe.codec(RANKS, PATTERN)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((d, whole(own, t or ""), (t or "").encode()) for d, t in rows), key=key)
    got = byte_bpe.round_trip(df, RANKS, PATTERN)
    assert sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["bytes"])) for r in got.collect()), key=key) == want
    apart = byte_bpe.decode_ids(byte_bpe.encode_texts(df, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(bytes(r["bytes"]) for r in apart.collect()) == sorted(w[2] for w in want)
    assert byte_bpe.round_trip(df.limit(0), RANKS, PATTERN).collect() == []


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    own = byte_bpe.codec(RANKS, PATTERN)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = whole(own, r["text"] or "")
        want[r["doc_id"]] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op11_byte_bpe(spark, sf).collect()}
    assert got == want
