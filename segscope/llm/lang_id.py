"""Language ID (operator 8): compression with per-language dictionaries.

For each language a raw-content zstandard dictionary is cut from documents of
known language: one passage from each of at most ``SAMPLES`` documents (for each
of ``SAMPLES`` hash classes the document of least hash), up to
``DICTIONARY_BYTES`` in all. That bounded sample is the whole model.

A text is reduced to its lower-case letter words (runs of letters without spaces
are cut after ``WORD_CHARS``), cut into chunks of ``CHUNK_WORDS`` words, so that a
chunk stays within reach of the dictionary, and a word counts once per chunk, so that
repetition says nothing. Every chunk of the whole text is compressed with each dictionary; the
language with the smallest total wins. A fixed tail keeps short chunks
compressible, else they would be stored raw and tie. The margin is the share by
which the best beats the second; a text whose margin is below ``NARROW`` is
rejected: its language is not known.

Defined results: null texts and texts without a letter are ``und`` with score 0
and rejected; so is everything when there is nothing to learn from; ties go to
the first language in alphabetical order (and are rejected); rows are judged one
by one; a null id is never learned from; an empty table gives no rows; extra
columns stay with ``keep_known`` and are ignored elsewhere.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_slices

SAMPLES, DICTIONARY_BYTES, CHUNK_WORDS, WORD_CHARS = 256, 1 << 16, 400, 48
NARROW, SURE = 0.002, 0.1
_LETTERS = re.compile(r"[^\W\d_]{1,%d}" % WORD_CHARS)
_TAIL = b"\0" * 64


def chunks(text: str) -> list[bytes]:
    """Nothing for a text without a letter (the pattern also takes signs such as raised digits)."""
    words = _LETTERS.findall(text.lower()) if any(map(str.isalpha, text)) else []
    return [" ".join(dict.fromkeys(words[at:at + CHUNK_WORDS])).encode() for at in range(0, len(words), CHUNK_WORDS)]


def learn(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary, from the rows that are not held out."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).withColumn("h", F.xxhash64("doc_id", "lang"))
    chosen = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLES)).alias("c")).agg(F.min("h").alias("h"))
    hashes = [r["h"] for r in chosen.select("h").collect()]  # SAMPLES per language
    if not hashes:
        return {}

    @F.pandas_udf("string")
    def passage(texts, h):
        import pandas as pd
        out = []
        for t, x in zip(texts, h):
            parts = chunks(t or "")
            out.append(parts[x % len(parts)].decode() if parts else "")
        return pd.Series(out)

    # one passage per hash, also where an id is repeated over many texts
    found = rows.where(F.col("h").isin(hashes)).select("lang", "h", passage("text", "h").alias("p")).groupBy("lang", "h").agg(
        F.min("p").alias("p")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"], r["p"])):
        out[r["lang"]] = (out.get(r["lang"], b"") + r["p"].encode() + b" ")[:DICTIONARY_BYTES]
    return {k: v for k, v in out.items() if v.strip()}


@functools.lru_cache(maxsize=2)
def _compressors(model: tuple[tuple[str, bytes], ...]):
    import zstandard as z
    params = z.ZstdCompressionParameters(strategy=z.STRATEGY_GREEDY, min_match=4, search_log=4, window_log=17, hash_log=16, chain_log=16)
    out = []
    for name, content in model:
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append((name, z.ZstdCompressor(dict_data=d, compression_params=params)))
    return out


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) of a whole text; ``model`` is sorted by language."""
    parts = chunks(text or "")
    if not parts or not model:
        return "und", 0.0, 0.0, True
    sizes = sorted((sum(len(c.compress(p + _TAIL)) for p in parts), name) for name, c in _compressors(model))
    margin = 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], min(1.0, margin / SURE), margin, margin < NARROW


def keep_known(df: DataFrame, model: dict[str, bytes], text: str = "text") -> DataFrame:
    """The rows of ``df`` whose language is known, with its own columns."""
    known = tuple(sorted(model.items()))

    @F.pandas_udf("boolean")
    def is_known(texts):
        import pandas as pd
        return pd.Series([not classify(t, known)[3] for t in texts], dtype=bool)

    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("text"))
    return rows.where(is_known("text")).select("_row.*")


def predict_languages(df: DataFrame, model: dict[str, bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected; one row per input row."""
    known = tuple(sorted(model.items()))

    def run(batches):
        for batch in text_slices(batches, 1):
            got = [classify(t, known) for t in batch.column(1).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*got), kinds)]],
                                             ["doc_id", "lang_pred", "score", "margin", "rejected"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
