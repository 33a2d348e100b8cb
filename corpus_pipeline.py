"""The corpus pipeline: language ID, quality rules, near duplicates, benchmark
decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes what a stage returns as Parquet in the shared folder and
gives the next stage the files read again. All stages but the last return rows
of ``documents`` with all their columns.

1. language_id: documents whose language stays unknown go (no letters, or no
   dictionary compresses them better than another).
2. quality_rules: documents that fail the base rules or the likelihood ratio go.
3. ngram_jaccard: of each group of near duplicates (5-word shingles, Jaccard
   0.8) the document with the smallest id stays.
4. decontamination: documents that hold a benchmark passage go.
5. packing: every document as sequences of a power of two of ids; returns
   doc_id, start, length, doc_tokens, width, ids, ids_crc32, sequence_id, offset.

Nulls, empty texts, repeated rows, empty tables and extra columns: as the
operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segscope.llm import decontaminate, lang_id, ngram_join, packing, quality_rules
from segscope.llm.common import saved, table
from segscope.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.keep_known(docs, lang_id.learn(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.judge(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer=tokenizer_path("byte_bpe_50k.json"), end_id=0, max_len=1024)


STAGES = [("language_id", language_id), ("quality_rules", quality), ("ngram_jaccard", near_duplicates),
          ("decontamination", decontamination), ("packing", pack)]
#: Compression, hashed n-grams and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
