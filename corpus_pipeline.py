"""Corpus pipeline over ``documents``: language ID, near duplicates, PII, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and gets all that its predecessor kept, read
again from Parquet.  The last one returns token ids.

Defined cases, alike in every stage: an empty table gives an empty one; null and empty texts, having no
language, go in the first stage; rows with a null doc_id are kept as documents of their own by the duplicate
stage; rows that repeat a doc_id and text collapse to one there, unequal texts under one doc_id count as
versions of one document, of which one row stays; texts of any length are read whole; of equal
candidates the smallest doc_id stays; further columns, whatever their names, are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavelworks.llm import jaccard, langid, mixing, pii, unigram
from gavelworks.llm.common import Work

STAGES = [
    ("language_id", langid.stage),
    ("near_duplicates", jaccard.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", unigram.stage),
]
#: trained, iterative and Viterbi stages can't be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Work(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.save(docs, name)
    return docs
