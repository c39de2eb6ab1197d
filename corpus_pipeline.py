"""The corpus pipeline: stages over documents, each written as Parquet and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm._common import stored, table
from gridloom.llm.mixing import stage_mixing
from gridloom.llm.paragraphs import stage_substring
from gridloom.llm.quality import stage_quality
from gridloom.llm.simhash import stage_near_dedup
from gridloom.llm.unigram import stage_encode

STAGES = [
    ("quality rules", stage_quality),
    ("SimHash near-dedup", stage_near_dedup),
    ("substring dedup", stage_substring),
    ("mixing sources to target weights", stage_mixing),
    ("SentencePiece encoding and decoding", stage_encode),
]
#: SimHash and the Viterbi paths can't be put in SQL. Tests hold the SimHash stage against all pairs, op4 against all
#: runs of 50 words, and run() against these: survivors, no repeated run of 50 words, texts given back by decoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
