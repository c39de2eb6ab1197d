"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from gridloom.llm import htmltrees, imatch, mixing, paragraphs, quality, simhash, tokenbin, tokencount, toxicity, unigram

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_simhash": simhash.op2_simhash,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_substring": paragraphs.op4_substring,
    "op5_tokenbin": tokenbin.op5_tokenbin,
    "op6_sentencepiece": unigram.op6_sentencepiece,
    "op7_quality": quality.op7_quality,
    "op8_imatch": imatch.op8_imatch,
    "op9_tokencount": tokencount.op9_tokencount,
    "op10_html": htmltrees.op10_html,
}
ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op7_quality": quality.ORACLE,
    "op8_imatch": imatch.ORACLE,
}
