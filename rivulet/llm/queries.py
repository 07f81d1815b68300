"""Queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import bpe, chat, compression, ctw, jaccard, language, mixing, rules, tiff, warc
from rivulet.llm.common import table


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": jaccard.op1,
        "op2_ctw_score": ctw.op2,
        "op3_chat_format": chat.op3,
        "op4_warc_index": warc.op4,
        "op5_mix_sources": mixing.op5,
        "op6_quality_rules": rules.op6,
        "op7_tiff_pages": tiff.op7,
        "op8_language_id": language.op8,
        "op9_byte_bpe": op9,
        "op10_compression_quality": compression.op10,
        "op1_ngram_jaccard_links": jaccard.op1_links,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": jaccard.OP1_SQL, "op1_ngram_jaccard_links": jaccard.OP1_LINKS_SQL, "op3_chat_format": chat.OP3_SQL, "op4_warc_index": warc.OP4_SQL, "op5_mix_sources": mixing.OP5_SQL, "op6_quality_rules": rules.OP6_SQL}
