"""A training corpus from documents: quality rules, language, near copies, mix, tokens.

Each stage takes all that the one before it kept. The stages but the last return the
columns of documents; the last returns a row for each document of the mix with its token
ids (binary: little-endian unsigned 32-bit integers) and whether they decode to its text.

In every stage: an empty table gives an empty one; repeated rows are rows of their own
(of near copies one stays); other columns are carried along, whatever their names; texts
are read whole, however long. What a stage makes of nulls stands with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import bpe, jaccard, language, mixing, rules
from rivulet.llm.common import materialise, release, table, written

RANKS = "byte_bpe_50k.tiktoken"


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with names of its own for all columns, so that none is one of an operator's, and what each is called."""
    names = {c: f"in{i}__" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; with a null lang the base rules alone judge."""
    x, name = _apart(docs)
    judged = rules.quality_rules(x, name["text"], name["lang"], x.columns)
    return judged.where("kept").select(x.columns).toDF(*docs.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with the usual cross-entropy; the models learn from all labelled ones. Texts without a letter go; without any label all do, as no language is known."""
    x, name = _apart(docs)
    model = language.fit(x, name["doc_id"], name["text"], name["lang"])
    return language.identify(x, name["text"], model).where(~F.col("rejected")).select(x.columns).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; ties between repeated or null ids are broken by place. Texts without words all stay."""
    x, name = _apart(docs)
    return jaccard.one_of_each(x, name["doc_id"], name["text"]).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; null is a source of its own. Texts without words are in no target and taken as often as others of their source."""
    x, name = _apart(docs)
    return mixing.mixed(x, name["doc_id"], name["text"], name["source"]).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, and round_trip: the ids decode to the text. A null or empty text has no ids."""
    out = bpe.encode(docs, "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decode=True)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", same.alias("round_trip"))


STAGES = [("quality rules", quality), ("language ID", languages), ("near copies", near_copies), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has read and written on its way is deleted once its result stands."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, mark, written() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
