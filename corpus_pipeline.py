"""Corpus pipeline: STAGES applied to ``documents`` one after the other.

Quality rules, exact dedup, near dedup (the document with the least id of each class stays), mixing of sources, which
repeats the documents of small sources up to twice, leaves none out and returns them in the mixture's order, and best-fit
packing. All stages but the last return the columns of their input, whatever these are called.

Edge cases: a null text is empty and fails the quality rules, as texts of fewer than ten words do; nulls in other columns
pass through. Rows are told apart by numbers of their own, so of rows that repeat an id, or have none, each is judged by
its text: equal and nearly equal ones are copies of each other, different ones all stay. Of copies the longest, then the
one with the least id (exact), or the one with the least id (near) stays, a null id being the last; of those that are
alike in that too, the one that is read first. An empty table gives empty results in every stage. Very long texts are
judged whole and cut into pieces by the packing alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from spanforge.llm.common import table, written
from spanforge.llm.queries import word_tokenizer
from spanforge.plans.storage import drop_written, written_so_far


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, quality_rules.trusted_documents(table(spark, sf_dir, "labels")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.Mixture(docs).realised()


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs, word_tokenizer())


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("mixing", mix_sources),
    ("best-fit packing", pack),
]

#: The log-likelihood verdict, the similarity of near copies and the tokenizer have no SQL form; tests/llm compares the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written, and what it wrote on the way, and the result before it, removed."""
    docs, mark = table(spark, sf_dir, "documents"), written_so_far()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        drop_written(spark, mark, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
