"""From raw documents to a mixed corpus: the stages of ``tidewatch.llm`` one after the other.

Every stage works on all rows the one before kept and reads them from Parquet. All but the last
return the columns of ``documents``; the last returns the mix, a row per piece of a document, with
``shard`` and ``copy`` beside them. Nulls, empty texts and repeated rows are treated as the
operators say; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, exact_dedup, lang_id, mixing, near_dup
from tidewatch.llm.tables import table
from tidewatch.plans.staging import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; ``und`` goes (null, or no letter)."""
    model = lang_id.fit(docs.where(~lang_id.held_out("doc_id", 4, 2)))
    found = lang_id.predict(docs, model)
    return found.where(F.col("lang_pred") != lang_id.UNKNOWN).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text, that with the largest doc_id."""
    return exact_dedup.deduplicate(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near duplicates, that with the smallest doc_id; similarity 0.8."""
    return near_dup.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``, verbatim or with other numbers and names."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources to their target weights, dealt to shards."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", benchmark),
    ("source_mix", mixture),
]
#: SQL has neither the language model, nor the near-duplicate signatures, nor the drawing of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
