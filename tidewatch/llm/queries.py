"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    chat,
    decontaminate,
    exact_dedup,
    extract,
    lang_id,
    licenses,
    lm,
    merkle,
    mixing,
    near_dup,
    ranking,
    sharding,
    warc,
)
from tidewatch.llm.tables import table
from tidewatch.plans.staging import staged
from tidewatch.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINKED = near_dup.NearParams(percent=85)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_near_duplicates(spark, folder):
    return near_dup.near_duplicates(table(spark, folder, "documents"), LINKED)


@query
def op1_exact_dedup(spark, folder):
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"), keep="largest")


@query
def op8_mix_sources(spark, folder):
    """The small columns are written first: the texts are read once, the sizes twice."""
    rows = staged(mixing.measured(table(spark, folder, "documents"), ["doc_id"]), "sizes")
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_language_id(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", lang_id.held_out("doc_id", 4, 2))
    model = lang_id.fit(docs.where("not held_out"))
    return lang_id.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query
def op5_benchmark_leaks(spark, folder):
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op9_lm_scores(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", lang_id.held_out("doc_id", 7, 2))
    return lm.fit_and_score(docs.select("doc_id", "held_out", "text"), ~F.col("held_out"))


@query
def op7_license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query
def op3_warc_archives(spark, folder):
    path = shared_folder(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.page_table(warc.read_archives(spark, path, payloads=False))


@query
def op2_chat_format(spark, folder):
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, folder, "conversations")
    # One more conversation whose texts are full of control strings.
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.read_back(chat.format_conversations(turns.union(more)))


@query
def op6_main_text(spark, folder):
    return extract.extract(table(spark, folder, "pages"))


@query
def op11_jump_shards(spark, folder):
    """The small columns are written first, so that the texts are read once."""
    rows = staged(sharding.measured(table(spark, folder, "documents")), "sizes")
    return sharding.shard_table(rows)


@query
def op13_merkle_manifest(spark, folder):
    rows = merkle.leaves(table(spark, folder, "documents"), tampered=merkle.tampered_rows())
    return merkle.proofs(*merkle.manifest(rows))


@query
def op12_ranked_search(spark, folder):
    return ranking.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
