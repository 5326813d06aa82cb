"""Exact duplicates by a tree merge of sorted digest runs.

Every document becomes a digest entry in one of ``runs`` runs. A run is sorted by digest and
holds an entry once, with the identifier to keep and the number of rows. In each round
``fan_in`` runs are merged into one: their sorted entries come together, and one pass in the order of
digest and identifier closes every entry at its last row, until one run is left. A merged run is
spread over the cluster by digest, so no round ends in one task, and is written, sorted, for the next
round and the way back. The classes of more than one row then travel down the same tree, from written run
to written run, to the first runs, where the documents are. Copies of one text are therefore at
most ``fan_in`` entries to a merge, and their rows spread over ``runs`` keys.

An entry is verified at every level by the text's length and a second, independent hash beside the
SHA-256 digest: rows that differ in any of the three are never merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import ascii_lower
from tidewatch.plans.staging import staged

RUNS, FAN_IN = 512, 8
ENTRY = ["digest", "n_bytes", "check"]


def digest_entries(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """``doc_id, digest, n_bytes, check, run`` of each row, dealt out to the runs."""
    lowered = docs.select("doc_id", ascii_lower(F.col("text")).alias("_text"))
    entries = lowered.select(
        "doc_id",
        F.unhex(F.sha2(F.col("_text"), 256)).alias("digest"),
        F.octet_length("_text").alias("n_bytes"),
        F.xxhash64("_text").alias("check"),
        F.pmod(F.xxhash64(F.lit("run"), "doc_id"), F.lit(runs)).cast("int").alias("run"),
    )
    # Written once, so that the texts are read and hashed once for the first runs and the way back.
    return staged(entries, "digests")


def merged(entries: DataFrame, keep: str) -> DataFrame:
    """One row of each entry of each run, sorted: the identifier that stays and the number of rows.

    Nothing is held of an entry but the sums so far: the first row in the order has the identifier, the
    last one the whole size.
    """
    first = F.desc_nulls_last("keep_id") if keep == "largest" else F.asc_nulls_last("keep_id")
    entry = Window.partitionBy("run", *ENTRY).orderBy(first)
    so_far = entry.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = entries.select(
        "run",
        *ENTRY,
        F.first("keep_id").over(so_far).alias("keep_id"),
        F.sum("group_size").over(so_far).alias("group_size"),
        F.lead("group_size").over(entry).isNull().alias("_last"),
    )
    return rows.where("_last").drop("_last")


def merge_tree(entries: DataFrame, keep: str = "smallest", runs: int = RUNS, fan_in: int = FAN_IN) -> list[DataFrame]:
    """The written runs of each round, from the single runs up to the one of all rows."""
    leaves = entries.select("run", *ENTRY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    levels = [staged(merged(leaves, keep), "run_0")]
    while runs > 1:
        runs = -(-runs // fan_in)
        together = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        levels.append(staged(merged(together, keep), f"run_{len(levels)}"))
    return levels


def exact_duplicates(
    docs: DataFrame, keep: str = "smallest", runs: int = RUNS, fan_in: int = FAN_IN
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of each row of ``docs`` (``doc_id, text``).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the smallest (or largest) doc_id stays. A null doc_id stays only where all
    of its group are null. Rows that repeat both doc_id and text are alike: all have the same
    ``kept``. Other columns are ignored, and an empty table gives an empty result. Runs jobs at
    once and keeps the digests and runs below ``spark.checkpoint.dir``.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    entries = digest_entries(docs, runs)
    levels = merge_tree(entries, keep, runs, fan_in)
    found = levels[-1].where("group_size > 1")
    for level in reversed(levels[:-1]):
        up = found.select(F.col("run").alias("_up"), *ENTRY, F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))
        down = level.select("run", F.floor(F.col("run") / fan_in).cast("int").alias("_up"), *ENTRY)
        found = down.join(up, ["_up", *ENTRY]).select(
            "run", *ENTRY, F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size")
        )
    classes = found.select("run", *ENTRY, "keep_id", "group_size")
    rows = entries.join(classes, ["run", *ENTRY], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns whatever their names, one row per text.

    Rows that repeat both doc_id and text are one document: any one of them stays.
    """
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    key, sha, copies = (mark + c for c in ("id", "sha", "copies"))
    found = exact_duplicates(docs.select("doc_id", "text"), keep)
    # More than one row of the group may bear the identifier that stays.
    staying = found.where("kept").groupBy(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha))
    staying = staying.agg(F.count("*").alias(copies))
    rows = docs.withColumn(mark + "own", F.sha2(ascii_lower(F.col("text")), 256))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mark + "own") == F.col(sha))
    kept = rows.join(staying, same).drop(key, mark + "own")
    once = kept.where(F.col(copies) == 1)
    repeated = kept.where(F.col(copies) > 1).dropDuplicates(["doc_id", sha])
    return once.union(repeated).drop(sha, copies)
