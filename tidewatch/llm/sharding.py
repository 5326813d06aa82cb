"""Sharding by jump consistent hashing.

A key starts a linear congruential generator, and each draw says at which number of shards the key
moves next; its shard is the last place before the wanted number. There is no table of a ring: the key
and the number of shards decide. When shards are appended, a row either stays or goes to one of the new
shards, and one in n goes to the n-th. The draws are those of the published function, so any program
that has it finds the shard of a key by itself.

Everything is a column expression. Finding the shard needs no shuffle; only the slot numbers do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import DOCUMENT_COLUMNS

SHARDS = 16
# Fixed values of the published generator: state * MULTIPLIER + 1, modulo 2 ** 64.
MULTIPLIER = 2862933555777941757
# Draws written out; a key needs ln(shards) on average. A key that needs more goes on to the end.
_DRAWS = 40
_LOW = 0xFFFFFFFF
#: Rows of a piece: slots are counted piece by piece.
PER_PIECE = 16_384


def _cut(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_LOW))


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """Both halves of the next state. Factors are cut to 16 bits where a long would overflow."""
    top, bottom = MULTIPLIER >> 32, MULTIPLIER & _LOW
    above, below = F.lit(bottom >> 16), F.lit(bottom & 0xFFFF)

    def product(half: Column, more: int) -> Column:
        return half * below + more + F.shiftleft((half * above).bitwiseAND(F.lit(0xFFFF)), 16)

    carry = F.shiftright(product(low, 1), 32) + F.shiftright(low * above, 16)
    return _cut(carry + _cut(product(high, 0)) + _cut(low * F.lit(top))), _cut(product(low, 1))


def jump(key: Column, shards: int, grown: int | None = None) -> Column:
    """``(shard, grown_shard)`` of a 64-bit key with ``shards`` and, appended to, ``grown`` shards.

    Without ``grown`` both are the same. A null key counts as 0.
    """
    most = grown or shards
    if not 1 <= shards <= most:
        raise ValueError("at least one shard, and shards are only appended")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        _cut(key).alias("low"),
        zero.alias("place"),
        zero.alias("before"),
        zero.alias("next"),
    )

    def draw(s: Column, _: Column) -> Column:
        high, low = _next(s["high"], s["low"])
        # The 31 highest bits of the state make the draw.
        share = F.lit(2.0**31) / (F.shiftright(high, 1) + 1).cast("double")
        moved = F.struct(
            high.alias("high"),
            low.alias("low"),
            s["next"].alias("place"),
            F.when(s["next"] < shards, s["next"]).otherwise(s["before"]).alias("before"),
            F.floor((s["next"] + 1).cast("double") * share).cast("long").alias("next"),
        )
        return F.when(s["next"] < most, moved).otherwise(s)

    def draws(state: Column, n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, draw)

    def places(s: Column) -> Column:
        return F.struct(s["before"].cast("int").alias("shard"), s["place"].cast("int").alias("grown_shard"))

    def done(s: Column) -> Column:
        return places(s) if most <= _DRAWS else F.when(s["next"] >= most, places(s)).otherwise(places(draws(s, most)))

    return F.get(F.transform(F.array(draws(start, min(most, _DRAWS))), done), F.lit(0))


def stable_key(*columns: str) -> Column:
    """A key from any columns, such as a digest of the text where equal texts shall stay together."""
    return F.xxhash64(*columns)


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32)``: a null text has size 1 and the checksum of no bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def assign(rows: DataFrame, key: Column, shards: int = SHARDS, grown: int | None = None) -> DataFrame:
    """All columns, then ``shard`` and, if ``grown`` is given, ``grown_shard``.

    A column of the input with one of these names is replaced.
    """
    names = ["shard", "grown_shard"][: 1 if grown is None else 2]
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in names]
    found = rows.select(*kept, jump(key, shards, grown).alias("_jump"))
    return found.select(*kept, *(F.col(f"_jump.{n}") for n in names))


def moving(rows: DataFrame, key: Column, shards: int, grown: int) -> DataFrame:
    """The rows that move when shards are appended, with their old and new shard."""
    return assign(rows, key, shards, grown).where("shard <> grown_shard")


def slots(rows: DataFrame, spread: Sequence[str] | None = None, per_piece: int = PER_PIECE) -> DataFrame:
    """All columns, then ``slot``: the rows of each ``shard`` numbered from 0 without a gap.

    A shard holds as much as its share of all rows, so no task numbers a whole shard. Rows are dealt to
    pieces by the whole-number columns ``spread`` (by a hash of all columns if not given; a null counts
    as 0), the rows of each piece are counted, and a row is numbered within its piece after those of the pieces before. Pieces are as
    many as the table needs. Equal rows are shuffled as one with their number, so no group of
    copies lands in one task. The order does not depend on files or tasks. Pass narrow rows.
    """
    columns = list(rows.columns)
    counted = rows.agg(F.greatest(F.ceil(F.count("*") / per_piece), F.lit(1)).alias("n")).scalar()
    alike = rows.groupBy(*columns).agg(F.count("*").alias("_copies")).withColumn("_pieces", counted)
    mixed = F.lit(0).cast("long")
    for column in [F.coalesce(c, F.lit(0)) for c in spread] if spread else [F.xxhash64(*columns)]:
        mixed = mixed + F.pmod(column, F.col("_pieces"))
    dealt = alike.withColumn("_piece", F.pmod(mixed, F.col("_pieces"))).drop("_pieces")
    before = (Window.unboundedPreceding, -1)

    def preceding(count: str, window) -> Column:
        return F.coalesce(F.sum(count).over(window.rowsBetween(*before)), F.lit(0))

    pieces = dealt.groupBy("shard", "_piece").agg(F.sum("_copies").alias("_rows"))
    offsets = pieces.select(
        "shard", "_piece", preceding("_rows", Window.partitionBy("shard").orderBy("_piece")).alias("_offset")
    )
    within = Window.partitionBy("shard", "_piece").orderBy(*columns)
    numbered = dealt.withColumn("_within", preceding("_copies", within)).join(offsets, ["shard", "_piece"])
    first = F.col("_offset") + F.col("_within")
    return numbered.select(*columns, F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias("slot"))


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document of ``measured``: its shard, its slot, and its shard with one more.

    The law is ``key``: ``doc_id`` and the number of shards decide, so equal texts of different ids may
    be apart, and rows of one id are together whatever their text. Rows without an id go where id 0
    goes. Repeated rows each have a slot. An empty table gives an empty one.
    """
    placed = assign(docs, F.col("doc_id"), shards, shards + 1)
    return slots(placed, ["doc_id", "text_crc32"]).withColumn("law", F.lit("key"))


def write_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", rows_per_file: int = 100_000
) -> None:
    """Whole documents, a folder ``shard=i`` each, in files of a bounded number of rows.

    Rows are dealt to writers by shard and a hash of the row, so that a shard is not one task. Documents
    need the columns of ``documents``; extra columns are written too.
    """
    placed = assign(docs, F.col(key), shards)
    writers = placed.agg(F.greatest(F.ceil(F.count("*") / rows_per_file / shards), F.lit(1)).alias("n")).scalar()
    dealt = placed.withColumn("_writers", writers)
    piece = F.pmod(F.xxhash64(*DOCUMENT_COLUMNS), F.col("_writers"))
    dealt = dealt.repartition("shard", piece).drop("_writers")
    dealt.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def append_shards(
    spark: SparkSession, path: str, target: str, shards: int, grown: int, key: str = "doc_id"
) -> None:
    """Write the rows of a sharded table that move when shards are appended into their new folders.

    ``target`` then holds the folders ``shards`` to ``grown - 1`` and nothing else; the rows that stay
    are not written again. A reader leaves out of the old folders what ``moving`` names.
    """
    stored = spark.read.parquet(path).drop("shard")
    moved = moving(stored, F.col(key), shards, grown).drop("shard").withColumnRenamed("grown_shard", "shard")
    moved.write.partitionBy("shard").parquet(target)
