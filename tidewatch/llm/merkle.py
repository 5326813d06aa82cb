"""Merkle manifest of a table: a tree of digests per group of rows, and one over the groups.

The place of a leaf in its tree is the rank of its id among the ids of its group. No sort finds it. The ids
of a group become a bitmap, kept as its non-empty words of 64 bits; tasks make partial bitmaps that are merged
with ``or``. Directories above hold how many rows lie below every word, block of words, and so on;
a rank is a sum down the directories plus the bits below one's own in one word. With their places known, digests go into arrays
of ``BLOCK`` slots, and an array is reduced by three levels at once.

Repeated ids are counted beside the bitmap. Rows of one id are in the order of their leaves, which again are ranked by
a bitmap over the digests; equal rows have equal leaves and take consecutive places.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import ascii_lower, small_batches
from tidewatch.plans.staging import staged

# Nodes that make up a parent, levels an array is reduced by, and its slots.
BRANCH, LEVELS = 8, 3
BLOCK = BRANCH**LEVELS
#: Columns of a leaf, in the order in which they are hashed.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# Directories each hold 4096 words or blocks; with five of them ids of 64 bits are covered.
_STEP, _DIRECTORIES = 12, 4
_WORD_BITS = 6
# A null id is below all others: a word of its own before the first.
_NULL_WORD = -(1 << (63 - _WORD_BITS)) - 1
_HEX = 64


# Leaves ------------------------------------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Hex SHA-256 of the values: each its count of bytes, a colon and itself, a null a dash."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def tampered_rows(key: str = "doc_id") -> Column:
    """Whether 3 divides the CRC-32 of the id in decimal. Rows without an id are left alone."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(
    rows: DataFrame,
    columns: Sequence[str] = COLUMNS,
    key: str = "doc_id",
    group: str = "lang",
    tampered: Column | None = None,
    text: str = "text",
) -> DataFrame:
    """``(tree, key, leaf, tampered)`` per row, digests in binary.

    ``tree`` names the group in byte order: empty for null, which is first, else ``=`` and its value.
    Where the condition ``tampered`` holds, the column of that name has the digest of the row with A-Z of
    ``text`` lower-cased, if it differs; elsewhere it is null. Other columns of the rows play no part.
    """
    fields = {c: F.col(f"`{c}`") for c in columns}
    lowered = {**fields, text: F.when(fields[text].isNotNull(), ascii_lower(fields[text]))}
    changed = F.when(tampered, F.unhex(digest(*lowered.values()))) if tampered is not None else F.lit(None).cast("binary")
    found = rows.select(
        F.coalesce(F.concat(F.lit("="), fields[group].cast("string")), F.lit("")).alias("tree"),
        F.col(f"`{key}`").cast("long").alias("key"),
        F.unhex(digest(*fields.values())).alias("leaf"),
        changed.alias("tampered"),
    )
    return found.withColumn("tampered", F.when(F.col("tampered") != F.col("leaf"), F.col("tampered")))


# Places ------------------------------------------------------------------------------------------


def _located(rows: DataFrame) -> DataFrame:
    """The word of each key's bit and the bit."""
    word = F.coalesce(F.shiftright("key", _WORD_BITS), F.lit(_NULL_WORD))
    bit = F.coalesce(F.col("key").bitwiseAND(F.lit((1 << _WORD_BITS) - 1)), F.lit(0)).cast("int")
    return rows.withColumn("_word", word).withColumn("_bit", bit)


def bitmap(counted: DataFrame) -> DataFrame:
    """Words of the bitmap of each ``tree``, from rows of ``(tree, key, n)``.

    ``(tree, word, bits, n, repeats)``: rows in the word, and for keys of several rows the bit and the
    number of rows beyond the first. A word has 64 keys at most, so no list grows.
    """
    keys = _located(counted.groupBy("tree", "key").agg(F.sum("n").alias("n")))
    repeat = F.when(F.col("n") > 1, F.struct(F.col("_bit").alias("bit"), (F.col("n") - 1).alias("more")))
    return keys.groupBy("tree", F.col("_word").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("bits"),
        F.sum("n").alias("n"),
        F.collect_list(repeat).alias("repeats"),
    )


def directory(words: DataFrame) -> DataFrame:
    """``(tree, word, first, total)``: rows before each word in its tree, and in the tree.

    Sums run over the children of one parent only, 4,096 at most, whatever the ids are.
    """
    levels = [words.select("tree", F.col("word").alias("node"), "n")]
    for _ in range(_DIRECTORIES):
        parent = F.shiftright("node", _STEP).alias("node")
        levels.append(levels[-1].groupBy("tree", parent).agg(F.sum("n").alias("n")))

    def before(*keys: str) -> Column:
        window = Window.partitionBy(*keys).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    top = levels.pop()
    found = top.select(
        "tree", "node", before("tree").alias("first"), F.sum("n").over(Window.partitionBy("tree")).alias("total")
    )
    for level in reversed(levels):
        above = found.select("tree", F.col("node").alias("parent"), F.col("first").alias("_above"), "total")
        counted = level.withColumn("parent", F.shiftright("node", _STEP))
        counted = counted.withColumn("_before", before("tree", "parent"))
        found = counted.join(above, ["tree", "parent"]).select(
            "tree", "node", (F.col("_above") + F.col("_before")).alias("first"), "total"
        )
    return found.withColumnRenamed("node", "word")


def ranks(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The rows, each with ``position``, the rows of its tree with a smaller key, ``total`` and ``repeated``."""
    columns = rows.columns
    index = words.join(directory(words), ["tree", "word"]).withColumnRenamed("word", "_word").drop("n")
    met = _located(rows).join(index, ["tree", "_word"])
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, _bit)")))).cast("long")
    more = F.expr("aggregate(filter(repeats, r -> r.bit < _bit), 0L, (s, r) -> s + r.more)")
    return met.select(
        *columns,
        (F.col("first") + below + more).alias("position"),
        "total",
        F.expr("exists(repeats, r -> r.bit = _bit)").alias("repeated"),
    )


def _spread_repeats(ties: DataFrame) -> DataFrame:
    """Places of the rows whose key is repeated: by leaf, equal leaves one after the other.

    Equal rows are one row with their number before they are shuffled, and the leaves of one key are ranked like
    keys, so that a key of many rows is no one task's work.
    """
    counted = ties.groupBy(*ties.columns).agg(F.count("*").alias("n"))
    # A tree per key; its own keys are the first 60 bits of the leaves.
    inner = counted.select(
        F.concat_ws(" ", F.col("position").cast("string"), "tree").alias("tree"),
        F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long").alias("key"),
        "n",
        F.struct(*ties.columns).alias("_row"),
    )
    inner = staged(inner, "repeated")
    found = ranks(inner, staged(bitmap(inner.select("tree", "key", "n")), "bitmap"))
    # Leaves that agree in 60 bits.
    order = Window.partitionBy("tree", "key").orderBy("_row.leaf").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_row.position") + F.col("position") + F.coalesce(F.sum("n").over(order), F.lit(0))
    found = found.select("_row", "n", first.alias("_first"))
    placed = found.select("_row", F.expr("explode(sequence(_first, _first + n - 1)) AS position"))
    return placed.select(*(f"_row.{c}" for c in ties.columns if c != "position"), "position")


def coordinates(rows: DataFrame) -> DataFrame:
    """``(tree, key, leaf, tampered, position, total)`` of leaves that were staged."""
    words = staged(bitmap(rows.select("tree", "key", F.lit(1).cast("long").alias("n"))), "bitmap")
    found = ranks(rows, words)
    if words.where("size(repeats) > 0").isEmpty():
        return found.drop("repeated")
    single = found.where("not repeated").drop("repeated")
    return single.unionByName(_spread_repeats(found.where("repeated").drop("repeated")))


def _numbered(rows: DataFrame, column: str) -> DataFrame:
    """The rows numbered by a column without repeats: ranges are counted, then numbered one by one."""
    ranges = rows.repartitionByRange(column).withColumn("_range", F.spark_partition_id())
    ranges = staged(ranges, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the shuffle above.
    starts = ranges.groupBy("_range").agg(F.count("*").alias("n"))
    starts = starts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranges.withColumn("_within", within - 1).join(starts, "_range").select(
        *rows.columns, (F.col("_start") + F.col("_within")).alias("position")
    )


# Levels ------------------------------------------------------------------------------------------


def _hash(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def climb(cells: bytes, levels: int) -> list[bytes]:
    """Nodes level by level, from a run of hex digests written one after the other."""
    out = [cells]
    run = BRANCH * _HEX
    for _ in range(levels):
        out.append(b"".join(_hash(out[-1][i : i + run]) for i in range(0, len(out[-1]), run)))
    return out


def siblings(levels: list[bytes], slot: int) -> list[tuple[bytes, bytes]]:
    """The other nodes of the run a slot is in, left and right of it, level by level."""
    out = []
    for cells in levels[:-1]:
        first = slot - slot % BRANCH
        out.append((cells[first * _HEX : slot * _HEX], cells[(slot + 1) * _HEX : (first + BRANCH) * _HEX]))
        slot //= BRANCH
    return out


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its siblings give."""
    for left, right in path:
        node = _hash(left + node + right)
    return node


def _array(members: pa.StructArray) -> tuple[bytes, list[int]]:
    """The digests of a block by slot, and the slots of its members."""
    slots = members.field("slot").to_pylist()
    cells = [b""] * len(slots)
    for slot, value in zip(slots, members.field("digest").to_pylist()):
        cells[slot] = value.hex().encode()
    return b"".join(cells), slots


def _members(batch: pa.RecordBatch) -> Iterator[pa.StructArray]:
    lists = batch.column("members")
    for i in range(len(lists)):
        yield lists[i].values


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node at the top of each block."""
    for batch in batches:
        levels = batch.column("levels").to_pylist()
        tops = [climb(_array(m)[0], min(n, LEVELS))[-1] for n, m in zip(levels, _members(batch))]
        nodes = pa.array([bytes.fromhex(t.decode()) for t in tops], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), batch.column("levels"), nodes],
                                         ["tree", "position", "levels", "digest"])


_NODES = "tree string, position long, levels int, digest binary"


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """Arrays of ``BLOCK`` slots: ``(tree, block, levels, members)``, written."""
    slot = F.pmod("position", F.lit(BLOCK)).cast("int").alias("slot")
    block = F.expr(f"position div {BLOCK}").alias("block")
    members = F.collect_list(F.struct(slot, "digest", *more)).alias("members")
    return staged(nodes.groupBy("tree", block).agg(F.max("levels").alias("levels"), members), "blocks")


def _bare_members() -> Column:
    return F.expr("transform(members, m -> struct(m.slot, m.digest))").alias("members")


def _levels_of(total: Column) -> Column:
    """Levels between so many nodes and one."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(20)),
        F.lit(0),
        lambda n, k: n + F.when(total > F.call_function("shiftleft", F.lit(1).cast("long"), k * 3), 1).otherwise(0),
    )


@dataclass(frozen=True)
class Tree:
    """Written arrays of all trees, from the leaves up, and the node each tree ends in."""

    rounds: list[DataFrame]
    roots: DataFrame


def build(nodes: DataFrame, *more: str) -> Tree:
    """Reduce ``(tree, position, levels, digest)``; columns in ``more`` stay with the leaves."""
    rounds = [_blocks(nodes, *more)]
    while True:
        tops = rounds[-1].select("tree", "block", "levels", _bare_members()).mapInArrow(_reduced, _NODES).withColumn("levels", F.greatest(F.col("levels") - LEVELS, F.lit(0)))
        # The highest tree decides; the number of rounds is the logarithm of its size.
        if not rounds[-1].agg(F.coalesce(F.max(F.col("levels") > LEVELS), F.lit(False))).first()[0]:
            return Tree(rounds, staged(tops.select("tree", "digest"), "roots"))
        rounds.append(_blocks(tops))


_STEP_TYPE = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
_PATHS = pa.schema(
    [("tree", pa.string()), ("block", pa.int64()), ("path", _STEP_TYPE), ("subroot", pa.binary()), ("root", pa.binary())]
)
_PROOFS = pa.schema(
    [
        ("key", pa.int64()),
        ("leaf", pa.string()),
        ("subroot", pa.string()),
        ("root", pa.string()),
        ("proof_sha256", pa.string()),
        ("folded_root", pa.string()),
        ("verified", pa.bool_()),
    ]
)
_PATH = "path array<struct<left: binary, right: binary>>, subroot binary, root binary"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The siblings of every node of a block up to the root."""
    for batch in batches:
        trees, blocks = batch.column("tree").to_pylist(), batch.column("block").to_pylist()
        counts, above = batch.column("levels").to_pylist(), batch.column("path").to_pylist()
        ends = zip(batch.column("subroot").to_pylist(), batch.column("root").to_pylist())
        for tree, block, n, members, path, (subroot, root) in zip(trees, blocks, counts, _members(batch), above, ends):
            cells, slots = _array(members)
            levels = climb(cells, min(n, LEVELS))
            rows = [
                {
                    "tree": tree,
                    "block": block * BLOCK + slot,
                    "path": [{"left": a, "right": b} for a, b in siblings(levels, slot)] + path,
                    "subroot": subroot,
                    "root": root,
                }
                for slot in slots
            ]
            yield pa.RecordBatch.from_pylist(rows, _PATHS)


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per leaf: the digest of its proof, and the root that the row as it is found gives."""
    for batch in batches:
        counts, above = batch.column("levels").to_pylist(), batch.column("path").to_pylist()
        ends = zip(batch.column("subroot").to_pylist(), batch.column("root").to_pylist())
        for n, members, steps, (subroot, root) in zip(counts, _members(batch), above, ends):
            cells, slots = _array(members)
            levels = climb(cells, min(n, LEVELS))
            upper = [(s["left"], s["right"]) for s in steps]
            rows = []
            keys, changed = members.field("key").to_pylist(), members.field("tampered").to_pylist()
            for slot, key, other in zip(slots, keys, changed):
                leaf = cells[slot * _HEX : (slot + 1) * _HEX]
                path = siblings(levels, slot) + upper
                folded = fold(other.hex().encode() if other else leaf, path)
                rows.append(
                    {
                        "key": key,
                        "leaf": leaf.decode(),
                        "subroot": subroot.decode(),
                        "root": root.decode(),
                        "proof_sha256": _hash(b"".join(part for step in path for part in step)).decode(),
                        "folded_root": folded.decode(),
                        "verified": folded == root,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, _PROOFS)


def manifest(rows: DataFrame) -> tuple[Tree, Tree]:
    """Trees of the groups and the tree over them, from ``leaves``.

    Leaves are in ascending order of the key, a null first; the groups in byte order of their names. The
    second tree's members carry the name of their group. An empty table has no tree at all.
    """
    small_batches(rows.sparkSession)
    placed = coordinates(staged(rows, "leaves"))
    nodes = placed.select(
        "tree", "position", _levels_of(F.col("total")).alias("levels"), F.col("leaf").alias("digest"), "key", "tampered"
    )
    groups = build(nodes, "key", "tampered")
    ordered = staged(_numbered(groups.roots.withColumnRenamed("tree", "group"), "group"), "groups")
    total = F.lit(ordered.count()).cast("long")
    over = ordered.select(F.lit("").alias("tree"), "position", _levels_of(total).alias("levels"), "digest", "group")
    return groups, build(over, "group")


def proofs(groups: Tree, over: Tree, key: str = "doc_id") -> DataFrame:
    """One row per leaf, with the proof from it to the root and the check of the row as it is found."""
    hexed = F.lower(F.hex("digest")).cast("binary")
    nothing = F.expr("cast(array() AS array<struct<left: binary, right: binary>>)")
    root = over.roots.select("tree", F.lit(0).cast("long").alias("block"), nothing.alias("path"), hexed.alias("root"))
    above = root.withColumn("subroot", F.lit(None).cast("binary"))
    columns = ["tree", "block", "levels", "members", "path", "subroot", "root"]

    def down(tree: Tree, above: DataFrame, until: int) -> DataFrame:
        for blocks in reversed(tree.rounds[until:]):
            met = blocks.select("tree", "block", "levels", _bare_members()).join(above, ["tree", "block"])
            above = met.select(*columns).mapInArrow(_paths, f"tree string, block long, {_PATH}")
        return above

    # Number of a group to its name and node.
    members = over.rounds[0].select((F.col("block") * BLOCK).alias("_first"), F.explode("members").alias("m"))
    named = members.select((F.col("_first") + F.col("m.slot")).alias("block"), "m.group", "m.digest")
    tops = down(over, above, 0).drop("subroot", "tree").join(named, "block").withColumn("block", F.lit(0).cast("long"))
    tops = tops.select(F.col("group").alias("tree"), "block", "path", hexed.alias("subroot"), "root")
    above = down(groups, staged(tops, "paths"), 1)
    met = groups.rounds[0].join(above, ["tree", "block"]).select(*columns)
    schema = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return met.mapInArrow(_proved, schema).withColumnRenamed("key", key)
