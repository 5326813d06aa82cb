"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source, in a fixed random order, are one stream of words, repeated as often as a word
may be taken, and cut into blocks of equal size; a source's quota is the whole number of blocks
nearest its target. The root of
the tree holds all quotas. Each node deals its blocks to two halves: how many blocks of each
source fall to the left half is drawn from the multivariate hypergeometric distribution, one
source after the other, by exact inversion around the mode. At the leaves every output shard has
a number of blocks per source, which add up to the quotas exactly. The blocks of a source are permuted by
a seeded bijection of their numbers; the shards take disjoint ranges of the permuted numbers, those beyond the
quota are left out, and each shard shuffles its own rows. A block is at least ``block`` words and at
least one part in ``blocks`` of all words, so that documents are cut at few places of a large corpus.

The order of a source is never sorted in one task: documents fall into ``BUCKETS`` hash
buckets per source, running sums are taken within a bucket, and only the sums of the buckets are
added up along the source. A source with a third of all rows spreads over all its buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
_EDGE = [chr(c) for c in (0x20, *range(0x09, 0x0E))]


@dataclass(frozen=True)
class MixParams:
    """``weights`` go round over the sources in code point order, a null source last.

    ``share`` of all words is taken, at most ``most`` times the words of a source.
    """

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    most: int = 2
    block: int = 32
    blocks: int = 1 << 14
    levels: int = 4  # 2 ** levels shards
    seed: int = 7


def word_count(text: Column) -> Column:
    """Number of words, runs of anything but blank and 0x09-0x0D; 0 for null."""
    parts = F.size(F.split(text, "[\\x20\\x09-\\x0D]+", -1))
    ends = F.substring(text, 1, 1).isin(_EDGE).cast("int") + F.right(text, F.lit(1)).isin(_EDGE).cast("int")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(parts - ends).cast("long")


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and what the mix needs of each row."""
    return docs.select(
        *keep,
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("_source"),
        word_count(F.col("text")).alias("_size"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tie"),
        F.col("doc_id").alias("_id"),
    )


def source_targets(totals: DataFrame, params: MixParams) -> DataFrame:
    """``_source, place, source_size, weight, target`` from ``_source, source_size``.

    One row per source. A level such that sum(min(most * size, level * weight)) is the wanted
    total: sources below it by size per weight are full, the others share by weight.
    """
    listed = F.array(*[F.lit(float(w)) for w in params.weights])
    order = Window.orderBy(F.col("_source") == "", "_source")
    placed = totals.withColumn("place", F.row_number().over(order)).withColumn(
        "weight", F.element_at(listed, ((F.col("place") - 1) % len(params.weights) + 1).cast("int"))
    )
    cap = (F.col("source_size") * params.most).cast("double")
    ratio = Window.orderBy(cap / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rest = (F.sum("source_size").over(whole) * params.share - F.coalesce(F.sum(cap).over(ratio), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(ratio), F.lit(0.0))
    )
    levels = placed.withColumn("_level", rest)
    fits = F.when(F.col("_level") <= cap / F.col("weight"), F.struct(cap / F.col("weight"), "place", "_level"))
    level = F.coalesce(F.min(fits).over(whole)["_level"], F.max(cap / F.col("weight")).over(whole))
    return levels.withColumn("target", F.least(cap, level * F.col("weight"))).drop("_level")


# Primes above any number of blocks of a source, so prime to it.
_PRIMES = (15485863, 32452843, 49979687, 67867967, 86028121, 104395301, 122949823, 141650939, 160481183, 179424673, 982451653)


def block_step(many: str) -> str:
    """SQL for the prime modulo ``many`` that is nearest the golden section of it: neighbours then lie far apart."""
    listed = ", ".join(f"{p}L" for p in _PRIMES)
    least = f"greatest({many}, 1L)"
    return f"array_min(transform(array({listed}), p -> named_struct('off', abs(p % {least} / {least} - 0.618D), 'step', p % {least}))).step"


def permuted(number: str, many: str, step: str, shift: str) -> str:
    """SQL for a bijection of the numbers below ``many``, for a ``step`` prime to it."""
    return f"(({number} * {step} + {shift}) % {many})"


def _hypergeometric(total: str, good: str, draws: str, uniform: str) -> str:
    """SQL for a draw by inversion: how many of ``draws`` from ``total`` are among the ``good``.

    Probabilities are taken relative to the mode's, out to 12 deviations and 30 counts on either
    side, beyond which doubles hold nothing; outcomes are ordered mode, above, below.
    """
    walk = lambda steps, left, factor, move: (
        f"aggregate({steps}, named_struct('w', 1D, 'left', {left}, 'k', p.mode), (a, i) -> "
        f"if(a.left < 0, a, named_struct('w', a.w * {factor}, 'left', a.left - a.w * {factor}, 'k', a.k {move} 1)))"
    )
    up = "((p.good - a.k) * 1D * (p.draws - a.k) / ((a.k + 1D) * (p.total - p.good - p.draws + a.k + 1)))"
    down = "(a.k * 1D * (p.total - p.good - p.draws + a.k) / ((p.good - a.k + 1D) * (p.draws - a.k + 1)))"
    none = "cast(array() as array<bigint>)"
    above = f"if(p.hi > p.mode, sequence(p.mode, p.hi - 1), {none})"
    below = f"if(p.lo < p.mode, sequence(p.lo, p.mode - 1), {none})"
    weigh = lambda steps, factor, move: (
        f"aggregate({steps}, named_struct('w', 1D, 'sum', 0D, 'k', p.mode), (a, i) -> "
        f"named_struct('w', a.w * {factor}, 'sum', a.sum + a.w * {factor}, 'k', a.k {move} 1), a -> a.sum)"
    )
    let = lambda value, body: f"transform(array({value}), p -> {body})[0]"
    first = (
        f"named_struct('total', {total}, 'good', {good}, 'draws', {draws}, 'u', {uniform},"
        f" 'mode', greatest(0L, {draws} - ({total} - {good}), least({good}, {draws},"
        f" cast(floor(({draws} + 1D) * ({good} + 1D) / ({total} + 2D)) as bigint))),"
        f" 'far', cast(30 + 12 * sqrt({draws} * 1D * {good} / greatest({total}, 1L)) as bigint))"
    )
    second = (
        "named_struct('total', p.total, 'good', p.good, 'draws', p.draws, 'u', p.u, 'mode', p.mode,"
        " 'lo', greatest(0L, p.draws - (p.total - p.good), p.mode - p.far), 'hi', least(p.good, p.draws, p.mode + p.far))"
    )
    third = (
        "named_struct('total', p.total, 'good', p.good, 'draws', p.draws, 'u', p.u, 'mode', p.mode, 'lo', p.lo,"
        f" 'hi', p.hi, 'up', {weigh(above, up, '+')}, 'down', {weigh(below, down, '-')})"
    )
    mass = "p.u * (1D + p.up + p.down)"
    draw = (
        f"if({mass} < 1D + p.up, {walk(above, f'{mass} - 1D', up, '+')}.k,"
        f" {walk(below, f'{mass} - 1D - p.up', down, '-')}.k)"
    )
    return let(first, let(second, let(third, draw)))


def split_quotas(quotas: DataFrame, params: MixParams) -> DataFrame:
    """``shard, place, blocks``: the quotas (``place, quota``; one row per source) dealt to the shards.

    One row per node holds the quotas of all sources, so a row grows with the sources only.
    """
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "quota"))), lambda x: x["quota"])
    nodes = quotas.groupBy().agg(listed.alias("quotas"), F.lit(0).cast("long").alias("node"))
    total = "aggregate({0}, 0L, (s, x) -> s + x)"
    for depth in range(params.levels):
        uniform = f"shiftrightunsigned(xxhash64({params.seed}, {depth}, node, j), 11) / 9007199254740992D"
        rest = f"({total.format('slice(quotas, j, size(quotas))')})"
        left = f"(shiftright({total.format('quotas')}, 1) - {total.format('done')})"
        draw = _hypergeometric(rest, "quotas[j - 1]", left, uniform)
        halves = F.expr(
            "aggregate(if(size(quotas) > 0, sequence(1, size(quotas)), cast(array() as array<int>)),"
            f" cast(array() as array<bigint>), (done, j) -> concat(done, array({draw})))"
        )
        nodes = nodes.withColumn("left", halves).select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
                    F.struct(
                        (F.col("node") * 2 + 1).alias("node"),
                        F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas"),
                    ),
                )
            ).alias("n")
        ).select("n.node", "n.quotas")
    return nodes.select(F.col("node").cast("int").alias("shard"), F.posexplode("quotas").alias("place", "blocks")).select(
        "shard", (F.col("place") + 1).alias("place"), "blocks"
    )


def mix(rows: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Each row of ``measured`` with ``size, source_size, target, taken, pieces``.

    ``pieces`` lists what the shards take of the document: ``shard, copy, start, words``; a
    document may be in several shards or twice in the mix, a long one in many pieces. ``taken`` adds up the words. Rows
    that repeat each other count each on their own; a null text has size 0 and is never taken. Rows
    without doc_id are put in order by their texts.
    ``rows`` is read twice, once for the sums of the buckets.
    """
    if params.most * params.blocks >= _PRIMES[0]:
        raise ValueError(f"most * blocks must be below {_PRIMES[0]}")
    order = F.xxhash64(F.lit(params.seed), "_id", F.when(F.col("_id").isNull(), F.col("_tie")))
    rows = rows.withColumn("_order", order).withColumn("_bucket", F.pmod(F.col("_order"), F.lit(BUCKETS)).cast("int"))
    buckets = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("words"))
    along = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("_source", "_bucket", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("_start"), "words")
    totals = buckets.groupBy("_source").agg(F.sum("words").alias("source_size"))
    sources = source_targets(totals, params)
    everything = F.sum("source_size").over(Window.partitionBy())
    sources = sources.withColumn("_block", F.greatest(F.lit(params.block), F.ceil(everything / params.blocks)).cast("long"))
    sources = sources.withColumn("_many", F.floor(F.col("source_size") * params.most / F.col("_block")).cast("long"))
    quota = F.least(F.round(F.col("target") / F.col("_block")).cast("long"), "_many")
    sources = sources.withColumn("_shift", F.pmod(F.xxhash64(F.lit(params.seed), "_source"), F.greatest("_many", F.lit(1))))
    sources = sources.withColumn("_step", F.expr(block_step("_many")))
    shares = split_quotas(sources.select("place", quota.alias("quota")), params)
    shares = shares.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("shard", "blocks"))).alias("_shares"))
    # The first permuted number after those of each shard.
    ends = F.expr("transform(_shares, (s, i) -> aggregate(slice(_shares, 1, i + 1), 0L, (a, x) -> a + x.blocks))")
    plan = sources.join(shares, "place").select("_source", "source_size", "target", "_block", "_many", "_step", "_shift", ends.alias("_ends"))
    plan = buckets.drop("words").join(plan, "_source")
    running = Window.partitionBy("_source", "_bucket").orderBy("_order", "_id", "_size", "_tie")
    running = running.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_size").over(running), F.lit(0)))
    joined = rows.join(plan, ["_source", "_bucket"]).withColumn("_from", F.col("_before") + F.col("_start"))
    # The blocks that each copy of a document reaches into, and what of it lies in them.
    begin = "(c * source_size + _from)"
    reached = f"if(_size > 0, sequence({begin} div _block, ({begin} + _size - 1) div _block), cast(array() as array<bigint>))"
    start = f"greatest(k * _block, {begin})"
    shard = f"size(filter(_ends, e -> e <= {permuted('k', '_many', '_step', '_shift')}))"
    piece = f"'shard', {shard}, 'copy', c, 'start', {start} - {begin}, 'words', least((k + 1) * _block, {begin} + _size) - {start}"
    whole = f"filter({reached}, k -> k < _many)"  # the stream's last block may not be whole
    pieces = F.expr(
        f"filter(flatten(transform(sequence(0, {params.most - 1}), c -> transform({whole}, k -> named_struct({piece})))),"
        " x -> x.shard < size(_ends))"
    )
    found = joined.withColumn("pieces", pieces)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    made = ["_source", "_bucket", "_start", "_ends", "_block", "_many", "_step", "_shift", "_order", "_before", "_from", "_tie", "_id", "_size"]
    return found.withColumn("size", F.col("_size")).withColumn("taken", taken).drop(*made)


def mixed_rows(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mix itself: a row per piece with the columns of ``docs``, ``shard`` and ``copy``, dealt out by shard
    and shuffled within it. The text of a piece that is only part of its document (where a block begins
    or ends in it) is cut to its words, joined by blanks. Columns of ``docs`` that clash with
    the new ones, or begin with an underscore, are replaced by them."""
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "pieces", "shard", "copy")]
    found = mix(measured(docs, keep), params)
    rows = found.select(*keep, "size", F.explode("pieces").alias("_p"))
    cut = F.array_join(
        F.slice(
            F.filter(F.split("text", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != ""),
            (F.col("_p.start") + 1).cast("int"),
            F.col("_p.words").cast("int"),
        ),
        " ",
    )
    text = F.when(F.col("_p.words") == F.col("size"), F.col("text")).otherwise(cut)
    out = [text.alias(c) if c == "text" else F.col(c) for c in keep]
    if "n_chars" in keep:
        out[keep.index("n_chars")] = F.length(text).cast("long").alias("n_chars")
    rows = rows.select(*out, F.col("_p.shard").alias("shard"), F.col("_p.copy").alias("copy"))
    mixed = F.xxhash64(F.lit(params.seed + 1), "doc_id", "copy", "text")
    return rows.repartition("shard", F.pmod(mixed, F.lit(64))).sortWithinPartitions("shard", mixed)
