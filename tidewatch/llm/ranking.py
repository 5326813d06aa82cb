"""Ranked lexical search by a dual tree.

Items and documents each form a hierarchy. A node of items holds, per term, the largest weight any of its
items gives the term; a node of documents the largest share any of its documents gets for it. The product of
two nodes is then no less than the score of any item of the one with any document of the other. If it
lies below the weakest k-th score among the items, no pair of the two can enter a ranking, and the whole batch is left
out. All other pairs are opened, down to the exact scores. Documents whose score equals the k-th are
never left out, since the smaller id goes first.

Spark reads the texts once and writes, per document, the counts of the items' terms. Each task then builds the hierarchy
of a batch of documents after the other, and keeps the k best of each item so far. The weakest scores it starts with
are those of a 64th of the documents, searched before all of them: a k-th score among some documents is
never above that among all. Scores are whole numbers, so rankings do not depend on batches, tasks or order.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import small_batches
from tidewatch.plans.staging import staged

# Bytes that are part of a term stay, A-Z in lower case; all others become blanks. Bytes from 0x80 on
# belong to characters beyond ASCII, which are all part of a term.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
# Fixed values of the score.
SCALE, TF_SCALE, LENGTH_SCALE, LENGTH_SHARE = 1_000_000_000, 1_000, 8, 75
# Whole numbers up to here are exact in doubles.
_EXACT = 1 << 53
_PILOT = 64


@dataclass(frozen=True)
class RankParams:
    """``top`` documents per item. Items are taken in blocks of about ``block_terms`` different terms,
    which bounds what a task holds of them; a batch of documents has ``cells`` entries, ``leaf`` documents
    make up the lowest node, ``fan`` nodes the next, and documents are put side by side by ``features`` terms."""

    top: int = 10
    block_terms: int = 50_000
    cells: int = 1 << 23
    leaf: int = 16
    fan: int = 8
    features: int = 256


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text."""
    return text.translate(_TERM_BYTES).split() if text else []


# Items -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    """Items to search for at a time: ids, counts of their terms, and the vocabulary."""

    ids: list = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)


def item_blocks(items: DataFrame, params: RankParams) -> Iterator[Block]:
    """Blocks of items, one partition of the items at a time. Items without a term are left out."""
    block = Block()
    for item_id, text in items.select("item_id", F.col("text").cast("binary")).toLocalIterator():
        found = Counter(terms(text))
        if not found:
            continue
        if block.ids and len(block.vocabulary) + len(found) > params.block_terms:
            yield block
            block = Block()
        for term in found:
            block.vocabulary.setdefault(term, len(block.vocabulary))
        block.ids.append(item_id)
        block.counts.append(found)
    if block.ids:
        yield block


@dataclass(frozen=True)
class Node:
    """A node over items: its terms with their largest weights, its items, and the nodes below."""

    terms: np.ndarray
    weights: np.ndarray
    items: np.ndarray
    below: list[Node]


def side_by_side(x: np.ndarray, smallest: int) -> np.ndarray:
    """An order of the rows of ``x`` that puts like rows together: halves by the column that differs most."""
    order = np.arange(len(x))
    open_ = [(0, len(x))]
    while open_:
        first, last = open_.pop()
        if last - first <= smallest:
            continue
        part = x[order[first:last]]
        spread = part.var(axis=0)
        if not len(spread) or not spread.max() > 0:
            continue
        order[first:last] = order[first:last][np.argsort(part[:, spread.argmax()], kind="stable")]
        middle = (first + last) // 2
        open_ += [(first, middle), (middle, last)]
    return order


def item_tree(weighted: list[tuple[np.ndarray, np.ndarray]], params: RankParams) -> Node:
    """The hierarchy over items, given the terms of each and their weights."""
    width = 1 + max((int(t.max()) for t, _ in weighted if len(t)), default=0)
    squares = np.zeros(width)
    for t, w in weighted:
        squares[t] += w.astype(float) ** 2
    chosen = np.argsort(-squares, kind="stable")[: params.features]
    place = np.full(width, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(weighted), len(chosen)), np.float32)
    for row, (t, w) in zip(x, weighted):
        known = place[t] >= 0
        row[place[t][known]] = w[known]
    nodes = [Node(*weighted[i], np.array([i]), []) for i in side_by_side(x, 2)]
    while len(nodes) > 1:
        nodes = [_joined(nodes[i : i + params.fan]) for i in range(0, len(nodes), params.fan)]
    return nodes[0]


def _joined(nodes: list[Node]) -> Node:
    every = np.concatenate([n.terms for n in nodes])
    found, at = np.unique(every, return_inverse=True)
    weights = np.zeros(len(found), nodes[0].weights.dtype)
    np.maximum.at(weights, at, np.concatenate([n.weights for n in nodes]))
    return Node(found, weights, np.concatenate([n.items for n in nodes]), nodes)


# Documents ---------------------------------------------------------------------------------------

_ROWS = "doc_id long, n long, terms array<int>, counts array<int>"
_ROW_TYPES = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
)


def term_rows(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with a term: the number of its terms, and those of the vocabulary with their counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, places, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms(text)
                if found:
                    known = [(vocabulary[t], c) for t, c in Counter(found).items() if t in vocabulary]
                    ids.append(doc_id)
                    sizes.append(len(found))
                    places.append([t for t, _ in known])
                    counts.append([c for _, c in known])
            arrays = [pa.array(v, f.type) for v, f in zip((ids, sizes, places, counts), _ROW_TYPES)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_ROW_TYPES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(counted, _ROWS)


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def shares(n: np.ndarray, counts: np.ndarray, documents: int, every: int) -> np.ndarray:
    """What a term occurring ``counts`` times gets in a document of ``n`` terms."""
    lengths, at = np.unique(n, return_inverse=True)
    m = np.array([100 - LENGTH_SHARE + (LENGTH_SHARE * int(x) * documents) // every for x in lengths], np.int64)
    return (SCALE * counts) // (TF_SCALE * counts + LENGTH_SCALE * m[at])


class Rankings:
    """The best documents of each item so far."""

    def __init__(self, items: int, top: int, least: np.ndarray):
        self.top, self.least = top, least.copy()
        # Per item rows of (score, 1 if there is no id, id).
        self.best = [np.empty((0, 3), np.int64) for _ in range(items)]

    def add(self, item: int, found: np.ndarray) -> None:
        rows = np.concatenate([self.best[item], found])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))][: self.top]
        self.best[item] = rows
        if len(rows) == self.top:
            self.least[item] = max(self.least[item], rows[-1, 0])


class Documents:
    """The hierarchy over a batch of documents: matrices of largest shares, from documents up."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, places: np.ndarray, share: np.ndarray, weights, params):
        width = len(weights)
        size = -(-len(ids) // params.leaf) * params.leaf
        row = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
        matrix = np.zeros((size, width), np.int32)
        matrix[row, places] = share
        squares = np.bincount(places, weights=(share * weights[places].astype(float)) ** 2, minlength=width)
        chosen = np.argpartition(-squares, min(params.features, width) - 1)[: params.features]
        order = side_by_side((matrix[: len(ids), chosen] * weights[chosen]).astype(np.float32), params.leaf)
        matrix[: len(ids)] = matrix[order]
        self.ids = ids[order]
        self.fans, self.levels = [1], [matrix]
        fan = params.leaf
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            spare = -len(below) % fan
            padded = np.concatenate([below, np.zeros((spare, width), np.int32)]) if spare else below
            self.levels.append(padded.reshape(-1, fan, width).max(axis=1))
            self.fans.append(fan)
            fan = params.fan

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        children = (nodes[:, None] * self.fans[level] + np.arange(self.fans[level])).ravel()
        return children[children < len(self.levels[level - 1])]

    def bounds(self, level: int, nodes: np.ndarray, of: Node) -> np.ndarray:
        """The product of the node of items with nodes of documents; exact scores at level 0."""
        return self.levels[level][nodes[:, None], of.terms] @ of.weights


def search(items: Node, docs: Documents, rankings: Rankings) -> None:
    """Open the pairs of nodes that may hold a ranked document."""
    top = len(docs.levels) - 1
    open_ = [(items, top, np.arange(len(docs.levels[top])))]
    while open_:
        node, level, nodes = open_.pop()
        least = max(rankings.least[node.items].min(), 1)
        bounds = docs.bounds(level, nodes, node)
        kept = bounds >= least
        nodes, bounds = nodes[kept], bounds[kept]
        if not len(nodes):
            continue
        if node.below:
            if level > 1:
                level, nodes = level - 1, docs.below(level, nodes)
            open_ += [(child, level, nodes) for child in node.below]
        elif level > 1:
            open_.append((node, level - 1, docs.below(level, nodes)))
        else:
            _ranked(node, level, nodes, bounds, docs, rankings)


def _ranked(node: Node, level: int, nodes: np.ndarray, bounds, docs: Documents, rankings: Rankings) -> None:
    """Exact scores of one item, the most promising nodes first, so that the others may be left out."""
    item = int(node.items[0])
    order = np.argsort(-bounds, kind="stable")
    nodes, bounds = nodes[order], bounds[order]
    at, take = 0, 4
    while at < len(nodes) and bounds[at] >= rankings.least[item]:
        rows = nodes[at : at + take]
        if level:
            rows = docs.below(level, rows)
        rows = rows[rows < len(docs.ids)]
        scores = docs.bounds(0, rows, node)
        kept = scores >= max(rankings.least[item], 1)
        found = np.column_stack([scores[kept].astype(np.int64), docs.ids[rows[kept]]])
        rankings.add(item, found)
        at, take = at + take, take * 2


# Search over a table -----------------------------------------------------------------------------

_FOUND = "item int, doc_id long, score long"
_FOUND_TYPES = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searcher(tree: Node, weights: np.ndarray, least: np.ndarray, documents: int, every: int, params) -> Callable:
    size = max(params.leaf, min(4_096, params.cells // len(weights)))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rankings = Rankings(len(least), params.top, least)
        # Batches are cut and put together to ``size`` documents.
        waiting, rows = [], 0

        def flush() -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            ids = table.column("doc_id").combine_chunks()
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = np.column_stack([missing.astype(np.int64), ids.fill_null(0).to_numpy()])
            lists = table.column("terms").combine_chunks()
            ends = np.cumsum(lists.value_lengths().to_numpy())
            places = lists.flatten().to_numpy()
            counts = table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            n = np.repeat(table.column("n").to_numpy(), np.diff(ends, prepend=0))
            if len(places):
                share = shares(n, counts, documents, every)
                search(tree, Documents(ids, ends, places, share, weights, params), rankings)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - rows)
                waiting.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == size:
                    flush()
                    waiting, rows = [], 0
        if rows:
            flush()
        for item, best in enumerate(rankings.best):
            if len(best):
                ids = pa.array(best[:, 2], mask=best[:, 1] == 1)
                columns = [pa.array([item] * len(best), pa.int32()), ids, pa.array(best[:, 0])]
                yield pa.RecordBatch.from_arrays(columns, schema=_FOUND_TYPES)

    return searched


def _best(found: DataFrame, top: int) -> DataFrame:
    """The best of each item over all tasks: first in 32 parts, so that an item is not one task's work."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(32))
    few = found.withColumn("_part", part)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order)))
    few = few.where(F.col("rank") <= top).drop("_part")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= top)


def _ranked_block(docs: DataFrame, block: Block, params: RankParams) -> DataFrame:
    spark = docs.sparkSession
    rows = staged(term_rows(docs, block.vocabulary), "terms")
    documents, every = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = "item_id long, rank int, doc_id long, score long"
    if not documents:
        return spark.createDataFrame([], schema)
    # One row per term of the block.
    holding = np.zeros(len(block.vocabulary), np.int64)
    for term, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        holding[term] = n
    weights = np.array([term_weight(documents, int(n)) for n in holding], np.int64)
    weighted = []
    for counts in block.counts:
        places = np.array([block.vocabulary[t] for t in counts], np.int64)
        weighted.append((places, weights[places] * np.array(list(counts.values()), np.int64)))
    largest = max(int(w.sum()) for _, w in weighted) * (SCALE // TF_SCALE)
    exact = np.float64 if largest < _EXACT else np.int64
    tree = item_tree([(t, w.astype(exact)) for t, w in weighted], params)

    def searched(rows: DataFrame, least: np.ndarray) -> DataFrame:
        return rows.mapInArrow(_searcher(tree, weights, least, documents, every, params), _FOUND)

    least = np.zeros(len(weighted), np.int64)
    pilot = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(_PILOT)) == 0)
    weakest = _best(searched(pilot, least), params.top).where(F.col("rank") == params.top)
    for item, score in weakest.select("item", "score").collect():
        least[item] = score
    ids = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
    found = _best(searched(rows, least), params.top).join(ids, "item")
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, params: RankParams = RankParams()) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above 0.

    Equal scores are ranked by ascending ``doc_id``, a document without an id after the others.
    Repeated documents each take a rank; a repeated item has its ranking twice. Items and documents without a term have
    no rows, nor have items whose terms are in no document. Other columns play no part. Every document is searched for every
    item. Of the items, a block at a time is brought to the driver and sent to the tasks.
    """
    small_batches(docs.sparkSession)
    found = [_ranked_block(docs, block, params) for block in item_blocks(items, params)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(staged(more, "ranked"))
    return whole
