"""Near-duplicate documents by word shingles: a multi-index Hamming join of MinHash signatures.

A document is the set of its distinct 5-word shingles. Its signature holds ``positions`` MinHash
values of 16 bits. Two documents of similarity t differ in a position with probability 1 - t, so
all but a share ``MISS`` of the pairs at the threshold lie within ``distance`` differing positions.
The signature is cut into so many chunks that, by the pigeonhole principle, two signatures within
that distance have a chunk with at most one differing position. Every chunk is looked up once
for each place of that one error, with the place left out of the key; all pairs within the
distance therefore meet under a key, and none is lost.

Documents with equal sets become one class first, so groups of copies cost one row. Within a key
no pairs are listed: in rounds of 1, 8, 64 ... hubs a key, hubs are compared with the members of
other components, and confirmed links merge components. A hub then leaves the key, and a key is
done when one component is left in it. Hubs are the members that meet most others, of the components
smallest in the key first; so a large group of near copies needs about as many comparisons
as it has members, and a few strangers among them cost one round.
Beyond the first round, a pair that shares several keys counts under the first of them only, which both signatures tell;
so a key is done when its own pairs are, and the pairs of a group of alike texts are spread over its keys.
Of the pairs that meet, those whose sketches (``sketch`` further MinHash values of one bit, with a like
bound on the differing ones) agree are compared on the full shingle sets; every link is confirmed so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.components import components, relabel
from tidewatch.llm.tables import small_batches
from tidewatch.llm.words import constants, mix, shingle_hashes, word_hashes
from tidewatch.plans.staging import staged

MISS = 1e-5
_CELLS = 1 << 15
_LANES, _WIDTH = 3, 21  # positions to a long, and the bits each has there
_PLACES = 64  # the low bits of a key tell the place that it leaves out
_MORE_HUBS, _MOST_HUBS = 8, 4096  # hubs of a key in a round, which a task holds; what is left takes more rounds
_PAIRS = 1 << 16  # compared at once


@dataclass(frozen=True)
class NearParams:
    """Link texts with ``100 * intersection >= percent * union``."""

    percent: int = 80
    shingle: int = 5
    positions: int = 63  # a multiple of _LANES, at most _PLACES
    sketch: int = 1024  # a multiple of 64

    @property
    def distance(self) -> int:
        """Positions in which signatures may differ."""
        return self._within(self.positions, 1 - self.percent / 100)

    @property
    def sketch_distance(self) -> int:
        """Bits in which sketches may differ: at the threshold, half of the differing values show."""
        return self._within(self.sketch, (1 - self.percent / 100) / 2)

    @staticmethod
    def _within(n: int, q: float) -> int:
        """Of ``n`` values that differ with probability ``q``, how many may; the tail is below ``MISS``."""
        tail = 1.0
        for r in range(n + 1):
            tail -= math.comb(n, r) * q**r * (1 - q) ** (n - r)
            if tail <= MISS:
                return r
        return n

    @property
    def chunks(self) -> list[list[int]]:
        """The positions of each chunk: more than distance / 2 chunks, so one has at most one error."""
        count = self.distance // 2 + 1
        return [[int(i) for i in part] for part in np.array_split(np.arange(self.positions), count)]


def _sets(words: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes, at = shingle_hashes(words, offsets, size)
    for lo, hi in zip(at[:-1], at[1:]):
        found = np.sort(hashes[lo:hi])
        yield found[np.concatenate([[True], found[1:] != found[:-1]])] if hi > lo else found


def _digest(found: np.ndarray) -> bytes:
    """128 bits of a set."""
    a = mix(found).sum(dtype=np.uint64)
    b = mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(found))
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _minhashes(cells: np.ndarray, starts: np.ndarray, count: int, bits: int, lanes: int, seed: int) -> np.ndarray:
    """``count`` MinHash values of ``bits`` bits for each set, ``lanes`` to a long; the sets lie one after the other."""
    width = 64 // lanes
    factors, masks = constants(count, seed), constants(count, seed + 1)
    out = np.zeros((len(starts), count // lanes), np.uint64)
    for i in range(count):
        least = np.minimum.reduceat((cells ^ masks[i]) * factors[i], starts)
        out[:, i // lanes] |= (mix(least) >> np.uint64(64 - bits)) << np.uint64(width * (i % lanes))
    return out.view(np.int64)


def signatures(docs: DataFrame, params: NearParams) -> DataFrame:
    """``doc_id, n_shingles, digest, signature`` of each row; the digest stands for the set."""
    size, positions = params.shingle, params.positions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = word_hashes(batch.column("text"))
            counts, digests, pending, made = [], [], [], []

            def flush() -> None:
                """Signatures of the pending sets, few enough to stay in the processor's cache."""
                if pending:
                    cells = np.concatenate(pending)
                    starts = np.concatenate([[0], np.cumsum([len(s) for s in pending])[:-1]])
                    made.append(_minhashes(cells, starts, positions, 16, _LANES, 3).ravel())
                pending.clear()

            waiting = 0
            for found in _sets(words, offsets, size):
                counts.append(len(found))
                digests.append(_digest(found))
                if len(found):
                    pending.append(found)
                waiting += len(found)
                if waiting > _CELLS:
                    flush()
                    waiting = 0
            flush()
            ends = np.cumsum(np.concatenate([[0], np.array(counts) > 0])) * (positions // _LANES)
            values = np.concatenate(made) if made else np.zeros(0, np.int64)
            signed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), signed],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature array<bigint>")


def chunk_keys(classes: DataFrame, params: NearParams) -> DataFrame:
    """``key, node``: every chunk of a signature with each place of one allowed error left out.

    ``key % _PLACES`` is the place.
    """
    positions, chunks = params.positions, params.chunks
    factors = constants(positions, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("signature").flatten().to_numpy().view(np.uint64).reshape(-1, positions // _LANES)
            lanes = [(packed >> np.uint64(_WIDTH * lane)) & np.uint64(0xFFFF) for lane in range(_LANES)]
            sig = np.stack(lanes, axis=2).reshape(-1, positions) + np.uint64(1)
            terms = mix(sig * factors)
            keys = np.empty_like(terms)
            for chunk in chunks:
                whole = terms[:, chunk].sum(axis=1, dtype=np.uint64)
                for place in chunk:
                    keys[:, place] = mix(whole - terms[:, place] + factors[place]) & ~np.uint64(_PLACES - 1) | np.uint64(place)
            nodes = np.repeat(batch.column("node").to_numpy(), positions)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(nodes)], names=["key", "node"])

    return classes.select("node", "signature").mapInArrow(run, "key long, node long")


def _in_first_key(a: np.ndarray, b: np.ndarray, keys: np.ndarray, params: NearParams) -> np.ndarray:
    """Whether each key is the first that the signatures of its pair share.

    That is the place of the error in the first chunk with at most one, or the chunk's first place.
    """
    starts = np.array([chunk[0] for chunk in params.chunks])
    errors = np.zeros((len(a), len(starts)), np.int64)
    for lane in range(_LANES):  # the positions of a lane are every third one
        mask = np.uint64(0xFFFF << (_WIDTH * lane))
        differs = (a ^ b) & mask != 0
        for c, chunk in enumerate(params.chunks):
            errors[:, c] += differs[:, [at // _LANES for at in chunk if at % _LANES == lane]].sum(axis=1)
    first = np.argmax(errors <= 1, axis=1)
    slot = (keys & np.int64(_PLACES - 1)).astype(np.int64)
    inside = np.searchsorted(starts, slot, "right") - 1 == first
    return inside & ((errors[np.arange(len(a)), first] == 1) | (slot == starts[first]))


def _met(rows: DataFrame, hubs: int, params: NearParams) -> DataFrame:
    """The pairs ``a, b`` of a hub and a later member of its key, of different components, whose sketches agree.

    The rows of a key follow each other in one task, which holds a batch and the hubs of one key.
    Beyond one hub a key, a pair counts under its first key only.
    """
    fields = ["key", "node", "n_shingles", "root", "place", "signature", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, w) if w else 0, np.int64) for w in (0, 0, 0, 0, 0, params.positions // _LANES, params.sketch // 64)]
        for batch in batches:
            columns = [batch.column(c) for c in fields]
            flat = [c.to_numpy() for c in columns[:5]] + [c.flatten().to_numpy().reshape(len(c), -1) for c in columns[5:]]
            if not batch.num_rows:
                continue
            old = len(held[0])
            if old and held[0][0] != flat[0][0]:
                held, old = [h[:0] for h in held], 0
            flat = [np.concatenate([h, f]) for h, f in zip(held, flat)]
            key, node, size, root, place, signature, sketch = flat
            signature, sketch = signature.view(np.uint64), sketch.view(np.uint64)
            new = np.concatenate([[True], key[1:] != key[:-1]])
            start = np.flatnonzero(new)[np.cumsum(new) - 1]
            many = np.minimum(place - 1, hubs).astype(np.int64)
            many[:old] = 0  # met among themselves before
            ends = np.cumsum(many)
            lo = 0
            while lo < len(key):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - many[lo] + _PAIRS, "right")))
                b = np.repeat(np.arange(lo, hi), many[lo:hi])
                a = start[b] + np.arange(len(b)) - np.repeat(ends[lo:hi] - many[lo:hi] - (ends[lo] - many[lo]), many[lo:hi])
                lo = hi
                x, y = size[a], size[b]
                good = (root[a] != root[b]) & (100 * np.minimum(x, y) >= params.percent * np.maximum(x, y))
                a, b = a[good], b[good]
                good = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64) <= params.sketch_distance
                a, b = a[good], b[good]
                if hubs > 1:  # a single hub meets each member once, which links most of a group at once
                    good = _in_first_key(signature[a], signature[b], key[b], params)
                    a, b = a[good], b[good]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])
            last = slice(start[-1], min(len(key), start[-1] + hubs))
            held = [f[last].copy() for f in flat]

    sorted_rows = rows.select(fields).repartition("key").sortWithinPartitions("key", "place")
    return sorted_rows.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame, params: NearParams) -> DataFrame:
    """``node, shingles, sketch`` of the wanted classes (``node, doc_id, digest``), from the whole texts."""
    size, count = params.shingle, params.sketch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = word_hashes(batch.column("text"))
            sets = list(_sets(words, offsets, size))
            same = [_digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist())]
            sets = [s for s, ok in zip(sets, same) if ok]
            nodes = [n for n, ok in zip(batch.column("node").to_pylist(), same) if ok]
            sketches: list = []
            ends = np.cumsum([0] + [len(s) for s in sets])
            first = 0
            while first < len(sets):  # as many at once as stay in the processor's cache
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + _CELLS)))
                cells = np.concatenate(sets[first:last])
                found = _minhashes(cells, ends[first : min(last, len(sets))] - ends[first], count, 1, 64, 8)
                sketches += found.tolist()
                first = last
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes, pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                names=["node", "shingles", "sketch"],
            )

    rows = docs.select("doc_id", "text").join(wanted, "doc_id").select("node", "text", "digest")
    return rows.mapInArrow(run, "node long, shingles binary, sketch array<bigint>").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest doc_id reachable over links, ``kept`` tells whether it is
    the row's own. A text without words has no set and no link. Rows that repeat a doc_id with
    the same text are alike and all kept or all dropped. A row without doc_id gets the component
    of its equals that have one, else null, and then is kept. Other columns are ignored.
    Runs jobs at once and keeps small tables below ``spark.checkpoint.dir``.
    """
    small_batches(docs.sparkSession)
    rows = staged(signatures(docs, params), "signatures")
    classes = (
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = staged(classes, "classes")
    roots = _roots(docs, classes, params)
    labelled = classes.select("digest", "doc_id", "node", F.col("node").alias("root"))
    labelled = relabel(labelled, roots, "root") if roots is not None else labelled
    smallest = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = labelled.select("digest", "root").join(smallest, "root").select("digest", "component_id")
    linked = rows.join(found, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return linked.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def _roots(docs: DataFrame, classes: DataFrame, params: NearParams) -> DataFrame | None:
    """``node, root`` of the classes that are linked to others."""
    keys = chunk_keys(classes, params)
    shared = keys.groupBy("key").count().where("count > 1")
    members = staged(keys.join(shared, "key"), "members")
    weights = members.groupBy("node").agg(F.sum(F.col("count") - 1).alias("weight"))
    met = staged(classes.join(weights, "node"), "met")
    sets = staged(_full_sets(docs, met.select("node", "doc_id", "digest"), params), "sets")
    known = met.select("node", "n_shingles", "weight", "signature").join(sets.select("node", "sketch"), "node")
    members = members.select("key", "node").join(known, "node")

    of_key = Window.partitionBy("key")
    same = F.count("*").over(Window.partitionBy("key", "root"))
    place = F.row_number().over(of_key.orderBy("_same", F.desc("weight"), "node"))
    roots, hubs_of_key = None, 1
    while True:
        rows = members.withColumn("root", F.col("node"))
        if roots is not None:
            rows = relabel(rows, roots, "root")
        rows = rows.select(
            "*", same.alias("_same"), F.min("root").over(of_key).alias("_lo"), F.max("root").over(of_key).alias("_hi")
        )
        rows = rows.where(F.col("_lo") != F.col("_hi")).withColumn("place", place).drop("_same", "_lo", "_hi")
        rows = staged(rows, "members")
        if rows.isEmpty():
            return roots
        close = _met(rows, hubs_of_key, params)
        for side in ("a", "b"):
            close = close.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}")), side)
        links = staged(_confirmed(close, params.percent), "links")
        if not links.isEmpty():
            roots = _merged(roots, links)
        # The hubs have met all others of their keys that they have to meet there.
        members = rows.where(F.col("place") > hubs_of_key).drop("root", "place")
        hubs_of_key = min(hubs_of_key * _MORE_HUBS, _MOST_HUBS)


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The roots after new links."""
    if roots is None:
        return components(links)
    moved = components(relabel(relabel(links, roots, "a"), roots, "b"))
    known = relabel(roots, moved, "root")
    return staged(known.union(moved.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")


def deduplicate(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one doc_id per component, and rows without doc_id.

    A doc_id that several rows bear stays if any of them is kept.
    """
    found = near_duplicates(docs, params).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("_kept"))
    return docs.join(found.where("not _kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
