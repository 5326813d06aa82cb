"""Language-model scores by a weighted backoff automaton.

The model is learnt from the training rows in passes over all of them. Unigrams have add-one
probabilities. An n-gram of two or more tokens is kept if it occurs at least ``min_count`` times in
the training rows, whatever their size; so are then all its parts. Kept n-grams get discounted
relative frequencies, and a context passes the rest on to the next shorter one (backoff).

The automaton's states are the contexts that have kept n-grams, and the empty one. A kept
n-gram is an arc, weighted with its log probability; a failure arc leads from a state to that of its
context without the first token, weighted with the log backoff. The weights are pushed along the
failure arcs: every n-gram of a text adds its backoff, and a kept one also what its arc has more
than the way over the failure arcs. A text's score is then a sum of independent weights of its n-grams.

The texts are cut into chunks of about ``_CHUNK`` tokens and written once, as numbers of words. A
chunk asks for what it needs of each of its different n-grams, and gets it, in two rounds: first the
places in all training rows, then the sums over the n-grams that go on from a context. A
hash of the n-gram deals the questions to slots; a slot adds up what the chunks say and answers each. A chunk
has the context and the rest of each n-gram itself, and works the weights out from whole numbers. So no table of the model
with its contexts is shuffled or written. Questions and answers are packed, n-grams in sorted order.

Words are numbered by frequency, at most ``numbered`` of them, which are broadcast; the others go by
their 64-bit hash. The numbers only make the questions small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import small_batches
from tidewatch.llm.words import constants, mix, word_hashes
from tidewatch.plans.staging import staged, staged_by

END = np.uint64(0x0E0D)  # the token after the last word


@dataclass(frozen=True)
class LmParams:
    order: int = 3
    #: Least number of times that a kept n-gram occurs.
    min_count: int = 2
    #: Least share of the training tokens of n-grams and of tokens that the model holds itself.
    min_share: float = 1e-5
    common_share: float = 1e-6
    discount: float = 0.75
    #: Most words that have numbers.
    numbered: int = 1 << 20


@dataclass
class LmModel:
    """Totals, and the frequent part of the automaton; common tokens are numbered by the sorted ``tokens``."""

    total: int = 0
    vocabulary: int = 0
    order: int = 3
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    token_backs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Hashes of frequent n-grams in order, what each adds as an arc, and its backoff.
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    adds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    backs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Hashes of the numbered words, that of number 1 first, and what the model was fitted with.
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    spread: np.ndarray = field(default_factory=lambda: np.ones(1, np.uint64))
    params: LmParams = LmParams()

    @property
    def arcs(self) -> dict[int, tuple[float, float]]:
        return dict(zip(self.grams.tolist(), zip(self.adds.tolist(), self.backs.tolist())))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-one probabilities of tokens with these counts."""
        return np.log10((counts + 1.0) / (self.total + self.vocabulary + 1))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of tokens, -1 for those that are not common."""
        return place(self.tokens, hashes)

    def traverse(self, numbers: list[int], weights: list[float]) -> float:
        """Weights of one text's tokens by the frequent part, without the unigram weight of those numbered -1."""
        numbers, end = np.array(numbers, np.int64), len(numbers)
        known = numbers >= 0
        hashes = np.zeros(end, np.uint64)
        hashes[known] = self.tokens[numbers[known]]
        score = float(np.array(weights)[numbers[known]].sum()) + float(self.token_backs[numbers[:-1][known[:-1]]].sum())
        for size in range(2, self.order + 1):
            last, keys = gram_keys(hashes, np.array([0, end]), size)
            at = place(self.grams, keys)
            last, at = last[at >= 0], at[at >= 0]
            score += float(self.adds[at].sum() + self.backs[at[last < end - 1]].sum())
        return score


def place(kept: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys among the sorted ``kept``, -1 for others."""
    if not len(kept):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(kept, keys), len(kept) - 1)
    return np.where(kept[at] == keys, at, -1)


def gram_keys(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The last place and the hash of every n-gram of ``size`` tokens within a text; a token is its own hash."""
    inside = np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets))
    last = np.flatnonzero(inside >= size - 1)
    if size == 1:
        return last, hashes
    out = np.full(len(last), size, np.uint64)
    for j, factor in enumerate(constants(size, 8)):
        out += hashes[last - (size - 1) + j] * factor
    return last, mix(out)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, and their offsets."""
    hashes, offsets = word_hashes(column)
    ends = np.insert(hashes, offsets[1:], END)
    return ends, offsets + np.arange(len(offsets))


_CHUNK, _SLOT = 600_000, 1 << 21  # tokens of a chunk; n-grams that the chunks ask a slot for
_ROWS = 500  # of an Arrow batch of texts
_CODEC = pa.Codec("zstd", 1)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers from 0 on, byte by byte of all numbers, compressed."""
    head, body = [len(arrays)], []
    for a in arrays:
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        head += [len(a), width]
        a = a.astype("<u8").view(np.uint8)
        body += [a[k::8].tobytes() for k in range(width)]
    raw = np.array(head, "<u4").tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(_CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little")), np.uint8)
    many = int(raw[:4].view("<u4")[0])
    head = raw[4 : 4 + 8 * many].view("<u4").reshape(many, 2).tolist()
    at, out = 4 + 8 * many, []
    for size, width in head:
        wide = np.zeros(8 * size, np.uint8)
        for k in range(width):
            wide[k::8] = raw[at : at + size]
            at += size
        out.append(wide.view("<u8"))
    return out


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, a place of each, and the number that each key has among them."""
    many = max(1, len(keys))
    if len(keys) and int(keys.max()) < (1 << 64) // many - 1:  # key and place in one number: that sorts faster
        ranked = np.sort(keys.astype(np.uint64) * np.uint64(many) + np.arange(many, dtype=np.uint64))
        whole = ranked // np.uint64(many)
        order = (ranked - whole * np.uint64(many)).astype(np.int64)
        ranked = whole.astype(keys.dtype)
    else:
        order = np.argsort(keys)
        ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], order[new], inverse


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for column, factor in zip(columns, constants(len(columns), 8)):
        out += column * factor
    return mix(out)


@dataclass
class Grams:
    """The different n-grams of one size in a chunk, in order of their codes."""

    columns: list[np.ndarray]  # the codes, token by token
    last: np.ndarray  # places of the chunk's tokens at which the n-grams end
    number: np.ndarray  # the number of the n-gram at each of these places
    context: np.ndarray  # numbers of the n-grams without the last and without the first token
    tail: np.ndarray

    def dealt(self, slots: int, spread: np.ndarray, wanted: np.ndarray | None = None) -> list[np.ndarray]:
        """The numbers of the (wanted) n-grams that each slot answers for.

        N-grams of one context go to one slot, unless all its tokens are frequent: then to as many as ``spread`` has for
        the rarest of them (from code 0 on; 1 for the others).
        """
        *context, token = self.columns
        if context:
            many = np.full(len(token), len(spread) and spread.max(), np.uint64)
            for column in context:
                frequent = column < len(spread)
                many[~frequent] = 1
                many[frequent] = np.minimum(many[frequent], spread[column[frequent].astype(np.int64)])
            hashes = _hash(context)
            some = many > 1
            hashes[some] = mix(hashes[some] + mix(token[some]) % many[some])
        else:
            hashes = _hash([token])
        slot = (hashes % np.uint64(slots)).astype(np.int64)
        numbers = np.arange(len(slot)) if wanted is None else np.flatnonzero(wanted)
        slot = slot[numbers]
        numbers = numbers[np.argsort(slot.astype(np.uint16) if slots <= 1 << 16 else slot, kind="stable")]
        return np.split(numbers, np.cumsum(np.bincount(slot, minlength=slots))[:-1])

    def question(self, numbers: np.ndarray, sums: list[np.ndarray]) -> list[np.ndarray]:
        """The contexts of n-grams, how many go on from each, their last tokens as steps within a context, and ``sums``."""
        *context, token = (c[numbers] for c in self.columns)
        new = np.zeros(len(token), bool)
        new[:1] = True
        for column in context:
            new[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(new)
        steps = np.diff(token, prepend=np.uint64(0))
        steps[first] = token[first]
        columns = [c[first] for c in context]
        if columns:
            columns[0] = np.diff(columns[0], prepend=np.uint64(0))
        return [*columns, np.diff(np.append(first, len(token))), steps, *(s[numbers] for s in sums)]


def columns_of(question: list[np.ndarray]) -> list[np.ndarray]:
    """The columns that were asked for, from the arrays of a question before its sums."""
    *context, goes_on, steps = question
    goes_on = goes_on.astype(np.int64)
    if context:
        context[0] = np.cumsum(context[0], dtype=np.uint64)
    token = np.cumsum(steps, dtype=np.uint64)
    first = np.cumsum(goes_on) - goes_on
    token -= np.repeat(token[first] - steps[first], goes_on)
    return [*(np.repeat(c, goes_on) for c in context), token]


@dataclass
class Chunk:
    """Tokens of some rows as places among the sorted ``codes``, and which rows are training rows."""

    codes: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray
    trains: np.ndarray

    def packed(self) -> bytes:
        return pack([np.diff(self.codes, prepend=np.uint64(0)), self.ids, self.sizes, self.trains])

    @classmethod
    def read(cls, blob: bytes) -> Chunk:
        codes, ids, sizes, trains = unpack(blob)
        return cls(np.cumsum(codes, dtype=np.uint64), ids.astype(np.int64), sizes.astype(np.int64), trains > 0)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def grams(self, order: int) -> list[Grams]:
        ends = np.cumsum(self.sizes)
        inside = np.arange(len(self.ids)) - np.repeat(ends - self.sizes, self.sizes)
        none = np.zeros(0, np.int64)
        out = [Grams([self.codes], np.arange(len(self.ids)), self.ids, none, none)]
        before = self.ids
        for size in range(2, order + 1):
            last = np.flatnonzero(inside >= size - 1)
            keys, at, number = _different(before[last - 1] * len(self.codes) + self.ids[last])
            context = keys // max(1, len(self.codes))
            token = keys - context * len(self.codes)
            columns = [*(c[context] for c in out[-1].columns), self.codes[token]]
            out.append(Grams(columns, last, number, context, before[last[at]]))
            before = np.zeros(len(self.ids), np.int64)
            before[last] = number
        return out


def _numbering(docs: DataFrame, params: LmParams) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of frequent words, the most frequent first, over how many slots each spreads what follows it, and about how many tokens there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0
        for batch in batches:
            held.append(word_hashes(batch.column("text"))[0])
            room += len(held[-1])
            if room > 2 * _CHUNK:
                yield counted(held)
                held, room = [], 0
        if room:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, many = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys[many > 1].view(np.int64)), pa.array(many[many > 1])], names=["key", "n"])

    words = staged(docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    # Powers of two of the counts, from the largest on, as far as the words are not too many.
    powers = words.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    least, many = 63, 0
    for r in sorted(powers, key=lambda r: -r.power):
        many += r.words
        if many > params.numbered:
            break
        least = r.power
    found = words.where(F.floor(F.log2("n")) >= least).toPandas().sort_values(["n", "key"], ascending=[False, True])
    many = found["n"].to_numpy().astype(np.int64) // (_SLOT // 4)
    # Nothing comes after the end token, code 0.
    spread = np.append(1, 1 + many[many > 0]).astype(np.uint64)
    return found["key"].to_numpy().astype(np.int64).view(np.uint64), spread, sum(r.n for r in powers)


def _chunks(docs: DataFrame, words: np.ndarray, training: Column, scored: bool, first: int = 0) -> DataFrame:
    """``chunk, tokens, n_tokens`` of rows with ``text``, and ``docs``, their other columns, if they are to be ``scored``.

    Chunks are numbered in steps of two from ``first`` on.
    """
    order = np.argsort(words)
    shared = docs.sparkSession.sparkContext.broadcast((words[order], order.astype(np.uint64) + np.uint64(1)))
    keep = [f for f in docs.schema if scored and f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() << 33) + first
        held, room = [], 0
        for batch in batches:
            hashes, offsets = _tokens(batch.column("text"))
            others = [batch.column(f.name) for f in keep]
            size = len(hashes) + sum(c.nbytes for c in others) // 8
            if held and room + size > _CHUNK:
                yield made(held, chunk)
                held, room, chunk = [], 0, chunk + 2
            room += size
            held.append((hashes, np.diff(offsets), batch.column("_trains").to_numpy(zero_copy_only=False), others))
        if held:
            yield made(held, chunk)

    def made(held: list[tuple], chunk: int) -> pa.RecordBatch:
        hashes, _, number = _different(np.concatenate([x[0] for x in held]))
        known, numbers = shared.value
        at = place(known, hashes)
        codes = np.where(at >= 0, numbers[at], hashes) if len(known) else hashes.copy()
        codes[hashes == END] = 0
        ranked = np.argsort(codes)
        ids = np.empty(len(codes), np.int64)
        ids[ranked] = np.arange(len(codes))
        sizes, trains = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        arrays = [pa.array([chunk]), pa.array([Chunk(codes[ranked], ids[number], sizes, trains).packed()], pa.binary()), pa.array([len(number)], pa.int64())]
        if scored:
            parts = [pa.StructArray.from_arrays([*others, pa.array(n)], names=[*(f.name for f in keep), "n_tokens"]) for _, n, _, others in held]
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(parts)))
        return pa.RecordBatch.from_arrays(arrays, names=["chunk", "tokens", "n_tokens", "docs"][: len(arrays)])

    inner = "".join(f"`{f.name}`: {f.dataType.simpleString()}, " for f in keep)
    rows = docs.select(*(f.name for f in keep), "text", F.coalesce(training, F.lit(False)).alias("_trains"))
    return rows.mapInArrow(run, "chunk long, tokens binary, n_tokens long" + f", docs array<struct<{inner}n_tokens: bigint>>" * scored)


def _written(chunks: DataFrame, tokens: int) -> tuple[DataFrame, int]:
    """The chunks, written in so many parts by their number that answers are joined without a shuffle of the chunks."""
    parts = max(1, tokens // _CHUNK)
    return staged_by(chunks, "chunks", "chunk", parts), parts


def _round(rows: DataFrame, ask: Callable, answer: Callable, slots: int, parts: int, name: str) -> DataFrame:
    """Deal what ``ask`` makes of a row of the chunks to the slots; a row for each chunk with the answers by slot, ``name``.

    ``ask`` yields the arrays of a question by slot; ``answer`` makes the arrays to send
    back out of the list of questions, and a total and a number of words of the slot.
    """

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [(slot, pack(arrays)) for slot, arrays in ask(row) if any(len(a) for a in arrays)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in found], pa.int32()), pa.array([row["chunk"]] * len(found), pa.int64()), pa.array([b for _, b in found], pa.binary())],
                    names=["slot", "chunk", "packed"],
                )

    def answered(group: pa.Table) -> pa.Table:
        told, total, words = answer([unpack(b) for b in group["packed"].to_pylist()])
        only = [0] * (len(told) - 1)  # once for the slot
        return pa.table(
            {
                "slot": group["slot"],
                "chunk": group["chunk"],
                "packed": pa.array([pack(t) for t in told], pa.binary()),
                "total": pa.array([total, *only], pa.int64()),
                "words": pa.array([words, *only], pa.int64()),
            }
        )

    needed = [c for c in rows.columns if c not in ("docs", "n_tokens")]
    questions = rows.select(*needed).mapInArrow(asked, "slot int, chunk long, packed binary")
    answers = questions.groupBy("slot").applyInArrow(answered, "slot int, chunk long, packed binary, total long, words long")
    by_chunk = answers.groupBy("chunk").agg(
        F.collect_list(F.struct("slot", "packed")).alias(name), F.sum("total").alias(f"{name}_total"), F.sum("words").alias(f"{name}_words")
    )
    return staged_by(by_chunk, name, "chunk", parts)


def _told(row: dict, name: str) -> dict[int, list[np.ndarray]]:
    return {x["slot"]: unpack(x["packed"]) for x in row[name] or []}


def _merged(questions: list[list[np.ndarray]], at: int, size: int, sums: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """A place of each different n-gram in the questions, the number of each, what the questions add up to, and where each question ends."""
    parts = [q[at : at + size + 1 + sums] for q in questions]
    columns = [np.concatenate(c) for c in zip(*(columns_of(p[: size + 1]) for p in parts))]
    keys, first, number = _different(_hash(columns))
    added = [np.bincount(number, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in range(size + 1, size + 1 + sums)]
    return first, number, added, np.cumsum([len(p[size]) for p in parts])[:-1]


class _Counts:
    """First round: the places of n-grams in the training rows."""

    def __init__(self, params: LmParams, slots: int, spread: np.ndarray):
        self.params, self.slots, self.spread = params, slots, spread

    def ask(self, row: dict) -> Iterator[tuple[int, list[np.ndarray]]]:
        chunk = Chunk.read(row["tokens"])
        training = np.repeat(chunk.trains, chunk.sizes)
        sizes = []
        for grams in chunk.grams(self.params.order):
            many = np.bincount(grams.number[training[grams.last]], minlength=len(grams.columns[0]))
            sizes.append((grams, grams.dealt(self.slots, self.spread), many))
        for slot in range(self.slots):
            yield slot, [a for grams, dealt, many in sizes for a in grams.question(dealt[slot], [many])]

    def answer(self, questions: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], int, int]:
        told: list[list[np.ndarray]] = [[] for _ in questions]
        total = words = at = 0
        for size in range(1, self.params.order + 1):
            first, number, (many,), ends = _merged(questions, at, size, 1)
            at += size + 2
            if size == 1:
                total, words = int(many.sum()), int((many > 0).sum())
            else:
                many[many < self.params.min_count] = 0
            # One chunk that has the n-gram speaks for it in the second round.
            speaks = np.zeros(len(number), np.int64)
            speaks[first] = 1
            for out, part in zip(told, np.split(many[number] * 2 + speaks, ends)):
                out.append(part)
        return told, total, words

    def read(self, row: dict, sizes: list[Grams]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The places of each n-gram of each size, 0 if it is not kept, and for which the chunk speaks."""
        told = _told(row, "counts")
        out = []
        for i, grams in enumerate(sizes):
            found = np.zeros(len(grams.columns[0]), np.int64)
            for slot, numbers in enumerate(grams.dealt(self.slots, self.spread)):
                if slot in told:
                    found[numbers] = told[slot][i]
            out.append((found >> 1, (found & 1 > 0) & (found > 1)))
        return out


class _Sums:
    """Second round: of each context, the number of kept n-grams that go on from it, and their places and those of their tails."""

    def __init__(self, counts: _Counts):
        self.counts, self.params, self.slots, self.spread = counts, counts.params, counts.slots, counts.spread

    def wanted(self, sizes: list[Grams], known: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        out = []
        for grams, (many, _) in zip(sizes[1:], known):
            goes_on = np.zeros(len(many), bool)
            goes_on[grams.context] = True
            out.append(goes_on & (many >= self.params.min_count))
        return out

    def ask(self, row: dict) -> Iterator[tuple[int, list[np.ndarray]]]:
        sizes = Chunk.read(row["tokens"]).grams(self.params.order)
        known = self.counts.read(row, sizes)
        asked = []
        for i, wanted in enumerate(self.wanted(sizes, known)):
            (many, speaks), after, below = known[i + 1], sizes[i + 1], known[i][0]
            context = after.context[speaks]
            values = (None, many[speaks], below[after.tail[speaks]])
            sums = [np.bincount(context, v, len(wanted)).astype(np.int64) for v in values]
            asked.append((sizes[i], sizes[i].dealt(self.slots, self.spread, wanted), sums))
        for slot in range(self.slots):
            yield slot, [a for grams, dealt, sums in asked for a in grams.question(dealt[slot], sums)]

    def answer(self, questions: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], int, int]:
        told: list[list[np.ndarray]] = [[] for _ in questions]
        at = 0
        for size in range(1, self.params.order):
            _, number, sums, ends = _merged(questions, at, size, 3)
            at += size + 4
            for total in sums:
                for out, part in zip(told, np.split(total[number], ends)):
                    out.append(part)
        return told, 0, 0

    def read(self, row: dict, sizes: list[Grams], known: list[tuple[np.ndarray, np.ndarray]]) -> list[list[np.ndarray]]:
        told = _told(row, "sums")
        out = []
        for i, (grams, wanted) in enumerate(zip(sizes, self.wanted(sizes, known))):
            sums = [np.zeros(len(wanted), np.int64) for _ in range(3)]
            for slot, numbers in enumerate(grams.dealt(self.slots, self.spread, wanted)):
                if slot in told:
                    for total, part in zip(sums, told[slot][3 * i : 3 * i + 3]):
                        total[numbers] = part
            out.append(sums)
        return out


@dataclass
class _Weights:
    """What the n-grams of a chunk weigh, worked out from the answers of both rounds."""

    counts: _Counts
    sums: _Sums
    total: int
    vocabulary: int

    def of(self, row: dict, sizes: list[Grams]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Places, what each adds as an arc, and backoffs of each size; log10 of the unigram probabilities."""
        discount = self.counts.params.discount
        known = self.counts.read(row, sizes)
        least = lambda x: np.maximum(x, 1e-12)
        prob = (known[0][0] + 1) / (self.total + self.vocabulary + 1)
        unigram = np.log10(prob)
        adds, backs = [np.zeros(len(prob))], []
        for i, (next_ones, many, tails) in enumerate(self.sums.read(row, sizes, known)):
            here = known[i][0]
            some = next_ones > 0
            upper = (many - discount * next_ones)[some] / here[some]
            if i:
                lower = (tails - discount * next_ones)[some] / known[i - 1][0][sizes[i].tail[some]]
            else:
                lower = (tails + next_ones)[some] / (self.total + self.vocabulary + 1)
            back = np.zeros(len(here))
            back[some] = np.log10(least(1 - upper) / least(1 - lower))
            backs.append(back)
            after, kept = sizes[i + 1], known[i + 1][0] > 0
            above = np.zeros(len(kept))
            above[kept] = (known[i + 1][0][kept] - discount) / here[after.context[kept]]
            add = np.zeros(len(kept))
            add[kept] = np.log10(above[kept]) - back[after.context[kept]] - np.log10(prob[after.tail[kept]])
            adds.append(add)
            prob = above
        return known, adds, [*backs, np.zeros(len(prob))], unigram


def _weighed(chunks: DataFrame, parts: int, spread: np.ndarray, params: LmParams) -> tuple[DataFrame, _Weights]:
    """The chunks with the answers of both rounds, and what reads them."""
    tokens = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    counts = _Counts(params, max(1, -(-params.order * tokens // _SLOT)), spread)
    sums = _Sums(counts)
    counted = _round(chunks, counts.ask, counts.answer, counts.slots, parts, "counts")
    total, words = counted.agg(F.coalesce(F.sum("counts_total"), F.lit(0)), F.coalesce(F.sum("counts_words"), F.lit(0))).first()
    rows = chunks.join(counted.select("chunk", "counts"), "chunk", "left")
    summed = _round(rows, sums.ask, sums.answer, counts.slots, parts, "sums")
    return rows.join(summed.select("chunk", "sums"), "chunk", "left"), _Weights(counts, sums, total, words)


def fit(training: DataFrame, params: LmParams = LmParams()) -> tuple[LmModel, DataFrame]:
    """The totals and frequent part of the model of all rows of ``training`` (``text``; null counts as
    empty), and the rows in chunks, as ``score`` reads them."""
    small_batches(training.sparkSession, _ROWS)
    words, spread, tokens = _numbering(training, params)
    table, parts = _written(_chunks(training, words, F.lit(True), scored=False), tokens)
    rows, weights = _weighed(table, parts, spread, params)
    total = weights.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = Chunk.read(row["tokens"]).grams(params.order)
                known, adds, backs, _ = weights.of(row, sizes)
                for size, (grams, (many, speaks), add, back) in enumerate(zip(sizes, known, adds, backs), 1):
                    share = params.common_share if size == 1 else params.min_share
                    at = np.flatnonzero(speaks & (many >= share * total))
                    hashes = [hashes_of(c[at]) for c in grams.columns]
                    keys = hashes[0] if size == 1 else _hash(hashes)
                    arrays = [np.full(len(at), size, np.int32), keys.view(np.int64), many[at], add[at], back[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["size", "key", "n", "add", "back"])

    shared = training.sparkSession.sparkContext.broadcast(words)

    def hashes_of(codes: np.ndarray) -> np.ndarray:
        out = codes.copy()
        numbered = codes <= len(shared.value)
        out[numbered] = np.concatenate([[END], shared.value])[codes[numbered].astype(np.int64)]
        return out

    # At most 1 / common_share tokens, and 1 / min_share n-grams an order.
    found = rows.select("chunk", "tokens", "counts", "sums").mapInArrow(run, "size int, key long, n long, add double, back double").toPandas()
    model = LmModel(total, weights.vocabulary, params.order, words=words, spread=spread, params=params)
    for part, names in ((found[found["size"] == 1], ("tokens", "counts", "", "token_backs")), (found[found["size"] > 1], ("grams", "", "adds", "backs"))):
        keys = part["key"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        for name, values in zip(names, (keys, part["n"].to_numpy(), part["add"].to_numpy(), part["back"].to_numpy())):
            if name:
                setattr(model, name, values[order])
    return model, table


def score(docs: DataFrame, model: LmModel, table: DataFrame) -> DataFrame:
    """``docs`` without ``text``, and ``n_tokens, n_known, train_tokens, base_score, score`` of each row.

    ``base_score`` adds the unigram weights of all tokens, ``score`` those of the automaton. A null
    or empty text has its end token only. Repeated rows count each on their own.
    """
    small_batches(docs.sparkSession, _ROWS)
    asking = _chunks(docs, model.words, F.lit(False), scored=True, first=1)
    chunks = asking.unionByName(table.withColumn("docs", F.lit(None).cast(asking.schema["docs"].dataType)))
    return _scores(docs, *_written(chunks, 2 * model.total), model.spread, model.params)


def fit_and_score(docs: DataFrame, training: Column, params: LmParams = LmParams()) -> DataFrame:
    """What ``score`` returns of all rows by the model of those with ``training``, which are then cut into chunks only once."""
    small_batches(docs.sparkSession, _ROWS)
    words, spread, tokens = _numbering(docs, params)
    return _scores(docs, *_written(_chunks(docs, words, training, scored=True), tokens), spread, params)


def _scores(docs: DataFrame, chunks: DataFrame, parts: int, spread: np.ndarray, params: LmParams) -> DataFrame:
    rows, weights = _weighed(chunks, parts, spread, params)
    keep = [f for f in docs.schema if f.name != "text"]
    names = [*(f.name for f in keep), "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("docs")
            for i, row in enumerate(batch.drop_columns(["docs"]).to_pylist()):
                chunk = Chunk.read(row["tokens"])
                sizes = chunk.grams(params.order)
                known, adds, backs, unigram = weights.of(row, sizes)
                owner, many = chunk.owners(), len(chunk.sizes)
                sums = lambda places, values: np.bincount(owner[places], values, many).astype(float)
                base = sums(sizes[0].last, unigram[chunk.ids])
                score = base.copy()
                for grams, add, back in zip(sizes, adds, backs):
                    score += sums(grams.last, (add + back)[grams.number])
                n_known = sums(sizes[0].last, (known[0][0] > 0)[chunk.ids].astype(float)).astype(np.int64)
                found = texts[i].values
                columns = [found.field(j) for j in range(len(keep) + 1)]
                columns += [pa.array(c) for c in (n_known, np.full(many, weights.total, np.int64), base, score)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return rows.where("docs is not null").select("chunk", "tokens", "counts", "sums", "docs").mapInArrow(run, fields)
