"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: words in lower case, and typed placeholders for numbers (also in words), units and
names (a capitalised word inside a sentence), whose values are kept aside as slots. A capitalised word
that begins a sentence and is no function word may be a name or not: texts have two forms, one with these
words plain and one with them as names, and each form is matched by itself. Windows of
template tokens of documents and benchmark items meet in a hash join, so a question matches with
other numbers or names in it. Matches on one diagonal (the item's start in the document), and those
on diagonals near each other, as tokens put in or left out give them, are put together; where slots
differ, the values must map consistently: the same value of the item always to the same value of the
document (two values of the item may become one). A document is contaminated by an item if enough of
the item matches, or a passage of fixed length of it, and the slots are consistent.

Only windows that pass a Bloom filter of the benchmark leave a document's task. The filter has a
fixed size; a larger benchmark lets more windows through to the join, which decides exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import small_batches
from tidewatch.llm.words import constants, mix, spans
from tidewatch.plans.staging import staged

# Units of measure, fixed values of the canonical form.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces"
    " pound pounds ton tons ml l litre litres liter liters gallon gallons second seconds minute minutes hour"
    " hours day days week weeks month months year years percent dollar dollars cent cents euro euros degree"
    " degrees kmh mph volt volts watt watts joule joules newton newtons byte bytes".split()
)
# Numbers in words, fixed values; "one" and "second" are too common as other words.
NUMBERS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    " eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
# Function words, fixed values: capitalised at the start of a sentence, they are no names.
STARTERS = frozenset(
    "a about after all also although an and any are as at because before both but by can could did do does during"
    " each either every few for from given had has have he her here his how however i if in into is it its just let"
    " many may more most my neither no not now of on once one only or other our over she should since so some such"
    " than that the their them then there these they this those though through to under until up was we were what"
    " when where whether which while who whom whose why will with without would yet you your".split()
)
# Classes of bytes: words are A-Z, a-z and all beyond ASCII, numbers are digits with points or commas
# between them, signs are units.
_WORD, _NUMBER, _SIGN = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _WORD
_CLASS[48:58] = _NUMBER
_CLASS[[ord(c) for c in "%$"]] = _SIGN
_ENDS = np.zeros(256, np.int64)
_ENDS[[ord(c) for c in '.!?:;\n"(']] = 1
_BITS = 1 << 23  # of the Bloom filter, 1 MB
_HASHES = 3


@dataclass(frozen=True)
class LeakParams:
    window: int = 8
    #: Least part of an item that a document must hold; tokens in matched windows, ``window`` - 1 less on both sides.
    covered: float = 0.5
    #: Tokens of an unbroken passage that is enough whatever part of the item it is.
    passage: int = 40
    #: Diagonals at most so far apart are put together.
    shift: int = 8
    #: Least number of plain words of a window, lest placeholders alone match; one with fewer must have equal values.
    plain: int = 4
    #: Items of fewer tokens are reported, but ``decontaminate`` drops no document for them.
    least: int = 5


def _classify(part: np.ndarray) -> np.ndarray:
    kind = _CLASS[part]
    digit = kind == _NUMBER
    inner = np.flatnonzero(digit[:-2] & digit[2:] & ((part[1:-1] == 46) | (part[1:-1] == 44))) + 1
    kind[inner] = _NUMBER
    return kind


def _fold(part: np.ndarray) -> np.ndarray:
    """Latin-1 capitals beyond ASCII in lower case; the words' hash does A-Z."""
    out = part.copy()
    wide = np.flatnonzero(part[:-1] == 0xC3) + 1
    wide = wide[(part[wide] >= 0x80) & (part[wide] <= 0x9E) & (part[wide] != 0x97)]
    out[wide] += 0x20
    return out


_PLACEHOLDERS = constants(3, 7)  # number, unit, name
_UNIT_HASHES, _NUMBER_HASHES, _STARTER_HASHES = (
    np.sort(spans(pa.array(sorted(x)), _classify, fold=_fold).hashes) for x in (UNITS, NUMBERS, STARTERS)
)
# The forms of a text, as bits: first words of sentences plain, or as names.
PLAIN, NAMED = 1, 2


def _among(hashes: np.ndarray, listed: np.ndarray) -> np.ndarray:
    return listed[np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)] == hashes


class Template:
    """The template tokens of some texts, one after the other; text i has [offsets[i], offsets[i + 1])."""

    def __init__(self, texts: pa.Array) -> None:
        found = spans(texts, _classify, _ENDS, _fold)
        self.offsets = found.rows()
        data = np.concatenate([found.data, np.zeros(3, np.uint8)])
        n = len(found.starts)
        begin = np.ones(n, bool)
        begin[1:] = found.marks[1:] > found.marks[:-1]
        begin[self.offsets[:-1][self.offsets[:-1] < n]] = True
        upper = lambda b: (b >= 65) & (b <= 90)
        one, two, three = (data[found.starts + i] for i in range(3))
        # Capitals of Latin-1, Greek and Cyrillic.
        wide = (one == 0xC3) & (two >= 0x80) & (two <= 0x9E)
        wide |= (one == 0xCE) & (two >= 0x91) & (two <= 0xA9)
        wide |= (one == 0xD0) & (two >= 0x80) & (two <= 0xAF)
        following = np.where(wide, three, two)
        longer = found.lengths > np.where(wide, 2, 1)
        capital = (upper(one) | wide) & longer & ~upper(following)
        unit = _among(found.hashes, _UNIT_HASHES) | (found.kinds == _SIGN)
        number = (found.kinds == _NUMBER) | _among(found.hashes, _NUMBER_HASHES)
        self.unsure = capital & begin & ~(unit | number) & ~_among(found.hashes, _STARTER_HASHES)
        name = capital & ~begin
        self.plain = {PLAIN: ~(number | unit | name)}
        self.plain[NAMED] = self.plain[PLAIN] & ~self.unsure
        self.codes = np.select([number, unit, name], list(_PLACEHOLDERS), found.hashes)
        self._found = found

    def windows(self, params: LeakParams, lengths: list[int] | None = None) -> tuple[np.ndarray, ...]:
        """First token, number of tokens, hash and forms of each window; a shorter text is one window.

        A window that is the same in both forms is given once, with the bits of both.
        With ``lengths``, those below a window's, there are windows of each of these lengths instead.
        """
        size, counts = params.window, np.diff(self.offsets)
        left = np.repeat(self.offsets[1:], counts) - np.arange(len(self.codes))
        if lengths is None:
            first = np.arange(len(self.codes)) == np.repeat(self.offsets[:-1], counts)
            starts = np.flatnonzero((left >= size) | first)
            room = np.minimum(left[starts], size)
        else:
            found = [(np.flatnonzero(left >= n), n) for n in [size, *lengths]]
            starts = np.concatenate([x for x, _ in found])
            room = np.repeat([n for _, n in found], [len(x) for x, _ in found])
        sums = np.concatenate([[0], np.cumsum(self.unsure)])
        two = sums[starts + room] > sums[starts]
        plain = self._hashes(params, starts, room, PLAIN)
        named = self._hashes(params, starts[two], room[two], NAMED)
        return (
            np.concatenate([starts, starts[two]]),
            np.concatenate([room, room[two]]),
            np.concatenate([plain, named]),
            np.concatenate([np.where(two, PLAIN, PLAIN | NAMED), np.full(len(named), NAMED)]),
        )

    def _hashes(self, params: LeakParams, starts: np.ndarray, room: np.ndarray, form: int) -> np.ndarray:
        size = params.window
        sums = np.concatenate([[0], np.cumsum(self.plain[form])])
        enough = sums[starts + room] - sums[starts] >= np.minimum(params.plain, room)
        codes = self.codes if form == PLAIN else np.where(self.unsure, _PLACEHOLDERS[2], self.codes)
        # A window poor in plain words stands with its values, and so meets its like only.
        typed, exact = (np.concatenate([x, np.zeros(size, np.uint64)]) for x in (codes, self._found.hashes))
        out = np.zeros(len(starts), np.uint64)
        for j, factor in enumerate(constants(size, 6)):
            out += np.where(room > j, np.where(enough, typed[starts + j], exact[starts + j]) * factor, np.uint64(0))
        return mix(out + room.astype(np.uint64))

    def slots(self, start: int, end: int, form: int) -> list[str | None]:
        found, plain = self._found, self.plain[PLAIN if form & PLAIN else NAMED]
        text = lambda i: found.data[found.starts[i] : found.starts[i] + found.lengths[i]].tobytes()
        return [None if plain[i] else text(i).decode("utf-8", "replace").lower() for i in range(start, end)]


def _places(hashes: np.ndarray) -> np.ndarray:
    steps = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + steps * np.uint64(i)) % np.uint64(_BITS) for i in range(_HASHES)])


def windows(texts: DataFrame, key: str, params: LeakParams, bloom=None, lengths: list[int] | None = None) -> DataFrame:
    """``key, start, hash, slots, many, forms`` of the windows of ``texts``; ``many`` windows a text has.

    ``slots`` are the values of the window's tokens, null for plain words. ``bloom`` is a
    broadcast filter; windows outside it are left out. ``lengths`` are those of shorter windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bloom is None else np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            made = Template(batch.column("text"))
            starts, room, hashes, forms = made.windows(params, lengths)
            owner = np.searchsorted(made.offsets, starts, "right") - 1
            many = np.bincount(owner[(forms & PLAIN) > 0], minlength=batch.num_rows)  # as many as of the other form
            if bits is not None and len(starts):
                at = _places(hashes)
                inside = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                inside = inside.astype(bool).all(axis=0)
                starts, room, hashes, forms, owner = (x[inside] for x in (starts, room, hashes, forms, owner))
            names, rows = batch.column(key).to_pylist(), []
            for start, tokens, code, form, i in zip(*(x.tolist() for x in (starts, room, hashes.view(np.int64), forms, owner))):
                slots = made.slots(start, start + tokens, form)
                rows.append((names[i], start - int(made.offsets[i]), code, slots, int(many[i]), form))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.list_(pa.string())),
                    pa.array([r[4] for r in rows], pa.int64()),
                    pa.array([r[5] for r in rows], pa.int32()),
                ],
                names=["key", "start", "hash", "slots", "many", "forms"],
            )

    rows = texts.select(F.col(key).cast("long").alias(key), "text")
    return rows.mapInArrow(run, "key long, start long, hash long, slots array<string>, many long, forms int")


def bloom_filter(hashes: DataFrame):
    """A broadcast of the filter's ``_BITS`` bits, set in the tasks and joined by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_BITS, bool)
        for batch in batches:
            bits[_places(batch.column("hash").to_numpy().view(np.uint64)).ravel()] = True
        packed = np.packbits(bits, bitorder="little").view(np.int64)
        used = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(packed[used])], names=["word", "bits"])

    joined = hashes.select("hash").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(_BITS // 64, np.int64)
    for row in joined.collect():  # at most _BITS / 64 rows
        words[row["word"]] = row["bits"]
    return hashes.sparkSession.sparkContext.broadcast(words.tobytes())


def leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """``doc_id, item_id, start, n_windows, covered, verbatim, item_tokens`` of each document that holds an item.

    One row per document and item, of the diagonal or the near diagonals that cover most: ``start`` is
    the token at which the item would begin, ``covered`` the part of it found, and ``verbatim`` tells
    whether all slots found have the item's own values. Texts without tokens, and nulls, match
    nothing; an item shorter than a window matches as a whole, anywhere in a document: ``item_tokens``
    tells how long it is. Rows without an id are left out. Items of equal text all match; repeated rows count once.
    """
    small_batches(docs.sparkSession)
    items = staged(windows(benchmark.where("item_id is not null"), "item_id", params), "items")
    bloom = bloom_filter(items)
    short = items.select(F.size("slots").alias("n")).where(F.col("n") < params.window).distinct()
    lengths = sorted(r["n"] for r in short.collect())  # fewer than a window's
    found = windows(docs.where("doc_id is not null"), "doc_id", params, bloom, lengths).select(
        F.col("key").alias("doc_id"), F.col("start").alias("at"), "hash", F.col("slots").alias("theirs"), "forms"
    )
    tokens = F.when(F.size("slots") < params.window, F.size("slots")).otherwise(F.col("many") + params.window - 1).cast("long")
    wanted = items.select(
        F.col("key").alias("item_id"),
        "start",
        "hash",
        F.col("slots").alias("ours"),
        "many",
        tokens.alias("item_tokens"),
        F.col("forms").alias("our_forms"),
    ).distinct()
    pairs = F.filter(F.arrays_zip("ours", "theirs"), lambda s: s["ours"].isNotNull() & s["theirs"].isNotNull())
    shared = F.col("forms").bitwiseAND(F.col("our_forms"))
    matches = found.join(wanted, "hash").select(
        "doc_id",
        "item_id",
        (F.col("at") - F.col("start")).alias("diagonal"),
        "start",
        "many",
        "item_tokens",
        pairs.alias("pairs"),
        F.explode(F.filter(F.array(F.lit(PLAIN), F.lit(NAMED)), lambda f: f.bitwiseAND(shared) > 0)).alias("form"),
    )
    # Besides, two bandings of diagonals; diagonals up to ``shift`` apart share a band of one of them.
    width = 2 * params.shift
    bands = [F.struct(F.lit(k).alias("kind"), F.floor((F.col("diagonal") + k * params.shift) / width).alias("at")) for k in (0, 1)]
    own = F.struct(F.lit(2).alias("kind"), F.col("diagonal").alias("at"))
    matches = matches.withColumn("group", F.explode(F.array(*bands, own)))
    held = matches.groupBy("doc_id", "item_id", "form", "group").agg(
        F.min("diagonal").alias("diagonal"),
        F.array_sort(F.collect_set("start")).alias("starts"),
        F.max("many").alias("many"),
        F.max("item_tokens").alias("item_tokens"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    ours = F.array_distinct(F.transform("pairs", lambda s: s["ours"]))
    size = F.lit(params.window).cast("long")

    def longer(held, start):
        """Tokens within windows, of the unbroken run that ends here and of the longest, with one window more."""
        gap = start - held["last"]
        run = F.when(gap <= size, held["run"] + gap).otherwise(size)
        return F.struct(
            start.alias("last"), (held["tokens"] + F.least(gap, size)).alias("tokens"), run.alias("run"), F.greatest(held["most"], run).alias("most")
        )

    first = F.struct(F.col("starts")[0].alias("last"), size.alias("tokens"), size.alias("run"), size.alias("most"))
    held = held.withColumn("spans", F.aggregate(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), first, longer))
    held = held.withColumn("n_windows", F.size("starts").cast("long"))
    held = held.withColumn("covered", (F.col("spans.tokens") - size + 1) / F.col("many")).where(
        ((F.col("covered") >= params.covered) | ((F.col("group.kind") == 2) & (F.col("spans.most") >= params.passage)))
        & (F.size("pairs") == F.size(ours))
    )
    verbatim = F.forall("pairs", lambda s: s["ours"] == s["theirs"])
    best = held.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("covered", "group.kind", (-F.col("diagonal")).alias("_d"), "n_windows", verbatim.alias("verbatim"), "item_tokens")).alias("b")
    )
    return best.select(
        "doc_id", "item_id", (-F.col("b._d")).alias("start"), "b.n_windows", "b.covered", "b.verbatim", "b.item_tokens"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item of ``least`` tokens or more, all columns; rows without doc_id stay."""
    held = leaks(docs, benchmark, params).where(F.col("item_tokens") >= params.least)
    return docs.join(held.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
