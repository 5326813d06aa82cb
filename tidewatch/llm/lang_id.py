"""Language identification by words first, character n-grams for unseen words.

A known word scores by its log frequency in each language. A word that no language has often
enough is scored by its character n-grams of the longest length of which one is known, down to
single characters; it weighs as one word, and a longer one by its length, as scripts without blanks
make whole passages words. Scores add up over the whole text.

The model is fitted on at most about ``sample`` labelled rows, chosen by a hash of text and id,
and keeps only words and n-grams that make up at least ``min_share`` of a language's, so it has
at most ``1 / min_share`` words and as many n-grams of each length per language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import small_batches

UNKNOWN = "und"
# Letters, with the marks that belong to them; no figures, also not those that are written like letters.
_ASCII_WORD, _WORD = re.compile("[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
_PIECE = 24  # letters of a longer unseen word that weigh as one word
_CACHED = 128  # letters of the longest word a task remembers
_KNOWN = 40_000  # words a task remembers
_TEXTS = 64  # texts whose words are looked up together
_AT_ONCE = 20_000  # words or n-grams looked up, or words counted, at a time


@dataclass(frozen=True)
class LangParams:
    sample: int = 6000
    min_share: float = 2e-6
    longest: int = 4
    min_rows: int = 1


def _hashes(items: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(i.encode("utf-8", "surrogatepass")) for i in items), np.uint64, len(items))


@dataclass(frozen=True)
class LogTable:
    """Log frequencies of items: their 64-bit hashes in order, and a row of single floats per hash.

    Two items of one hash count as one; among a million items that is one chance in ten million.
    """

    hashes: np.ndarray
    logs: np.ndarray

    @staticmethod
    def of(parts: list[tuple[list[str], np.ndarray]], languages: int) -> LogTable:
        hashes = np.concatenate([np.zeros(0, np.uint64), *(_hashes(items) for items, _ in parts)])
        logs = np.concatenate([np.zeros((0, languages), np.float32), *(rows.astype(np.float32) for _, rows in parts)])
        order = np.argsort(hashes, kind="stable")
        return LogTable(hashes[order], logs[order])

    def find(self, items: list[str]) -> np.ndarray:
        """Row of each item, -1 where it is not known."""
        if not len(self.hashes):
            return np.full(len(items), -1)
        wanted = _hashes(items)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)


@dataclass(frozen=True)
class LangModel:
    """Log frequencies of words and n-grams in the languages, in their order."""

    languages: list[str]
    words: LogTable
    grams: LogTable
    prior: np.ndarray
    longest: int

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row per word: its log frequencies, or the mean of those of its longest known n-grams."""
        rows = self.words.find(words)
        known = rows >= 0
        scores = np.zeros((len(words), len(self.languages)))
        scores[known] = self.words.logs[rows[known]]
        left = np.nonzero(~known)[0]
        for size in range(self.longest, 0, -1):
            if not len(left):
                break
            marked = [f"<{words[i]}>" for i in left.tolist()]
            total, many = self._gram_sums(marked, size)
            met = many > 0
            weight = np.maximum(1.0, np.array([len(m) - 2 for m in marked]) / _PIECE)[met] / many[met]
            scores[left[met]] = total[met] * weight[:, None]
            left = left[~met]
        return scores

    def _gram_sums(self, marked: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Summed logs and number of the known n-grams of each word, so many n-grams at a time."""
        total, many = np.zeros((len(marked), len(self.languages))), np.zeros(len(marked), np.int64)
        grams: list[str] = []
        owners: list[int] = []

        def add() -> None:
            rows = self.grams.find(grams)
            known = rows >= 0
            owner = np.array(owners)[known]
            np.add.at(total, owner, self.grams.logs[rows[known]])
            np.add.at(many, owner, 1)

        for i, word in enumerate(marked):
            for first in range(0, max(len(word) - size + 1, 0), _AT_ONCE):
                part = [word[j : j + size] for j in range(first, min(first + _AT_ONCE, len(word) - size + 1))]
                grams += part
                owners += [i] * len(part)
                if len(grams) >= _AT_ONCE:
                    add()
                    grams, owners = [], []
        if grams:
            add()
        return total, many


def _grams(word: str, longest: int) -> Iterator[str]:
    marked = f"<{word}>"
    for size in range(1, longest + 1):
        for i in range(len(marked) - size + 1):
            yield marked[i : i + size]


def words_of(text: str | None) -> list[str]:
    """Runs of letters and their marks, in lower case."""
    lowered = (text or "").lower()
    return _ASCII_WORD.findall(lowered) if lowered.isascii() else _WORD.findall(lowered)


def _log_rows(counts: list[tuple[int, str, int]], languages: int) -> tuple[list[str], np.ndarray]:
    """Smoothed log frequencies of the items of one kind and size."""
    place: dict[str, int] = {}
    for _, item, _ in counts:
        place.setdefault(item, len(place))
    rows = np.zeros((len(place), languages))
    for lang, item, n in counts:
        rows[place[item], lang] += n
    return list(place), np.log(rows + 1) - np.log(rows.sum(axis=0) + len(place) + 1)


def fit(labelled: DataFrame, params: LangParams = LangParams()) -> LangModel:
    """The model of ``labelled`` (``doc_id, text, lang``); rows without text or lang teach nothing.

    One job counts the rows, one the words and n-grams of the sample.
    """
    labelled = labelled.where("lang is not null and text is not null")
    rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(k for k, n in rows.items() if n >= params.min_rows)
    place = {k: i for i, k in enumerate(languages)}
    if not languages:
        nothing = LogTable.of([], 0)
        return LangModel([], nothing, nothing, np.zeros(0), params.longest)
    # An even part of every language, so that a rare one is learnt as well.
    part = F.element_at(
        F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, params.sample / len(languages) / rows[k])))]),
        F.col("lang"),
    )
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)
    sample = labelled.where(F.col("lang").isin(languages)).where(draw < part)
    longest = params.longest

    def counts(lang: int, words: Counter) -> Iterator[pa.RecordBatch]:
        grams: Counter = Counter()
        for word, n in words.items():
            for gram in _grams(word, longest):
                grams[gram] += n
        for size, items in ((0, words), (1, grams)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(items), pa.int32()),
                    pa.array([len(k) * size for k in items], pa.int32()),
                    pa.array(list(items), pa.string()),
                    pa.array(list(items.values()), pa.int64()),
                ],
                names=["lang", "size", "item", "n"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words = words_of(text)
                for first in range(0, len(words), _AT_ONCE):
                    held = found.setdefault(place[lang], Counter())
                    held.update(words[first : first + _AT_ONCE])
                    # A task holds the counts of a bounded number of words.
                    if len(held) > _AT_ONCE:
                        yield from counts(place[lang], found.pop(place[lang]))
        for lang, held in found.items():
            yield from counts(lang, held)

    counted = sample.select("text", "lang").mapInArrow(count, "lang int, size int, item string, n long")
    sums = counted.groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    totals = sums.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    frequent = sums.join(totals, ["lang", "size"]).where(F.col("n") >= F.col("total") * params.min_share)
    by_size: dict[int, list] = {}
    for r in frequent.select("lang", "size", "item", "n").toLocalIterator():
        by_size.setdefault(r["size"], []).append((r["lang"], r["item"], r["n"]))
    words = LogTable.of([_log_rows(by_size.pop(0, []), len(languages))], len(languages))
    grams = LogTable.of([_log_rows(items, len(languages)) for items in by_size.values()], len(languages))
    prior = np.log(np.array([rows[k] for k in languages], float) / sum(rows[k] for k in languages))
    return LangModel(languages, words, grams, prior, params.longest)


class Scores:
    """The scores of the words a task has met last, ``_KNOWN`` of them at most."""

    def __init__(self, model: LangModel) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((_KNOWN, len(self.model.languages)))

    def total(self, words: list[str]) -> np.ndarray:
        total = np.zeros(len(self.model.languages))
        for first in range(0, len(words), _AT_ONCE):
            part = words[first : first + _AT_ONCE]
            places = list(map(self.place.get, part))
            if None in places:
                part = self._learn(part, places, total)
                places = list(map(self.place.__getitem__, part))
            total += self.rows[places].sum(axis=0)
        return total

    def prepare(self, texts: list[list[str]]) -> None:
        """Look up the new words of several texts at once."""
        new = {w for words in texts for w in words if w not in self.place and len(w) <= _CACHED}
        if 0 < len(new) <= _AT_ONCE:
            self._learn(list(new), [None] * len(new), None)

    def _learn(self, words: list[str], places: list[int | None], total: np.ndarray | None) -> list[str]:
        """Take up the words that are new; very long ones are scored at once and left out of those given back."""
        new = list(dict.fromkeys(w for w, p in zip(words, places) if p is None))
        if any(len(w) > _CACHED for w in new):
            for word in words:
                if len(word) > _CACHED:
                    total += self.model.word_scores([word])[0]
            words = [w for w in words if len(w) <= _CACHED]
            new = [w for w in new if len(w) <= _CACHED]
        if len(self.place) + len(new) > _KNOWN:
            self.forget()
            new = list(dict.fromkeys(words))
        if new:
            at = len(self.place)
            self.rows[at : at + len(new)] = self.model.word_scores(new)
            self.place.update(zip(new, range(at, at + len(new))))
        return words


def predict_text(model: LangModel, text: str | None, scores: Scores | None = None) -> tuple[str, float]:
    """The language of one text and its share of the probability; ties go to the first name."""
    return _predicted(words_of(text), Scores(model) if scores is None else scores)


def _predicted(words: list[str], scores: Scores) -> tuple[str, float]:
    model = scores.model
    if not words or not model.languages:
        return UNKNOWN, 0.0
    total = model.prior + scores.total(words)
    best = int(np.argmax(total))
    return model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict_texts(texts: Iterable[str | None], scores: Scores) -> Iterator[tuple[str, float]]:
    """``predict_text`` of each text, the words of a few looked up together."""
    waiting: list[list[str]] = []
    for text in texts:
        waiting.append(words_of(text))
        if len(waiting[-1]) >= _AT_ONCE or len(waiting) == _TEXTS:
            scores.prepare(waiting)
            yield from (_predicted(words, scores) for words in waiting)
            waiting = []
    scores.prepare(waiting)
    yield from (_predicted(words, scores) for words in waiting)


_FOUND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: LangModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only ``text`` is read. Columns of these names are replaced.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "_lang")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = Scores(shared.value)
        for texts in batches:
            made = predict_texts((t.as_py() for t in texts), scores)
            yield pa.array([{"lang_pred": lang, "score": score} for lang, score in made], _FOUND)

    rows = docs.select(*keep, guess("text").alias("_lang"))
    return rows.select(*keep, "_lang.lang_pred", "_lang.score")


def held_out(column: str, parts: int, part: int):
    """Whether the CRC-32 of an id as text leaves ``part`` modulo ``parts``; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts == part
