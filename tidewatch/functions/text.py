"""Text column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The number a JavaScript reader would see at the start of a text.
_LEADING_NUMBER = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"


def any_of(conditions: Sequence[Column]) -> Column:
    """True when one of the conditions holds; false for an empty list."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


# Above so many keywords one automaton is faster than a search for each.
FEW_KEYWORDS = 8


def _any_found(keywords: Sequence[str]) -> Callable[..., Column]:
    """A column function: whether a text holds one of many keywords, in one pass over the text."""

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        automaton = ahocorasick.Automaton()
        for keyword in keywords:
            automaton.add_word(keyword, True)
        automaton.make_automaton()
        # The first place found ends the search; a null text stays null, which a filter drops.
        return pa.array([None if t is None else next(automaton.iter(t), None) is not None for t in texts.to_pylist()])

    return found


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """The lower-cased text contains a keyword. Keywords are taken as they are given.

    A few plain terms stay in generated code, which lower-cases a text once for all of them. Many are looked for
    at once by an automaton, whose time does not depend on their number.
    """
    lowered = F.lower(text)
    if "" in keywords:
        return lowered.isNotNull()
    if len(keywords) > FEW_KEYWORDS:
        return _any_found(list(keywords))(lowered)
    return any_of([F.contains(lowered, F.lit(k)) for k in keywords])


def starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    return any_of([F.startswith(text, F.lit(p)) for p in prefixes])


def prettify_title(title: Column) -> Column:
    """Underscores become spaces and every run of word characters starts upper case.

    Unlike ``initcap`` this also capitalises after quotes, hyphens and brackets, and leaves
    the other letters alone. Word characters are the ASCII ones; accented letters end a run.
    """

    def capitalised(run: Column) -> Column:
        first = F.left(run, F.lit(1))
        return F.when(
            F.rlike(first, F.lit(r"\w")), F.concat(F.upper(first), F.substr(run, F.lit(2)))
        ).otherwise(run)

    runs = F.regexp_extract_all(F.translate(title, "_", " "), F.lit(r"(\w+|\W+)"), 1)
    return F.array_join(F.transform(runs, capitalised), "")


def file_name_of_url(url: Column) -> Column:
    """Last non-empty path segment of a URL."""
    return F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)


def leading_number(text: Column) -> Column:
    """Numeric prefix of a text as double, null when there is none."""
    return F.regexp_extract(text, _LEADING_NUMBER, 1).try_cast("double")
