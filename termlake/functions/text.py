"""Text functions, Column to Column, in built-in functions only.

A token is a run of word characters that has a-z and 0-9 only, once in lower case: ``café`` and ``foo_bar`` hold none.
Positions count from 0 and are given before stop words go; order and repeats stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    "a an and are as at be but by can been for from has have he in is it its not of on or that than the their them they this to was when which will with".split()
)
_WORD = r"\p{L}\p{N}_"
TOKEN = f"(?<![{_WORD}])[a-z0-9]+(?![{_WORD}])"
#: In sorted terms joined by blanks: each run of one term. Possessive, so that long runs need no stack.
_RUN = r"(\S++)(?: \1(?!\S))*+"


def indexed_text(title: Column, content: Column) -> Column:
    """What is indexed of a document; null counts as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def tokens(text: Column) -> Column:
    """Array of all tokens; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def terms(text: Column, stop: bool = True, normalize: Callable[[Column], Column] | None = None) -> Column:
    """Tokens, without stop words unless ``stop`` is false; ``normalize`` is applied to each, as a stemmer would be."""
    found = without_stop_words(tokens(text)) if stop else tokens(text)
    return found if normalize is None else F.transform(found, normalize)


#: Normalizers by name; an index that is saved keeps the name.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "singular": lambda word: F.regexp_replace(F.regexp_replace(word, r"(?<=[a-z0-9]{2})ies$", "y"), r"(?<=[a-rt-z0-9][a-rt-z0-9])s$", ""),
    "prefix5": lambda word: F.substring(word, 1, 5),
}


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms, documents and queries alike: whether stop words go, and what is made of each word (a name in
    ``NORMALIZERS``, or a function of a column; an index with a function can't be saved)."""

    stop: bool = True
    normalize: str | Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        if isinstance(self.normalize, str) and self.normalize not in NORMALIZERS:
            raise ValueError(f"no normalizer has the name {self.normalize!r}")

    def terms(self, text: Column) -> Column:
        return terms(text, self.stop, NORMALIZERS[self.normalize] if isinstance(self.normalize, str) else self.normalize)


def term_runs(found: Column) -> Column:
    """Array with a string for each distinct term, the term as often as it occurs: counts without a shuffle, in the row."""
    return F.regexp_extract_all(F.array_join(F.sort_array(found), " "), F.lit(_RUN), F.lit(0))


def run_term(run: Column) -> Column:
    return F.substring_index(run, " ", 1)


def run_count(run: Column) -> Column:
    return ((F.length(run) + 1) / (F.length(run_term(run)) + 1)).cast("bigint")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once a row however often it is used; nested expressions would compute it each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def snippet(content: Column, query_terms: Sequence[str], size: int = 200) -> Column:
    """About ``size`` characters around the first query term that occurs, cut at blanks, with ellipses.

    Terms are tried in their order, as parts of words too. Null and empty contents give an empty snippet.
    """

    def begin(low: Column) -> Column:
        hits = [once(F.instr(low, t.lower()), lambda at: F.when(at > 0, at)) for t in query_terms if t]
        return F.greatest(F.coalesce(*hits, F.lit(1)) - 41, F.lit(0))

    def head(body: Column, start: Column) -> Column:
        blank = F.instr(body, " ")
        return F.when(start > 0, F.concat(F.lit("..."), F.when(blank.between(2, 20), F.substring(body, blank + 1, F.length(body))).otherwise(body))).otherwise(body)

    def tail(headed: Column, last: Column) -> Column:
        # a short cut without any blank loses its last character, as a slice up to -1 does
        until = F.when(last >= 0, last).otherwise(F.greatest(F.length(headed) - 1, F.lit(0)))
        return F.concat(F.when(last > F.length(headed) - 20, F.substring(headed, F.lit(1), until)).otherwise(headed), F.lit("..."))

    def close(headed: Column, start: Column) -> Column:
        last = F.when(F.instr(headed, " ") == 0, -1).otherwise(F.length(headed) - F.instr(F.reverse(headed), " "))
        return F.when(F.length(content) > start + size, once(last, lambda z: tail(headed, z))).otherwise(headed)

    def cut(start: Column) -> Column:
        return once(F.substring(content, start + 1, F.lit(size)), lambda body: once(head(body, start), lambda headed: close(headed, start)))

    return F.when(F.coalesce(content, F.lit("")) == "", F.lit("")).otherwise(once(once(F.lower(content), begin), cut))


def highlight(text: Column, query_terms: Sequence[str], mark: str = "**") -> Column:
    """Each query term, as it is or in lower, upper or capitalized form, between marks."""
    forms = {f for t in query_terms if t for f in (t, t.lower(), t.upper(), t.capitalize())}
    if not forms:
        return text
    either = "|".join(re.escape(f) for f in sorted(forms, key=lambda f: (-len(f), f)))
    return F.regexp_replace(text, f"({either})", f"{mark}$1{mark}")


def strip_markup(text: Column) -> Column:
    """Without tags in square brackets."""
    return F.regexp_replace(text, r"\[/?[^\]]+\]", "")


def lead(content: Column, size: int = 200) -> Column:
    """The first characters on one line, with an ellipsis if there are more."""
    body = F.trim(F.translate(F.substring(content, 1, size), "\n", " "))
    return F.concat(body, F.when(F.length(content) > size, F.lit("...")).otherwise(F.lit("")))


def fragment(content: Column, size: int = 200, words: int = 6) -> Column:
    """A query from the middle of a text of over 100 characters: the second to the sixth word there; null if too few."""
    middle = F.substring(content, F.floor(F.length(content) / 2).cast("int") + 1, F.lit(size))
    found = F.regexp_extract_all(middle, F.lit(r"[^ \t\r\n]+"), F.lit(0))
    n = F.least(F.lit(words), F.size(found) - 1) - 1
    return F.when((F.length(content) > 100) & (n >= 3), F.array_join(F.slice(found, F.lit(2), F.greatest(n, F.lit(0))), " "))
