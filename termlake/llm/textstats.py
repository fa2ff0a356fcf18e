"""Measures of a text in built-in functions only. Words are runs of other characters than blank, tab and line ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r" \t\r\n"
SYMBOLS = r"#$%&*|!<>{}=~^@\[\]"
MEASURES = ("mean_word", "symbols", "capitals", "digits", "variety", "repeated_lines")


def _share(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")) / F.length(text)


def measured(docs: DataFrame, text: Column, of_words: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``size_chars``, ``size_lines`` and the measures; all measures are 0 for a text without words, or null.

    ``of_words``: further columns, from the array of words.

    mean_word: characters a word. symbols, capitals (A to Z), digits: share of all characters. variety: logarithm of
    the number of distinct words over that of words. repeated_lines: share of lines that occurred before.
    """
    words = F.coalesce(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0)), F.array().cast("array<string>"))
    lines = F.split(text, "\n")
    n = F.size("__words")
    raw = {
        "mean_word": F.length(F.regexp_replace(text, f"[{SPACE}]+", "")) / n,
        "symbols": _share(text, SYMBOLS),
        "capitals": _share(text, "A-Z"),
        "digits": _share(text, "0-9"),
        "variety": F.log1p(F.size(F.array_distinct("__words")).cast("double")) / F.log1p(n.cast("double")),
        "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
    }
    held = docs.withColumn("__words", words)
    more = {k: f(F.col("__words")) for k, f in (of_words or {}).items()}
    sizes = {"n_words": n, "size_chars": F.coalesce(F.length(text), F.lit(0)), "size_lines": F.coalesce(F.size(lines), F.lit(0))}
    return held.withColumns(sizes | {k: F.when(n > 0, v).otherwise(0.0) for k, v in raw.items()} | more).drop("__words")
