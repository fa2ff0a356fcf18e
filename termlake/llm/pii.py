"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Every pattern needs a digit or an at sign, so a built-in predicate first sets aside the texts that have neither; only
the others reach Python, in Arrow batches. A span's score starts at its kind's base. A checksum that holds (Luhn for
cards, mod 97 for IBANs, octets and the like for the rest) is required where the kind has one; context words within
a few dozen characters raise the score, words that speak for something else lower it. Spans of at least ``MIN_SCORE``
count. Where spans overlap the best score wins, then the longer, then the earlier.

A match that fails its check is tried with nearer ends, the farthest first, wherever the pattern still matches up to there; then
the search goes on behind the span, or one character on where there is none.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlake.llm.common import fresh, quoted

MIN_SCORE = 0.5
#: Characters on either side in which context words count.
NEAR = 48
RAISE, LOWER = 0.35, 0.35
#: What a text must have to hold any of the kinds.
NEEDED = "[0-9@]"


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others (ISO/IEC 7812)."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the check digits of an account number hold (ISO 13616)."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _card(span: str) -> bool:
    digits = re.sub(r"\D", "", span)
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)


#: Lengths of the account numbers of countries that use them (IBAN registry).
IBAN_LENGTHS = dict(
    x.split(":")
    for x in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SE:24 SI:19 SK:24 SM:27 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20".split()
)


def _iban(span: str) -> bool:
    plain = span.replace(" ", "").upper()
    return str(len(plain)) == IBAN_LENGTHS.get(plain[:2]) and mod97(plain)


def _ip(span: str) -> bool:
    try:
        return not ipaddress.IPv4Address(span).is_unspecified
    except ValueError:
        return False


def _phone(span: str) -> bool:
    digits = re.sub(r"\D", "", span)
    return 8 <= len(digits) <= 15 and len(set(digits)) > 2


def _ssn(span: str) -> bool:
    a, b, c = span.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


class Kind(NamedTuple):
    name: str
    pattern: re.Pattern
    holds: Callable[[str], bool]
    base: float
    near: tuple[str, ...]
    against: tuple[str, ...]


KINDS = [
    Kind("email", re.compile(r"(?<![\w.+%-])\w[\w.+%-]*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w@])"), lambda s: ".." not in s, 0.9, ("mail", "contact", "kontakt", "correo", "courriel"), ()),
    Kind("card", re.compile(r"(?<![\w.,+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5})(?![\w-])"), _card, 0.8, ("card", "visa", "credit", "karte", "tarjeta", "carte"), ("order", "invoice", "isbn", "tracking")),
    Kind("iban", re.compile(r"(?<!\w)[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]){11,30}(?!\w)"), _iban, 0.9, ("iban", "account", "konto", "cuenta", "compte"), ()),
    Kind("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"), _ip, 0.7, ("ip", "host", "server", "address", "login"), ("version", "release", "section", "kapitel")),
    Kind("phone", re.compile(r"(?<![\w.])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,5}){2,5}(?![\w-])|(?<![\w.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"), _phone, 0.8, ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil", "portable"), ()),
    Kind("phone", re.compile(r"(?<![\w.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])"), _phone, 0.45, ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil", "portable"), ("isbn", "version", "order")),
    Kind("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _ssn, 0.5, ("ssn", "social", "security"), ("isbn", "part", "order")),
    Kind("credential", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{24,}+"), lambda s: len(set(s)) > 8, 0.25, ("token", "key", "secret", "password", "passwd", "bearer"), ("sha", "commit", "checksum", "md5")),
]


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


#: Kinds of which a shorter match can hold where the longest doesn't.
TAILS = ("card", "iban", "phone")


def candidates(kind: Kind, text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the matches of a kind's pattern that hold, without overlap."""
    at = 0
    while m := kind.pattern.search(text, at):
        start, end = m.span()
        if not kind.holds(m[0]):
            end = next((e for e in _ends(kind, text, start, end) if kind.holds(text[start:e])), None)
        if end is not None:
            yield start, end
        at = start + 1 if end is None else end


def _ends(kind: Kind, text: str, start: int, end: int) -> Iterator[int]:
    """Nearer ends at which the pattern still matches: first those that cut no dotted or hyphenated word, the farthest first."""
    if kind.name not in TAILS:
        return
    found = [e for e in range(end - 1, start, -1) if text[e - 1].isalnum() and not (text[e].isalnum() or text[e] in ("_" if kind.name == "iban" else "_-")) and kind.pattern.fullmatch(text, start, e)]
    yield from sorted(found, key=lambda e: text[e] in ".-" and text[e + 1 : e + 2].isalnum())


def _words(words: tuple[str, ...]) -> Callable | None:
    return re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, words)) + r")", re.I).search if words else None


_CONTEXT = [(_words(k.near), _words(k.against)) for k in KINDS]


def spans(text: str, min_score: float = MIN_SCORE) -> list[Span]:
    """The spans of a text, in order and without overlap. Positions count characters from 0."""
    found = []
    for kind, (near, against) in zip(KINDS, _CONTEXT):
        if kind.name == "email" and "@" not in text:
            continue
        for start, end in candidates(kind, text):
            around = (text[max(0, start - NEAR) : start], text[end : end + NEAR])
            score = kind.base
            score += RAISE * (near is not None and any(map(near, around)))
            score -= LOWER * (against is not None and any(map(against, around)))
            if (score := round(min(1.0, score), 2)) >= min_score:
                found.append(Span(kind.name, start, end, score))
    found.sort(key=lambda s: (-s.score, s.start - s.end, s.start))
    kept: list[Span] = []
    taken = bytearray(len(text)) if len(found) > 1 else bytearray()
    for s in found:
        if len(found) == 1 or not any(taken[s.start : s.end]):
            kept.append(s)
            taken[s.start : s.end] = b"\1" * (s.end - s.start)
    return sorted(kept, key=lambda s: s.start)


def redacted(text: str, min_score: float = MIN_SCORE) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    out, at = [], 0
    for s in spans(text, min_score):
        out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = s.end
    return "".join(out) + text[at:] if out else text


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id, kind, start, end, score``: a row for each span of personal data, ``start`` and ``end`` in characters.

    Null and empty texts have none. Repeated rows give their spans each time; a null id stays null. Texts are
    searched to their ends, however long. Other columns are ignored. An empty table gives an empty result.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in spans(t, min_score)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()))], ["doc_id", "kind", "start", "end", "score"])

    texts = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(text_col).cast("string").alias("text")).where(F.col("text").rlike(NEEDED))
    return texts.mapInArrow(search, "doc_id bigint, kind string, start int, end int, score double")


def redact(docs: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE, n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind, as ``<EMAIL>``; all rows and columns stay.

    A column of the name ``n_chars_col``, if there is one, is taken for the length of the text: it is set anew for texts that change and
    stays as it is for the others; None leaves any column alone. Null texts stay null, empty ones empty, and texts without spans as
    they are; long texts are redacted to their ends. Repeated rows are redacted alike and all stay. Other columns stay whatever their
    names. An empty table gives an empty result.
    """

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array((None if t is None else redacted(t, min_score) for t in texts.to_pylist()), pa.string())

    text = quoted(text_col)
    candidate = F.when(text.rlike(NEEDED), text)
    (new,) = fresh(docs, "clean")
    out = docs.withColumn(new, F.coalesce(clean(candidate), text))
    if n_chars_col and n_chars_col in docs.columns:
        kind = docs.schema[n_chars_col].dataType
        out = out.withColumn(n_chars_col, F.when(quoted(new) != text, F.length(quoted(new))).otherwise(quoted(n_chars_col)).cast(kind))
    return out.withColumn(text_col, quoted(new)).drop(new)
