import re

import pytest

from termlake.llm import pii

CARD, IBAN = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
FOUND = [
    ("write to ann.lee@mail7.example.com today", [("email", "ann.lee@mail7.example.com")]),
    ("stood.34@mail7.example.com.", [("email", "stood.34@mail7.example.com")]),
    (f"paid with {CARD}, thanks", [("card", CARD)]),
    ("paid with 4111111111111112", []),
    ("number 0000000000000000", []),
    (f"IBAN {IBAN}.", [("iban", IBAN)]),
    ("IBAN DE88 3704 0044 0532 0130 00.", []),
    ("from 192.168.7.12 at", [("ip", "192.168.7.12")]),
    ("from 192.168.7.312 at", []),
    ("version 10.2.3.4 is out", []),
    ("1.2.3.4.5", []),
    ("+1 (017) 555-7713 rethsh", [("phone", "+1 (017) 555-7713")]),
    ("call 212-555-0187", [("phone", "212-555-0187")]),
    ("item 212-555-0187", []),
    ("ssn 219-09-9999", [("ssn", "219-09-9999")]),
    ("ssn 000-09-9999", []),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', [("credential", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]),
    ("commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", []),
    ("plain words only, 1234 of them in 2024", []),
    ("", []),
]


@pytest.mark.parametrize("text,want", FOUND)
def test_spans(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in pii.spans(text)] == want
    out = pii.redacted(text)
    assert all(v not in out and f"<{k.upper()}>" in out for k, v in want) and (want or out == text)


def test_checksums():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    assert all(pii.luhn(d + str(c)) == (c == next(k for k in range(10) if pii.luhn(d + str(k)))) for d in ("123456", "4992739871") for c in range(10))
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")


def test_every_pattern_needs_what_the_predicate_asks_for():
    for text, want in FOUND:
        assert not want or re.search(pii.NEEDED, text)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted((r.doc_id, *s) for r in df.collect() for s in pii.spans(r.text))
    assert want and sorted(tuple(r) for r in pii.find(df).collect()) == want
    changed = {r.doc_id for r in df.join(pii.redact(df).withColumnRenamed("text", "t"), "doc_id").where("text <> t").collect()}
    assert changed == {w[0] for w in want}


def test_edges(spark):
    schema = "doc_id bigint, text string, n_chars int, kind string, start string, score int"
    assert pii.find(spark.createDataFrame([], schema)).count() == 0 == pii.redact(spark.createDataFrame([], schema)).count()
    long = "word " * 200_000 + "a@b.example.org"
    rows = [(1, None, 5, "k", "s", 1), (2, "", 0, "k", "s", 1), (None, "x a@b.example.org", 17, "k", None, 1), (3, long, 1, "k", "s", 1), (3, long, 1, "k", "s", 1)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.start) for r in pii.find(df).collect()), key=str)
    assert got == [(3, 1_000_000), (3, 1_000_000), (None, 2)]
    out = pii.redact(df).collect()
    assert len(out) == 5 and [r.n_chars for r in out] == [5, 0, 9, 1_000_007, 1_000_007] and out[0].text is None and out[2].text == "x <EMAIL>"
    assert pii.redact(df).columns == df.columns


TAILS = [
    ("at +1 (826) 555-4081 190.137.223.204 now", [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")]),
    ("DE89 3704 0044 0532 0130 00 for payment", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("DE89370400440532013000 for payment", [("iban", "DE89370400440532013000")]),
    ("AB12 DE89 3704 0044 0532 0130 00 for payment", [("iban", "DE89 3704 0044 0532 0130 00")]),
    (f"{CARD} 123", [("card", CARD)]),
    (f"1234 {CARD} 123", [("card", CARD)]),
    ("4111 1111 1111 1112 123", []),
    ("DE88 3704 0044 0532 0130 00 for payment", []),
]


@pytest.mark.parametrize("text,want", TAILS)
def test_what_follows_or_precedes_hides_nothing(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in pii.spans(text)] == want


def word(c):
    return c.isalnum() or c == "_"


def brute(kind, text):
    """Start and end of the matches of a kind, by looking at every start and every end, without a pattern."""
    out, at, n = [], 0, len(text)
    before, after = (lambda i: text[i - 1] if i else " "), (lambda i: text[i] if i < n else " ")
    digits = lambda s: s.isascii() and s.isdigit()

    def ends(i):
        if kind == "email":
            j = i
            while j < n and (word(text[j]) or text[j] in ".+%-"):
                j += 1
            if not word(text[i]) or (i and (word(text[i - 1]) or text[i - 1] in ".+%-")) or j >= n or text[j] != "@" or ".." in text[i:j]:
                return
            k = j + 1
            while k < n and (text[k].isascii() and text[k].isalnum() or text[k] in ".-"):
                k += 1
            for e in range(k, j + 1, -1):
                labels = text[j + 1 : e].split(".")
                if len(labels) > 1 and all(x and x[0] != "-" and x[-1] != "-" for x in labels) and labels[-1].isalpha() and len(labels[-1]) > 1 and not word(after(e)) and after(e) != "@":
                    yield e
                    return
        elif kind == "ip" and text[i].isdigit() and not word(before(i)) and before(i) != ".":
            for e in range(min(n, i + 15), i + 6, -1):
                parts = text[i:e].split(".")
                if len(parts) == 4 and all(digits(p) and len(p) < 4 and (p == "0" or p[0] != "0") and int(p) < 256 for p in parts) and any(int(p) for p in parts) and not word(after(e)) and not (after(e) == "." and after(e + 1).isdigit()):
                    yield e
        elif kind == "ssn" and not word(before(i)) and before(i) != "-":
            parts = text[i : i + 11].split("-")
            if [len(p) for p in parts] == [3, 2, 4] and all(map(digits, parts)) and parts[0] not in ("000", "666") and parts[0] < "900" and parts[1] != "00" and parts[2] != "0000" and not word(after(i + 11)) and after(i + 11) != "-":
                yield i + 11
        elif kind == "card" and not word(before(i)) and before(i) not in ".,+-":
            for e in range(min(n, i + 23), i + 12, -1):
                s = text[i:e]
                sep = next((c for c in s if not c.isdigit()), "")
                sizes = [len(p) for p in s.split(sep)] if sep else [len(s)]
                form = sizes in ([k] for k in range(13, 20)) or sizes[:4] == [4] * 4 and (len(sizes) == 4 or len(sizes) == 5 and 0 < sizes[4] < 4) or sizes in ([4, 6, 4], [4, 6, 5])
                plain = s.replace(sep, "") if sep in ("", " ", "-") else ""
                if form and digits(plain) and len(set(plain)) > 1 and not word(after(e)) and after(e) != "-":
                    total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(plain)))
                    if total % 10 == 0:
                        yield e
        elif kind == "iban" and not word(before(i)) and text[i : i + 2].isascii() and text[i : i + 2].isalpha():
            size = int(pii.IBAN_LENGTHS.get(text[i : i + 2].upper(), 0))
            for e in range(min(n, i + 2 * size), i + size - 1, -1) if size else ():
                s = text[i:e]
                plain = s.replace(" ", "").upper()
                if len(plain) == size and " " not in (s[0:5].strip()[:4]) and "  " not in s and s[-1] != " " and plain.isascii() and plain.isalnum() and plain[2:4].isdigit() and not word(after(e)):
                    if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                        yield e

    while at < n:
        e = next(ends(at), None) if text[at].isalnum() or text[at] == "_" else None
        if e is not None:
            out.append((at, e))
        at = at + 1 if e is None else e
    return out


EXTRA = [t for t, _ in FOUND + TAILS] + ["a@b.c d@e.fg.", "x..y@ex.org", "-lead@ex.org ok_9%+@ex-a.co.uk,", "a@b.org@c.org", "5500-0000-0000-0004", "3782 822463 10005x 3782 822463 10005", "NO93 8601 1117 947", "no9386011117947", "1.1.1.1. 256.1.1.1 01.2.3.4", "123-45-6789-1 123-45-6789"]


def test_candidates_equal_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + EXTRA
    hits = dict.fromkeys(("email", "ip", "ssn", "card", "iban"), 0)
    for kind in pii.KINDS:
        if kind.name in hits:
            for text in texts:
                want = brute(kind.name, text)
                hits[kind.name] += len(want)
                assert list(pii.candidates(kind, text)) == want, (kind.name, text[:200])
    assert min(hits.values()) > 1, hits


@pytest.mark.parametrize("size", [24, 100, 129, 200, 5000])
def test_secrets_and_addresses_of_any_length(size):
    secret = ("a1B2c3D4e5F6g7H8" * size)[:size]
    for text, kind in ((f'token = "{secret}"', "credential"), (f"mail {secret}@mail.example.org now", "email")):
        (span,) = pii.spans(text)
        assert span.kind == kind and secret in text[span.start : span.end] and secret not in pii.redacted(text)


def test_long_runs_take_linear_time():
    import time

    for run in ("-" * 200_000, "a" * 200_000, "a." * 100_000, "1" * 100_000, "a@" * 50_000, "_" * 200_000 + "1", "1 " * 50_000):
        start = time.process_time()
        pii.spans(run + " token")
        assert time.process_time() - start < 20, run[:4]


def test_overlapping_and_tied_spans():
    # the best score wins, then the longer, then the earlier
    kinds = lambda t: [(s.kind, t[s.start : s.end]) for s in pii.spans(t)]
    assert kinds("mail 212-555-0187@mail.example.org") == [("email", "212-555-0187@mail.example.org")]
    assert kinds("card token 4111111111111111") == [("card", "4111111111111111")]
    assert kinds("call 212-555-0187 or 212-555-0188") == [("phone", "212-555-0187"), ("phone", "212-555-0188")]
    text = "call +1 212 555 0187 219-09-9999"
    spans = pii.spans(text)
    assert all(a.end <= b.start for a, b in zip(spans, spans[1:])) and spans == pii.spans(text)


def test_texts_without_spans_keep_their_length_column(spark):
    df = spark.createDataFrame([(1, "plain words", 999, "x"), (2, "to a@b.example.org", 999, "y"), (3, None, 7, None)], "doc_id bigint, text string, n_chars int, clean string")
    assert [(r.n_chars, r.clean) for r in pii.redact(df).orderBy("doc_id").collect()] == [(999, "x"), (10, "y"), (7, None)]
