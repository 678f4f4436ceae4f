r"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over the whole text finds at-signs, schemes, plus signs, digits and identifier cues.
From each anchor a local parser, linear in what it reads, expands to the span and validates it:

    email   left over [A-Za-z0-9._%+-] to the end of the span before, right over a dotted domain
    ip      a run of digits and dots, four parts of at most 255
    card    a run of digits with single spaces or hyphens, 16 to 19 digits, Luhn
    phone   from the plus sign, 8 to 15 digits
    url     scheme, `://` and what follows up to white space or a quote, if it names a user (`user@` or `user:secret@`)
    secret  after a cue (token, secret, api_key, password and the like, then `=` or `:`): the value, 8 characters or more
    iban    after the cue IBAN: country, check digits, account; valid by the remainder of 97

The first four are the base kinds and equal the leftmost non-overlapping matches of their patterns in the whole
text: a match of a kind lies in one maximal run of the characters which that kind's pattern takes, and starts at an anchor
(email: is bounded by one). The other kinds only add spans. Nothing is shuffled.

Defined cases: null and empty texts have no spans; very long texts and numbers take time in proportion to their length; an empty table gives no rows; every input
row, repeated or not, gives one row; other columns are ignored. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "secret", "iban")
CUES = ("token", "secret", "api_key", "apikey", "api-key", "password", "passwd", "access_key")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
FOUR = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"[^\s\"'<>]+")
USER = re.compile(r"[^/@\s\"'<>]++@[^/\s\"'<>]")
SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/=.-]{8,})")
IBAN = re.compile(r"[\s:]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30})")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def account_end(text: str) -> int:
    """Where the longest account of 15 characters or more ends that text begins with and whose remainder of 97 fits; 0 if none. Spaces don't count."""
    head = "".join(str(int(c, 36)) for c in text[:4])
    scale, tail, rest, n, end = 10 ** len(head), int(head), 0, 4, 0
    for i, c in enumerate(text[4:], 5):
        if c != " ":
            v = int(c, 36)
            rest, n = (rest * (100 if v > 9 else 10) + v) % 97, n + 1
            if n >= 15 and (rest * scale + tail) % 97 == 1:
                end = i
    return end


def automaton():
    """The anchors; kept by the worker."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, (1, "digit"))
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("IBAN", "iban"), *((x, "cue") for c in CUES for x in {c, c.upper(), c.capitalize()})):
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def spans(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    after = dict.fromkeys((*KINDS, "dotted"), 0)

    def keep(kind: str, start: int, end: int) -> None:
        found[kind].append((start, end))
        after[kind] = end

    for last, (width, what) in anchors.iter(text):
        at = last - width + 1
        if what == "digit":
            if at >= after["dotted"]:
                after["dotted"] = end = DOTTED.match(text, at).end()
                if text.count(".", at, end) > 2:
                    for m in FOUR.finditer(text[at:end]):
                        if all(len(y := x.lstrip("0")) < 4 and int(y or "0") < 256 for x in m.groups()):
                            found["ip"].append((at + m.start(), at + m.end()))
            if at >= after["card"]:
                m = SPACED.match(text, at)
                after["card"] = m.end() if m else last + 1
                if m and m.end() - at >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        keep("card", at, m.end())
        elif what == "at":
            start, least = at, after["email"]
            while start > least and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                keep("email", start, m.end())
        elif what == "plus":
            if at >= after["phone"] and (m := PLUS.match(text, at)):
                after["phone"] = m.end()
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    keep("phone", at, m.end())
        elif what == "scheme":
            start, least = at, after["url"]
            while start > least and at - start < 32 and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-")):
                start -= 1
            if start < at and USER.match(text, last + 1):  # which reads to the next slash at most
                keep("url", start, URL_REST.match(text, last + 1).end())
        elif what == "cue":
            if at >= after["secret"] and (m := SECRET.match(text, last + 1)):
                keep("secret", *m.span(1))
        elif m := IBAN.match(text, last + 1):
            if end := account_end(m[1]):  # a word in capitals may follow
                keep("iban", m.start(1), m.start(1) + end)
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find(docs: DataFrame) -> DataFrame:
    """One row per document: SCHEMA. n_spans counts the spans of all kinds."""
    names, types = [*(x.split()[0] for x in SCHEMA.split(", "))], [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                found = spans(text.as_py() or "", anchors)
                rows.append((doc_id, *(len(found[k]) for k in BASE), hashlib.sha256(joined(found, BASE).encode()).hexdigest(), joined(found, KINDS), sum(map(len, found.values()))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by `[kind]`; of overlapping spans the one that starts first, then the longest, counts."""

    def run(texts):
        anchors = automaton()

        def clean(text: str | None) -> str | None:
            if text is None:
                return None
            out, done = [], 0
            for start, end, kind in sorted(((s, e, k) for k, v in spans(text, anchors).items() for s, e in v), key=lambda x: (x[0], -x[1])):
                if start >= done:
                    out += [text[done:start], f"[{kind}]"]
                    done = end
            return "".join(out) + text[done:]

        return texts.map(clean)

    return docs.withColumn("text", F.pandas_udf(run, "string")("text"))
