"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs, digits, URL schemes, street
words and account cues. Around each anchor a local parser expands to the longest span of its kind, from left
to right and never into a span of that kind already taken, and validates it.

Kinds: email, ip, card, phone (the base, by fixed rules), then url, address, account.

Cases: a null or empty text has no spans; offsets are code points, ends exclusive; spans of one kind never
overlap, spans of different kinds may; a candidate that fails its check is dropped and not tried again
from inside; repeated rows give equal results, a row each; a null id is an id; a text of any length is scanned whole; an empty table
stays empty; ``scan_pii`` returns its own columns only, whatever others there are; ``redact`` keeps all, and a null text stays null.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "address", "account")
SPANS = "array<struct<kind: string, start: int, end: int>>"

#: Fixed patterns of what stands to the right of an anchor.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z]+://[^\s<>\"'|]+")
_ACCOUNT = re.compile(r"[ ]?(?:number|no\.?|nr\.?|#)?[ ]?[:=#]?[ ]?([A-Z]{0,4}[0-9][A-Z0-9 -]{4,32}[0-9])")
_HOUSE = re.compile(r"([0-9]{1,5}[A-Za-z]? (?:[A-Z][A-Za-z'.-]* ){1,4})\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Fixed cues.
_SCHEMES = ("http://", "https://", "ftp://")
_STREETS = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive")
_CUES = ("IBAN", "iban", "SSN", "ssn", "Account", "account", "Passport", "passport")


@cache
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789"), ("url", _SCHEMES), ("street", _STREETS), ("cue", _CUES)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        n = ord(x) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _iban(text: str) -> bool:
    text = text.replace(" ", "").replace("-", "")
    return len(text) >= 15 and text[:2].isalpha() and int("".join(str(int(x, 36)) for x in text[4:] + text[:4])) % 97 == 1


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text, by kind in the order of KINDS, then by start."""
    got: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    upto = dict.fromkeys(KINDS, 0)  # where the next candidate of a kind may start

    def take(kind: str, start: int, end: int, valid: bool = True) -> None:
        upto[kind] = end
        if valid:
            got[kind].append((start, end))

    for last, (kind, size) in _anchors().iter(text):
        at = last + 1 - size
        if kind == "0":
            if at >= upto["ip"] and (at == 0 or text[at - 1] not in "0123456789" or at == upto["ip"]) and (m := _IP.match(text, at)):
                take("ip", at, m.end(), all(len(x.lstrip("0")) <= 3 and int("0" + x.lstrip("0")) <= 255 for x in m[0].split(".")))
            if at >= upto["card"]:
                m = _CARD.match(text, at)
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    take("card", at, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
        elif kind == "@":
            start = at
            while start > upto["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                take("email", start, m.end())
        elif kind == "+":
            if at >= upto["phone"] and (m := _PHONE.match(text, at)):
                take("phone", at, m.end(), 9 <= sum(x in "0123456789" for x in m[0]) <= 15)
        elif kind == "url":
            if at >= upto["url"] and (m := _URL.match(text, at)):
                end = at + len(m[0].rstrip(".,;:!?)]}"))
                take("url", at, end, end > last + 1)
        elif kind == "street":
            if at >= upto["address"] and (m := _HOUSE.search(text, max(upto["address"], at - 120), at)):
                take("address", m.start(), last + 1)
        elif last + 1 >= upto["account"] and (m := _ACCOUNT.match(text, last + 1)):
            value = m[1]
            valid = _iban(value) if text[at : last + 1].lower() == "iban" else sum(x.isdigit() for x in value) >= 5
            take("account", m.start(1), m.end(1), valid)
    return [(k, s, e) for k in KINDS for s, e in got[k]]


def pii_spans(text: Column) -> Column:
    """Array of (kind, start, end) of a text column; one map, no shuffle."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(x)] if x else [])

    return found(F.coalesce(text, F.lit("")))


def redact(df: DataFrame, text: str = "text", into: str = "redacted") -> DataFrame:
    """``df`` with its texts in which each span is replaced by its kind in brackets; the longest first where they overlap."""

    @F.pandas_udf("string")
    def covered(texts: pd.Series) -> pd.Series:
        def one(x: str) -> str:
            out, at = [], 0
            for k, s, e in sorted(find_spans(x), key=lambda y: (y[1], -y[2])):
                if s >= at:
                    out += [x[at:s], f"[{k}]"]
                    at = e
            return "".join([*out, x[at:]])

        return texts.map(one, na_action="ignore")

    return df.withColumn(into, covered(F.col(text)))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def scan_pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, the digest of the base spans, and all spans."""
    rows = df.select(F.col(key).alias("doc_id"), pii_spans(F.col(text)).alias("s"))
    base = F.filter("s", lambda x: x["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
