"""Secret scan with a recursive decoding worklist.

A text is scanned for secrets; then it is URL-unescaped and Unicode-unescaped as a whole, every base64 token in it is
unwrapped, and compressed bytes inside are inflated, which gives further layers that are scanned and unwrapped in turn,
until no layer is new. An unescaped layer reports what its parents didn't show at the same span. A layer met before (by its digest) is not entered again, so cycles end. Every character of
a layer knows which span of the root text it comes from, so each finding is mapped back.

Kinds: assign, access, hex in the root (the base, by fixed rules); the same after the path of
decoders that led to it, such as ``base64.zlib.assign``; ``bomb`` for compressed data beyond MAX_LAYER bytes,
which is reported, and scanned part by part as it is inflated. Parts share 64 KB: a secret longer than that is met in pieces.
Decoded bytes that are not UTF-8 are read as latin-1.

Cases: a null or empty text has no spans; offsets are code points of the root, ends exclusive; what can't
be decoded is left as it is; equal findings from several layers with one span and kind count once;
repeated rows give equal results, a row each; a null id is an id; a text of any length is scanned whole; of findings at one place the
kinds stand in the order of BASE, then by name; an empty table stays empty; ``scan_secrets`` returns its own columns only, whatever
others there are.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections import deque
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind: string, start: int, end: int>>"
MAX_LAYER = 64 << 20
#: Inflated bytes beyond MAX_LAYER are scanned in parts of PART bytes that share OVERLAP bytes.
PART, OVERLAP = 8 << 20, 64 << 10

#: Fixed patterns; letters of the keys in either case.
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _either_case(word: str) -> str:
    return "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in word)


_ASSIGN = re.compile("(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# a run that is too short fails as a whole, and so does any run inside it
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}={0,2}")
#: Lines of one encoded block: full ones of equal alphabet, then the last.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{22,}[ \t]*(?:\r\n|\n|\r)[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_URL_TABLE = str.maketrans("-_", "+/")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Findings of one layer, by start, then in the order of BASE."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], BASE.index(x[0])))


class Layer:
    """A decoded text: its path of decoders, and for each character where its source starts and ends in the root."""

    def __init__(self, text: str, path: str, starts, ends) -> None:
        self.text, self.path, self.starts, self.ends = text, path, starts, ends
        self.found: set[tuple[str, int, int]] = set()  # base kinds met here or in a layer it came from, by spans of the root

    def root(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        if isinstance(self.starts, int):  # opaque: all from one span
            return self.starts, self.ends
        return self.starts[start], self.ends[end - 1]

    def name(self, kind: str) -> str:
        return f"{self.path}.{kind}" if self.path else kind


def _unescape(layer: Layer, marks: re.Pattern, name: str) -> Layer | None:
    """The whole layer unescaped: every character keeps its own span, so keys outside an escaped run stay beside it.

    Runs of escaped bytes are read as UTF-8.
    """
    text, at = layer.text, 0
    out: list[str] = []
    froms: list[int] = []
    tos: list[int] = []

    def put(chars: str, s: int, e: int) -> None:
        s, e = layer.root(s, e)
        out.append(chars)
        froms.extend([s] * len(chars))
        tos.extend([e] * len(chars))

    def keep(s: int, e: int) -> None:
        out.append(text[s:e])
        if layer.starts is None:
            froms.extend(range(s, e))
            tos.extend(range(s + 1, e + 1))
        elif isinstance(layer.starts, int):
            froms.extend([layer.starts] * (e - s))
            tos.extend([layer.ends] * (e - s))
        else:
            froms.extend(layer.starts[s:e])
            tos.extend(layer.ends[s:e])

    while m := marks.search(text, at):
        keep(at, m.start())
        at = m.start()
        if m[0].startswith("\\u"):
            # two halves of a surrogate pair are one character of one span
            pair = marks.match(text, m.end()) if 0xD800 <= int(m[0][2:], 16) < 0xDC00 else None
            if pair and pair[0].startswith("\\u") and 0xDC00 <= int(pair[0][2:], 16) < 0xE000:
                put(chr(0x10000 + (int(m[0][2:], 16) - 0xD800 << 10) + int(pair[0][2:], 16) - 0xDC00), at, pair.end())
                at = pair.end()
            else:
                c = chr(int(m[0][2:], 16))
                put("\ufffd" if "\ud800" <= c <= "\udfff" else c, at, m.end())
                at = m.end()
        else:
            run, first = bytearray(), at
            while m and not m[0].startswith("\\u"):
                run.append(int(m[0][-2:], 16))
                at = m.end()
                m = marks.match(text, at)
            try:
                width = (at - first) // len(run)
                for c, size in ((c, len(c.encode())) for c in run.decode()):
                    put(c, first, first + size * width)
                    first += size * width
            except UnicodeDecodeError:
                put(run.decode("latin-1"), first, at)
    if not out:
        return None
    keep(at, len(text))
    return Layer("".join(out), layer.name(name), froms, tos)


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _inflated(data: bytes, bits: int) -> Iterator[bytes]:
    """Parts of what ``data`` holds, all its members one after the other; ends where bytes are no longer compressed data."""
    while data:
        d = zlib.decompressobj(bits)
        try:
            out = d.decompress(data, PART)
            while out or d.unconsumed_tail:
                yield out
                out = d.decompress(d.unconsumed_tail, PART)
            if rest := d.flush():
                yield rest
        except zlib.error:
            return
        # members may be followed by padding
        data = d.unused_data.lstrip(b"\0") if d.eof else b""


def _inflate(data: bytes) -> tuple[str, Iterator[bytes]] | None:
    """(name, parts) of compressed data."""
    for name, bits, magic in (("gzip", 31, b"\x1f\x8b"), ("zlib", 15, b"\x78")):
        if data.startswith(magic):
            parts = _inflated(data, bits)
            if first := next(parts, None):
                return name, chain([first], parts)
    return None


def _bytes64(raw: str) -> bytes | None:
    raw = raw.rstrip("=").translate(_URL_TABLE)
    if len(raw) % 4 == 1:
        return None
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _unpacked(data: bytes, path: str) -> Iterator[tuple[str, str | None]]:
    """(path, text) of decoded bytes, inflated as often as needed, in overlapping parts beyond MAX_LAYER, where (path, None) tells of the bomb."""
    seen = set()
    while (got := _inflate(data)) and (mark := blake2b(data).digest()) not in seen:
        seen.add(mark)
        path = f"{path}.{got[0]}"
        held = bytearray()
        for part in got[1]:
            held += part
            if len(held) > MAX_LAYER:
                break
        data = bytes(held)
        if len(held) > MAX_LAYER:
            yield path, None
            yield path, _text(data)
            tail = data[-OVERLAP:]
            del data, held
            for part in got[1]:
                yield path, _text(tail + part)
                tail = (tail + part)[-OVERLAP:]
            return
    if data:
        yield path, _text(data)


def _decode64(layer: Layer, start: int, end: int, raw: str) -> Iterator[tuple[str, Layer | None]]:
    """(path, child) for what is in a base64 token, with None for a child where a bomb is met."""
    if data := _bytes64(raw):
        for path, text in _unpacked(data, layer.name("base64")):
            yield path, None if text is None else Layer(text, path, *layer.root(start, end))


def _tokens64(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, alphabet characters) of base64 tokens: blocks of lines of one length first, then each run."""
    for m in _WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in _LINE.finditer(text, m.start(), m.end())]
        at = 0
        while at < len(lines):
            width, to = lines[at][1] - lines[at][0], at + 1
            while to < len(lines) and lines[to - 1][1] - lines[to - 1][0] == width and lines[to][1] - lines[to][0] <= width:
                to += 1
            # a shorter last line may be the text that follows the block
            for last in (to, to - 1) if lines[to - 1][1] - lines[to - 1][0] < width else (to,):
                if last - at > 1:
                    yield lines[at][0], lines[last - 1][1], "".join(text[a:b] for a, b in lines[at:last])
            at = to
    for m in _BASE64.finditer(text):
        yield *m.span(), m[0]


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text, by start, then base kinds first."""
    found = dict.fromkeys(base_spans(text))
    root = Layer(text, "", None, None)
    root.found = set(found)
    seen, work, tried = {blake2b(text.encode(errors="surrogatepass"), digest_size=16).digest()}, deque([root]), set()
    while work:
        layer = work.popleft()
        t = layer.text

        def children(layer: Layer = layer, t: str = t) -> Iterator[Layer | None]:
            if "%" in t:
                yield _unescape(layer, _PERCENT, "url")
            if "\\u" in t or "\\x" in t:
                yield _unescape(layer, _ESCAPE, "unicode")
            if _BASE64.search(t):
                for start, end, raw in _tokens64(t):
                    token = (blake2b(raw.encode()).digest(), *layer.root(start, end))
                    if token not in tried:
                        tried.add(token)
                        for path, child in _decode64(layer, start, end, raw):
                            if child is None:
                                found[(f"{path}.bomb", *layer.root(start, end))] = None
                            yield child

        for child in children():
            if child is None:
                continue
            mark = blake2b(child.text.encode(errors="surrogatepass"), digest_size=16).digest()
            # equal layers elsewhere in the root hold findings of their own, so the span is part of the mark
            mark += repr(child.root(0, len(child.text))).encode()
            if mark not in seen:
                seen.add(mark)
                child.found = {(k, *child.root(s, e)) for k, s, e in base_spans(child.text)}
                # text that an unescaped layer keeps shows again what was found without unescaping
                old = layer.found if child.starts.__class__ is list else set()
                found |= {(child.name(k), *span): None for k, *span in child.found if (k, *span) not in old}
                child.found |= old
                work.append(child)
    order = {k: i for i, k in enumerate(BASE)}
    return sorted(found, key=lambda x: (x[1], order.get(x[0], len(BASE)), x[0], x[2]))


def secret_spans(text: Column) -> Column:
    """Array of (kind, start, end) of a text column; one map, no shuffle."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(x)] if x else [])

    return found(F.coalesce(text, F.lit("")))


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds in the root, the digest of the base spans, and all spans."""
    rows = df.select(F.col(key).alias("doc_id"), secret_spans(F.col(text)).alias("s"))

    def joined(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    base = F.filter("s", lambda x: x["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
