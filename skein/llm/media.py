"""Media columns: interleaved document sequences.

HTML is parsed into an ordered sequence of structs: runs of text and references to media, each media
with its caption (figcaption, else alt, else title). References are digests; a join by digest resolves
them against a media table, and positions and captions stay with their reference.

Payloads are stored as binary greymaps: rows of 192 samples of 8 bits under a short header, lossless
and readable by any image library. Only digests are shuffled; stored bytes are read where they lie.

Cases: a null or empty page is an empty sequence; unclosed and stray tags are tolerated, script and style
are skipped; a reference without a stored media keeps its row with null payload columns; a reference that
occurs again keeps each position; media stored several times resolve once; a null text is an empty one, a text of any length is
stored whole; equal texts have equal media; rows that share an id keep a row each; an empty table stays empty; columns of the
input that are named like the sequence, position, caption or digest are replaced, others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import fresh_name, stage, utf8

WIDTH = 192
SCHEME = "media:"
SEQUENCE = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"
#: Fixed lists of HTML: what ends a run of text, what is never text, what refers to media.
BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table article section header footer nav blockquote pre figure figcaption main aside hr body html title".split())
HIDDEN = frozenset("script style noscript template head".split())
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed"}


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.run: list[str] = []
        self.hidden: list[str] = []
        self.figure: list[int] | None = None  # media of the open figure
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run.clear()
        if text:
            self.out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden:
            if tag in HIDDEN:
                self.hidden.append(tag)
            return
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif tag in MEDIA:
            had = dict(attrs)
            ref = had.get("src") or had.get("data-src")
            if ref:
                self.flush()
                self.out.append({"kind": MEDIA[tag], "text": None, "ref": ref, "caption": had.get("alt") or had.get("title")})
                if self.figure is not None:
                    self.figure.append(len(self.out) - 1)
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []
            elif tag == "figcaption" and self.figure is not None:
                self.caption = []

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
            return
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for i in self.figure or ():
                self.out[i]["caption"] = text or self.out[i]["caption"]
            self.caption = None
        elif tag == "figure":
            self.figure = None
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """Ordered text and media structs of one page, with positions from 0."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    if parser.caption is not None:  # never closed
        parser.handle_endtag("figcaption")
    parser.flush()
    return [{"position": i, **x} for i, x in enumerate(parser.out)]


def interleave(df: DataFrame, html: str, into: str = "sequence") -> DataFrame:
    """``df`` with the sequence of its pages in a column."""

    @F.udf(returnType=SEQUENCE, useArrow=True)
    def parsed(page: str) -> list[dict]:
        return parse_sequence(page)

    return df.withColumn(into, parsed(F.col(html)))


def resolve(df: DataFrame, media: DataFrame, sequence: str = "sequence") -> DataFrame:
    """A row for each media reference of ``df``'s sequences, with the columns of the media of that digest.

    ``media`` has one row a digest. References of a very common digest are split by adaptive execution:
    both sides are plain exchanges.
    """
    m = fresh_name(df, "media_of")
    refs = df.withColumn(m, F.explode(F.filter(sequence, lambda x: x["ref"].isNotNull()))).drop(sequence)
    refs = refs.withColumns({"position": F.col(m)["position"], "caption": F.col(m)["caption"], "digest": F.regexp_replace(F.col(m)["ref"], f"^{SCHEME}", "")}).drop(m)
    return refs.join(media, "digest", "left")


def pack(text: bytes) -> bytes:
    """The stored form of a text: a greymap whose samples are the text and spaces up to whole rows."""
    rows = max(1, -(-len(text) // WIDTH))
    return b"P5 %d %d 255\n" % (WIDTH, rows) + text.ljust(rows * WIDTH, b" ")


def unpack(media: bytes) -> np.ndarray:
    """Samples of a stored greymap, by rows."""
    head, _, body = media.partition(b"\n")
    magic, width, rows, top = head.split()
    if magic != b"P5" or top != b"255" or len(body) != int(width) * int(rows):
        raise ValueError("not a greymap of 8-bit samples")
    return np.frombuffer(body, np.uint8).reshape(int(rows), int(width))


def feature(samples: np.ndarray) -> str:
    """Mean and spread of all samples and a 64-bit mark: which of 64 column bands are brighter than the mean."""
    bands = samples.sum(axis=0, dtype=np.int64).reshape(64, -1).sum(axis=1)
    total, n = int(bands.sum()), samples.size
    square = int(np.einsum("ij,ij->", samples, samples, dtype=np.int64))
    mark = int.from_bytes(np.packbits(bands * 64 > total).tobytes(), "big")
    return f"{total / n:.4f} {max(0.0, square / n - (total / n) ** 2):.4f} {mark:016x}"


def page(stored: DataFrame) -> Column:
    """HTML of a stored text: its lines as paragraphs, and after the first one a figure that refers to the media by digest. Nothing of it is stored."""
    payload = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / WIDTH)) * WIDTH
    text = F.decode(F.substring(stored["media"], (F.length("media") - payload + 1).cast("int"), F.col("n_bytes").cast("int")), "UTF-8")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    figure = F.concat(F.lit("<figure><img alt='samples' src='" + SCHEME), F.col("digest"), F.lit("'><figcaption>"), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure>"))
    whole = F.concat(F.slice(lines, 1, 1), F.array(figure), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))))
    return F.concat(F.lit("<article>"), F.array_join(whole, ""), F.lit("</article>"))


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table of every row's media, with an HTML page of the text that refers to it by digest, made as it is read."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [x.as_buffer() for x in batch.column(1)]
                media = [pack(memoryview(x).tobytes()) for x in texts]
                yield pa.record_batch([batch.column(0), pa.array([x.size for x in texts], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "digest", "media"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("doc_id"), utf8(F.col(text)).alias("text")).mapInArrow(packed, f"doc_id {kind}, n_bytes long, digest string, media binary")
    stored = stage(rows, "media")
    return stored.withColumn("html", page(stored))


def read_back(stored: DataFrame) -> DataFrame:
    """One row a digest: what the stored bytes hold, read from the table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                rows = []
                for digest, media in zip(whole.column(0).slice(at, 1000), whole.column(1).slice(at, 1000), strict=True):
                    held = memoryview(media.as_buffer()).tobytes()
                    samples = unpack(held)
                    payload = samples.tobytes()
                    rows.append((digest.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-16:]), len(held), hashlib.sha256(held).hexdigest(), feature(samples)))
                names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), preserve_index=False)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stage(stored.select("digest", "media").mapInArrow(read, schema).dropDuplicates(["digest"]), "features")
