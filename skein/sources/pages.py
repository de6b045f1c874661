"""Tables and charts inside HTML pages, a page a row; parsing is the standard library's, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a page's tables are called, by how many there are.
TABLE_LABELS = {
    14: ["Summary", "Top Primary Cell Types", "Top Input Types (Synapses / Partners)", "Top Output Types (Synapses / Partners)", "Top Input Regions", "Top Output Regions", "Neurotransmitter Types", "Side", "Flow", "Super Class", "Class", "Sub Class", "Nerve", "Hemilineage"],
    9: ["Summary", "Top Primary Cell Types", "Top Input Types (Synapses / Partners)", "Top Output Types (Synapses / Partners)", "Neurotransmitter Types", "Side", "Super Class", "Class", "Sub Class"],
}
#: Fixed value: how charts stand in a page's scripts.
CHART = r"(?s)chart_json = (\{.*?\});\s*elem = document\.createElement"


class _Tables(HTMLParser):
    """Rows of cells of each table, nested ones apart; text pieces of a cell are joined by spaces."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append({"rows": [], "cell": None})
            self.tables.append(self.open[-1]["rows"])
        elif self.open and tag == "tr":
            self._close()
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            self._close()
            self.open[-1]["cell"] = []

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"] is not None and data.strip():
            self.open[-1]["cell"].append(" ".join(data.split()))

    def _close(self) -> None:
        top = self.open[-1]
        if top["cell"] is not None:
            if not top["rows"]:
                top["rows"].append([])
            top["rows"][-1].append(" ".join(top["cell"]))
            top["cell"] = None


def tables_of(html: str) -> list[tuple[str, int, int, list[str]]]:
    """(label, table, row, cells) of all rows with cells."""
    parser = _Tables()
    parser.feed(html)
    parser.close()
    names = TABLE_LABELS.get(len(parser.tables), [f"Table {i + 1}" for i in range(len(parser.tables))])
    return [(names[i], i, j, row) for i, rows in enumerate(parser.tables) for j, row in enumerate(r for r in rows if r)]


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, label, table_idx, row_idx, cells) of every table row; a null or empty page has none."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, found = [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                rows = tables_of(page or "")
                take += [i] * len(rows)
                found += rows
            columns = [pa.array([x[j] for x in found], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())))]
            yield pa.record_batch([batch.column(0).take(pa.array(take, pa.int64())), *columns], [key, "label", "table_idx", "row_idx", "cells"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(parsed, f"`{key}` {kind}, label string, table_idx int, row_idx int, cells array<string>")


def html_charts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, idx, title, chart_type, color, label, value, data) of the charts in a page's scripts; data is the JSON of its rows.

    A big number has its label as title and no data; of other charts the title is the first cell.
    """
    raw = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(CHART), 1)).alias("idx", "json"))
    at = {c: F.get_json_object("json", f"$.{c}") for c in ("type", "color", "label", "value", "data")}
    big = at["type"] == "big_number"
    title = F.when(big, at["label"]).otherwise(F.get_json_object("json", "$.data[0][0]"))
    return raw.select(key, "idx", title.alias("title"), at["type"].alias("chart_type"), *[F.when(big, at[c]).alias(c) for c in ("color", "label", "value")], F.when(~big, at["data"]).alias("data"))


def charts_of(html: str) -> list[dict]:
    """The charts of one page, for tests and small tools."""
    return [json.loads(x) for x in re.findall(CHART, html)]
