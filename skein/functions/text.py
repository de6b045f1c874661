"""Column functions over labels, names and solver output."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def type_or_untyped(label: Column) -> Column:
    """Null, blank and "nan" labels are "untyped"."""
    trimmed = F.trim(label)
    return F.when(label.isNull() | (trimmed == "") | (F.lower(trimmed) == "nan"), F.lit("untyped")).otherwise(trimmed)


def numeric_prefix(text: Column) -> Column:
    """The number a text starts with, thousands separators dropped; null without one."""
    return F.regexp_replace(F.regexp_extract(text, r"^\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")


def safe_name(text: Column) -> Column:
    """File-name form: runs of other characters than letters, digits, dot, dash and underscore become one underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def arrow_row(line: Column) -> Column:
    """Ids of a row "a -> b -> c"."""
    return F.transform(F.split(F.trim(line), r"\s*->\s*"), lambda x: x.try_cast("bigint"))


def sample_id(given: Column, log: Column) -> Column:
    """The sample id of a row: as given, else from a log name "<pair>.n<size>.<id>.stdout.log"; null without either."""
    named = F.regexp_extract(F.coalesce(log, F.lit("")), r"\.n[0-9]+\.([^./]+)\.stdout\.log$", 1)
    return F.when(F.coalesce(given, F.lit("")) != "", given).when(named != "", named)


def header_slug(name: str) -> str:
    """A column name for a field's summary: lower case, spaces and slashes as underscores, no parentheses."""
    return "".join("_" if c in " /" else c for c in name.lower() if c not in "()")


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore, none at the ends; "plot" if nothing is left."""
    found = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(found == "", F.lit("plot")).otherwise(found)


def ids_of(text: Column) -> Column:
    """Ids of a space-joined list; an empty text has none."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.cast("bigint"))


def ids_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def fixed(x: Column, digits: int = 6) -> Column:
    """A double as text with ``digits`` decimals, like C's printf: its binary value is rounded, true halves to even.

    Java rounds the decimals it shows of a double, and those may be a half where the double itself is above or below.
    """

    @F.arrow_udf("string")
    def shown(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{digits}f}" for v in values.to_pylist()], pa.string())

    return shown(x.cast("double"))


def fixed_ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """A ratio as text with ``digits`` decimals; 0 of nothing, null of an unknown."""
    return fixed(F.when(whole == 0, F.lit(0.0)).otherwise(part / whole), digits)


def fold(part: Column, background: Column) -> Column:
    """part / background, infinite where the background is 0."""
    return F.when(background > 0, part / background).otherwise(F.lit(float("inf")))


def dense_gib(left: Column, right: Column) -> Column:
    """GiB of two dense 4-byte matrices of each graph, original and sorted."""
    return 8.0 * (left * left + right * right) / float(1 << 30)
