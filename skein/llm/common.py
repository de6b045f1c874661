"""What the operators of this subpackage share: the shared folder, staged tables, text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.staging import stage as stage  # the operators of this subpackage take it from here

#: One whitespace class for every operator; equal to what ``bytes.split()`` splits on.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: A table of at most so many rows may be broadcast (a few MB); beyond it, joins shuffle.
BROADCAST_ROWS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(col: Column) -> Column:
    """Bytes of a text; a null text is empty."""
    return F.coalesce(col, F.lit("")).cast("binary")


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores after it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bits_for(rows: int, per_bucket: int, least: int = 4, most: int = 24) -> int:
    """Leading hash bits that keep hash buckets of ``rows`` at about ``per_bucket`` rows."""
    return max(least, min(most, (max(rows, 1) // per_bucket).bit_length()))
