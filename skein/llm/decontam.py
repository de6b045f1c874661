"""Benchmark decontamination with spaced seeds (after Ma, Tromp and Li's PatternHunter), all in Spark SQL functions.

A mask names the positions of a window that must agree; the others are ignored, so a substituted word
spoils only seeds that look at it. The masked words of every window of every benchmark item and of
every document are hashed and joined. Around each hit item and document are laid side by side and
the agreeing positions of the whole overlap are counted: a document is contaminated if at least
``item_share`` of an item agrees, or ``near`` of ``span`` adjoining positions do.

The masks are all that look at three of five adjoining words, so any three agreeing words within five are a hit. Both
rules imply such a place at their standing values: were there none, at most two of each five words and two of
the rest would agree, which is less than 0.6 of five words or more. So no substitution hides an alignment that
counts. Of items of three and four words any two agreeing words within three are a hit; items of one and two are looked up whole.

Words are the lower-cased runs of non-space characters.

Cases: null or empty texts and items agree with nothing; texts of any length count whole; items that share an item_id are
one item, each text of which counts; rows are judged by id and text, so rows that share an id (null included) don't touch each other;
of items that agree alike the least item_id is told; empty tables give no overlaps; extra columns don't matter, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SPACES, fresh_name

#: Fixed masks: the offsets that count.
MASKS = tuple((0, a, b) for b in range(2, 5) for a in range(1, b))
#: Masks of items of three and four words.
SHORT_MASKS = ((0, 1), (0, 2))
SPAN = 13
#: Seeds of the benchmark, with the words of their items, are sent to all executors up to so many bytes.
BROADCAST_BYTES = 48 << 20


def word_hashes(text: Column) -> Column:
    """A hash for each word of the whole text; an empty array for none."""
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, SPACES)).otherwise(F.array().cast("array<string>"))
    return F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(w))


def seed(hashes: Column, at: Column, mask: tuple[int, ...]) -> Column:
    """Hash of the masked words of the window at ``at``; null where the window leaves the text."""
    whole = at + mask[-1] < F.size(hashes)
    return F.when(whole, F.xxhash64(F.lit(",".join(map(str, mask))), *[F.get(hashes, at + o) for o in mask]))


def seeds(df: DataFrame, masks: list[tuple[int, ...]], keep: list[str]) -> DataFrame:
    """A row (keep..., h, at, seed) for each window and mask of the rows' ``h``."""
    shortest = min(m[-1] for m in masks) + 1
    # no filter on the size of h: it would be pushed below and hash all words twice
    starts = F.when(F.size("h") >= shortest, F.sequence(F.lit(0), F.size("h") - shortest))
    rows = df.select(*keep, "h", F.explode(starts).alias("at"))
    return rows.select(*keep, "h", "at", F.explode(F.array(*[seed(F.col("h"), F.col("at"), m) for m in masks])).alias("seed")).where("seed is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, item_share: float = 0.6, near: int = 11, span: int = SPAN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, item_id, agree, share) for each overlap of a document and an item that counts as contamination; mark is a hash of the document's text.

    Documents are not shuffled as long as the counted bytes of the benchmark's seeds are within the broadcast
    bound; beyond it the join shuffles seeds by hash, and skewed seeds are split by adaptive execution.
    """
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    short = {r[0] for r in items.where(F.size("h") < 5).select(F.size("h")).distinct().collect()}
    # words of an item, and the masks for it
    sizes = [(F.size("h") >= 5, MASKS), *[(F.size("h") == n, SHORT_MASKS if n > 2 else (tuple(range(n)),)) for n in sorted(short)]]
    known = reduce(DataFrame.unionByName, [seeds(items.where(these), list(masks), ["item_id"]) for these, masks in sizes])
    masks = sorted({m for _, masks in sizes for m in masks})
    known = known.select("seed", "item_id", F.col("h").alias("item"), F.col("at").alias("item_at"))
    size = known.agg(F.sum(8 * F.size("item") + 64)).first()[0] or 0
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), word_hashes(F.col(text)).alias("h"))
    hits = seeds(rows, masks, ["doc_id", "mark"]).join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "seed")

    # Up to here all is one generated loop over positions: nothing but a hit leaves it, with the words beside the item
    # only. Higher-order functions would break the loop, so they wait until hits of one alignment are merged.
    start = F.col("at") - F.col("item_at")  # where the item's first word would stand
    skipped = F.greatest(F.lit(0), -start)
    length = F.least(F.size("item"), F.size("h") - start) - skipped
    hits = hits.select("doc_id", "mark", "item_id", F.xxhash64("item").alias("item_mark"), start.alias("start"), F.size("item").alias("n"), F.slice("h", start + skipped + 1, length).alias("ours"), F.slice("item", skipped + 1, length).alias("theirs"))
    beside = hits.groupBy("doc_id", "mark", "item_id", "item_mark", "start").agg(*[F.first(c).alias(c) for c in ("n", "ours", "theirs")])
    beside = beside.withColumn("same", F.zip_with("ours", "theirs", lambda a, b: (a == b).cast("int")))

    def agreeing(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda n, x: n + x)

    windows = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("same") - span + 1))
    run = F.array_max(F.transform(windows, lambda i: agreeing(F.slice("same", i, span))))
    return (
        beside.withColumn("agree", agreeing(F.col("same")))
        .where((F.col("agree") >= item_share * F.col("n")) | (run >= near))
        .select("doc_id", "mark", "item_id", "agree", (F.col("agree") / F.col("n")).alias("share"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, and how many items it holds, with the best of them."""
    best = F.max(F.struct("share", "agree", (-F.col("item_id")).alias("item")))
    found = overlaps(docs, benchmark, key=key, text=text, **how).groupBy("doc_id", "mark").agg(best.alias("best"), F.count_distinct("item_id").alias("n_items"))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("mark").alias("found_mark"), "best", "n_items")
    out = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark")).join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark")), "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), (-F.col("best.item")).alias("item_id"), F.coalesce("best.agree", F.lit(0)).alias("agree"), F.coalesce("best.share", F.lit(0.0)).alias("share"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged."""
    at, mark = fresh_name(docs, "found_id"), fresh_name(docs, "found_mark")
    found = overlaps(docs, benchmark, key=key, text=text).select(F.col("doc_id").alias(at), F.col("mark").alias(mark)).distinct()
    return docs.join(found, F.col(key).eqNullSafe(F.col(at)) & (F.xxhash64(F.col(text)) == F.col(mark)), "left_anti")
