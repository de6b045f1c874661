"""Mixing sources to target weights as a time-varying curriculum.

Every source has a schedule: its weight over training time 0 to 1, linear between knots. The integral
of the schedule is the source's weight in the whole mix. Targets share the demanded words by weight;
none exceeds ``most`` times its source, the excess goes to the others by weight until none does.
A source's words are laid end to end in the order of a hash of the id (again from the start for the
second pass), and the copy that starts at word c gets the training time at which the source's
cumulative demand reaches c. Range-sorting copies by that time gives the training order.

Cases: null texts have size 0; documents without words take nothing but are placed if their turn comes
before the target; a null source is a source, the last one; repeated ids are mixed as rows of their
own; a text of any length counts whole; ids that hash alike go by id and size; the last copy of a source may be cut inside
(``words`` tells), so that taken words meet the target exactly but for rounding; an empty table stays empty; extra columns
don't matter, whatever their names. The number of sources is a matter of
configuration (each has a schedule): beyond ``MAX_SOURCES`` the operator raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import WORDS, bits_for, stage

#: Weights of sources in the order of their names, repeating.
CYCLE = (3, 1, 2)
#: Relative slope of those sources' schedules: the first kind fades, the second grows.
SLOPES = (0.5, -0.5, 0.0)
MAX_SOURCES = 50_000
ROWS_PER_BUCKET = 20_000

Schedule = list[tuple[float, float]]


def cyclic_schedule(rank: int) -> Schedule:
    """Knots (time, weight) of the source of this rank; they integrate to its cyclic weight."""
    w, a = CYCLE[rank % len(CYCLE)], SLOPES[rank % len(SLOPES)]
    return [(0.0, w * (1 + a)), (1.0, w * (1 - a))]


def integrate(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def share(sizes: list[int], weights: list[float], demand: float, most: float) -> list[float]:
    """Targets by weight up to ``most`` times each size: the level at which the demand is met."""
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    rest, pull = demand, sum(weights)
    level = 0.0
    for i in order:
        level = rest / pull
        if level <= most * sizes[i] / weights[i]:
            break
        rest, pull = rest - most * sizes[i], pull - weights[i]
        if pull <= 0:
            level = float("inf")
            break
    return [float(min(most * s, w * level)) if s else 0.0 for s, w in zip(sizes, weights, strict=True)]


def segments(schedule: Schedule, target: float) -> list[tuple[float, float, float, float]]:
    """(demand before, time, rate at its start, change of the rate) of each linear piece, scaled to the target."""
    total, done, out = integrate(schedule), 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        if t1 > t0 and w0 + w1 > 0 and total > 0:
            scale = target / total
            out.append((done, t0, w0 * scale, (w1 - w0) / (t1 - t0) * scale))
            done += (t1 - t0) * (w0 + w1) / 2 * scale
    return out


def when_reached(words: Column, pieces: Column) -> Column:
    """Training time at which a source has been asked for ``words`` words: the inverse of cumulative demand."""
    piece = F.element_at(F.filter(pieces, lambda p: p["done"] <= words), -1)
    more = words - piece["done"]
    root = F.sqrt(F.greatest(F.lit(0.0), piece["rate"] * piece["rate"] + 2 * piece["slope"] * more))
    return piece["time"] + F.when(more <= 0, F.lit(0.0)).otherwise(2 * more / (piece["rate"] + root))


def plan_mix(df: DataFrame, share_of_words: float = 1.5, most: int = 2, schedule_of: Callable[[int], Schedule] = cyclic_schedule, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row of ``df``: key, size, source_size, target, taken, and its copies with position and words.

    Only ids, sizes and hashes are shuffled. A source may hold any part of the rows: prefix sums run over
    cuts of its hash order, and rows are summed within one cut only.
    """
    spark = df.sparkSession
    slim = df.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        # rows without a key are spread by their texts, so that no cut holds them all
        F.md5(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("|"), F.coalesce(F.col(text), F.lit("")))).cast("binary")).alias("ord"),
    ).withColumn("s", F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("~")))
    slim = stage(slim, "mix")
    totals = slim.groupBy("s", "source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources; give them schedules by groups")
    totals.sort(key=lambda r: (r["source"] is None, str(r["source"])))
    schedules = [schedule_of(i) for i in range(len(totals))]
    targets = share([r["size"] for r in totals], [integrate(x) for x in schedules], share_of_words * sum(r["size"] for r in totals), most)
    table = [(r["s"], r["size"], t, round(t), segments(x, t)) for r, t, x in zip(totals, targets, schedules, strict=True)]
    plan = spark.createDataFrame(table, "s string, source_size long, target double, goal long, pieces array<struct<done: double, time: double, rate: double, slope: double>>")

    bits = bits_for(sum(r["n"] for r in totals), ROWS_PER_BUCKET)
    slim = slim.withColumn("cut", F.shiftright(F.conv(F.substring("ord", 1, 6), 16, 10).cast("int"), 24 - bits))
    cuts = slim.groupBy("s", "cut").agg(F.sum("size").alias("words"))
    before = cuts.select("s", "cut", (F.sum("words").over(Window.partitionBy("s").orderBy("cut")) - F.col("words")).alias("before"))
    within = Window.partitionBy("s", "cut").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at, goal, size = F.col("at"), F.col("goal"), F.col("size")

    def copy(start: Column) -> Column:
        words = F.least(size, F.greatest(F.lit(0), goal - start))
        placed = (words > 0) | ((size == 0) & (start < goal))
        return F.when(placed, F.struct(when_reached(start.cast("double"), F.col("pieces")).alias("position"), words.cast("long").alias("words")))

    return (
        slim.withColumn("at", F.sum("size").over(within) - size)
        .join(before, ["s", "cut"])
        .withColumn("at", at + F.col("before"))
        .join(F.broadcast(plan), "s")
        .withColumn("copies", F.array_compact(F.array(*[copy(at + F.col("source_size") * i) for i in range(most)])))
        .select("doc_id", "source", "size", "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"]).alias("taken"), "copies", "ord")
    )


def mixed_order(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``df`` in training order, a row for each copy of which the mix takes at least half.

    Only columns of ``df`` come back. Rows that agree in key, source and size deal their copies among themselves.
    """
    copies = plan_mix(df, key=key, text=text, source=source, **how)
    whole = F.filter("copies", lambda c: 2 * c["words"] >= F.col("size"))
    copies = copies.select(F.col("doc_id").alias("id"), F.col("source").alias("s"), F.col("size").alias("n"), F.explode(whole).alias("c"))
    turns = copies.groupBy("id", "s", "n").agg(F.array_sort(F.collect_list("c.position")).alias("turns"))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = df.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.col(source).alias("s"), size.alias("n"))  # names of df can't clash inside
    same = Window.partitionBy("id", "s", "n")
    joined = rows.alias("d").join(turns.alias("t"), F.col("d.id").eqNullSafe(F.col("t.id")) & F.col("d.s").eqNullSafe(F.col("t.s")) & (F.col("d.n") == F.col("t.n")))
    # rows that can't be told apart deal their turns among themselves
    dealt = joined.select("d.*", "t.turns").withColumns({"of": F.count("*").over(same), "nth": F.row_number().over(same.orderBy("n"))})
    own = F.filter("turns", lambda x, i: i % F.col("of") == F.col("nth") - 1)
    return dealt.withColumn("at", F.explode(own)).orderBy("at", "id").select("row.*")
