"""Quality classifier: ordinal cumulative-link regression on hashed text (McCullagh's proportional odds).

A rating is one of K ordered grades. All grades share one weight vector over hashed features; K-1 ordered
thresholds cut the score: P(grade <= k) = sigmoid(threshold_k - score). From these come the expected
grade and the probability of reaching a wanted grade, by which documents are selected.

Features are present or absent: the distinct lower-cased words of the whole text and levels of a few
style ratios, all hashed into one space. The model is fitted on at most ``sample`` rated documents, those
with the least hash of their id; scoring covers every document and is one map.

Cases: a null text is an empty one, which has style features only; a text of any length counts whole; null or out-of-range grades are
not ratings; of several ratings of one id the lowest counts, and of several texts of one id the one of least features;
equal texts get equal grades, a row each; a null id is never rated, but graded; of ids that hash alike the lesser is sampled first;
without ratings, or with one grade only, no model can be fitted: every probability is null and everything is kept; an empty
table stays empty; input columns named like an output column are replaced by it, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import fresh_name, utf8

DIMENSIONS = 1 << 18
#: Rated documents to fit on at most.
SAMPLE = 12_000
#: A feature counts if so many of the sampled documents have it.
LEAST_DOCUMENTS = 3
#: ... and at least this share of them.
LEAST_SHARE = 0.001
_POINTS = b".,;:!?\"'()[]"
_UPPER, _DIGIT, _SIGN = bytes(range(65, 91)), bytes(range(48, 58)), b"|!#$%&*<>{}=@~^_\\"
#: Lower ends of a ratio's levels.
LEVELS = (0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.75)


def features(text: bytes) -> np.ndarray:
    """Distinct feature numbers of one text, sorted."""
    words = text.lower().split()
    distinct = set(words)
    seen = {w.strip(_POINTS) for w in distinct}
    whole, lines = max(1, len(text)), [x for x in text.split(b"\n") if x]
    ratios = {
        b"upper": (whole - len(text.translate(None, _UPPER))) / whole,
        b"digit": (whole - len(text.translate(None, _DIGIT))) / whole,
        b"sign": (whole - len(text.translate(None, _SIGN))) / whole,
        b"again": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        b"same": 1 - len(distinct) / len(words) if words else 0.0,
    }
    # control bytes never stand in words, so style names can't be mistaken for words
    seen.update(b"\t%s %d" % (name, i) for name, x in ratios.items() for i, least in enumerate(LEVELS) if x >= least)
    seen.update(b"\tlong %d" % i for i in range(12) if len(words) >= 1 << i)
    return np.unique(np.fromiter((crc32(x) for x in seen), np.int64, len(seen)) & (DIMENSIONS - 1)).astype(np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class GradeModel:
    weights: np.ndarray  # float32, by feature
    thresholds: np.ndarray  # ascending

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, a column each."""
        return 1 - sigmoid(self.thresholds[None, :] - score[:, None])


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = 250, lasso: float = 3e-4) -> GradeModel:
    """Accelerated proximal gradient on the mean likelihood with an L1 penalty on the weights.

    Each coordinate steps by a diagonal bound of its curvature; the penalty leaves words that say nothing
    at zero. Classes weigh the square root of their scarcity.
    """
    n = len(rows)
    found = np.bincount(np.concatenate(rows), minlength=DIMENSIONS)
    used = np.flatnonzero(found >= max(LEAST_DOCUMENTS, n * LEAST_SHARE))
    slot = np.full(DIMENSIONS, -1, np.int64)
    slot[used] = np.arange(len(used))
    rows = [x[x >= 0] for x in (slot[r] for r in rows)]
    sizes = np.array([len(x) for x in rows])
    at = np.concatenate([*rows, np.zeros(0, np.int64)])
    of = np.repeat(np.arange(n), sizes)
    share = np.bincount(grades, minlength=n_grades) / n
    weigh = 1 / np.sqrt(np.maximum(share, 1e-9))[grades]
    weigh /= weigh.mean()
    below = np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(np.log(below / (1 - below)) + 0.1 * np.arange(n_grades - 1))
    bend = np.bincount(at, weights=(weigh * (sizes + n_grades))[of], minlength=len(used)) / (4 * n) + 1e-9
    cut_step = 1 / (0.25 * (1 + sizes.mean()))
    w, look, cut_look, t = np.zeros(len(used)), np.zeros(len(used)), cuts.copy(), 1.0
    for _ in range(rounds):
        edges = np.concatenate([[-np.inf], cut_look, [np.inf]])
        score = np.bincount(of, weights=look[at], minlength=n)
        upto, under = sigmoid(edges[grades + 1] - score), sigmoid(edges[grades] - score)
        mass = np.maximum(upto - under, 1e-9)
        grad = np.bincount(at, weights=(weigh * (1 - upto - under) / n)[of], minlength=len(used))
        grad_cut = np.zeros(n_grades + 1)
        np.add.at(grad_cut, grades + 1, -weigh * upto * (1 - upto) / mass / n)
        np.add.at(grad_cut, grades, weigh * under * (1 - under) / mass / n)
        step = look - grad / bend
        new = np.sign(step) * np.maximum(np.abs(step) - lasso / bend, 0)
        new_cuts = cut_look - cut_step * grad_cut[1:-1]
        new_cuts = np.maximum.accumulate(new_cuts + 0.01 * -np.arange(n_grades - 1)) + 0.01 * np.arange(n_grades - 1)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        push = (last - 1) / t
        look, cut_look = new + push * (new - w), np.maximum.accumulate(new_cuts + push * (new_cuts - cuts))
        w, cuts = new, new_cuts
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = w
    return GradeModel(weights, cuts)


def fit_grades(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> GradeModel | None:
    """Model of ``ratings`` (key, grade 0 .. n_grades-1) over ``docs``, from ``sample`` of them at most."""
    rated = ratings.where(F.col("grade").between(0, n_grades - 1)).groupBy(F.col(key).alias("__id")).agg(F.min("grade").alias("__grade"))
    rated = rated.join(docs.select(F.col(key).alias("__id")).distinct(), "__id")
    rated = rated.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    chosen = docs.select(F.col(key).alias("__id"), utf8(F.col(text)).alias("__text")).join(F.broadcast(rated), "__id")

    @F.pandas_udf("binary")
    def featured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: features(bytes(x)).tobytes())

    got = chosen.select("__id", "__grade", featured("__text").alias("f")).toPandas()
    got = got.sort_values(["__id", "f"]).drop_duplicates("__id")
    if got["__grade"].nunique() < 2:
        return None
    rows = [np.frombuffer(x, np.int32).astype(np.int64) for x in got["f"]]
    return fit(rows, got["__grade"].to_numpy(np.int64), n_grades)


def grade_columns(text: Column, model: GradeModel | None, wanted: int) -> Column:
    """struct(expected_grade, tail_probability): the latter is P(grade >= wanted)."""
    if model is None:
        return F.lit(None).cast("struct<expected_grade: double, tail_probability: double>")

    @F.pandas_udf("expected_grade double, tail_probability double")
    def graded(texts: pd.Series) -> pd.DataFrame:
        score = np.array([model.weights[features(bytes(x))].sum(dtype=np.float64) for x in texts])
        p = model.at_least(score.reshape(-1))
        return pd.DataFrame({"expected_grade": p.sum(axis=1), "tail_probability": p[:, wanted - 1]})

    return graded(utf8(text))


def grade_documents(df: DataFrame, model: GradeModel | None, wanted: int, least: float = 0.5, text: str = "text") -> DataFrame:
    """``df`` with expected_grade, tail_probability and keep (tail_probability at least ``least``)."""
    g = fresh_name(df, "graded")
    out = df.withColumn(g, grade_columns(F.col(text), model, wanted))
    return out.withColumns({"expected_grade": F.col(g)["expected_grade"], "tail_probability": F.col(g)["tail_probability"], "keep": F.coalesce(F.col(g)["tail_probability"] >= least, F.lit(True))}).drop(g)


def label_grades(labels: DataFrame) -> DataFrame:
    """Ratings from labels: toxic is grade 0, of low quality 1, clean 2."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))
