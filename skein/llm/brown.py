"""Language-model scoring with Brown classes: a class bigram whose classes come from the exchange algorithm
(Brown et al. 1992; Martin, Liermann and Ney 1998), its long tail from parallel exchange (Uszkoreit and Brants 2008).

    P(word_i | word_i-1) = P(class_i | class_i-1) * P(word_i | class_i)

Every training document is counted, and words are known by 64-bit hashes of their bytes. First the ``units`` most frequent
words and ``endings`` groups of all other words (by their last two bytes) are exchanged between classes on the
driver, by their dense bigrams, while the likelihood grows. Then every other word that training documents hold
``LEAST`` times or more moves to the class that gains most by its own neighbours: ``ROUNDS`` passes, in which all such
words move at once against the same class table, while the likelihood grows; how many there are follows the corpus, and their neighbour counts stay a
distributed table. Rarer words and those never seen have the class of their ending. The ``held`` most frequent words
(14 bytes each) are sent to the executors with count and class; the others meet their count in a join, and have the class of their
ending: that bound on memory is the only one.

Transitions are smoothed towards class frequencies, emissions by adding 0.1 to each word of the class and to
one unknown word. Words are runs of bytes other than the six ASCII spaces, with A-Z lower-cased; each text ends with one
end token, which is a class of its own and also the context of the first word.

Cases: a null or empty text is one end token; a text of any length counts whole; unknown words have count 0; without training
documents all counts are 0; of words as frequent the one of the lesser hash comes first; equal rows get equal scores, a row each; a null
key counts as an empty one; an empty table stays empty; extra columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stage, utf8

UNITS, ENDINGS, CLASSES = 1000, 256, 64
#: Words whose counts and classes every executor holds, at most.
HELD = 1_000_000
#: Training count from which a word is clustered by its own neighbours.
LEAST = 3
#: Sweeps of the dense exchange, at most, and passes of the parallel one.
SWEEPS, ROUNDS = 20, 2
PULL = 10.0
ADD = 0.1
#: The end token's hash.
END = 0
#: Training tokens whose neighbour counts meet in one task, about.
PART_TOKENS = 500_000
#: Counted things that a task holds before it hands them on.
FLUSH = 500_000

_U = np.uint64
_BASE = 0xA24BAED4963EE407
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def held_out(key: Column) -> Column:
    """Every tenth document by the checksum of its key is not learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)])) for b in (_U(_BASE), _U(pow(_BASE, -1, 1 << 64)))]
    return _POWERS


@dataclass
class Tokens:
    """Words of some texts, each text with one end token before its first word and one after its last."""

    word: np.ndarray  # hash, END for end tokens
    tail: np.ndarray  # last two bytes as a number; 0 for end tokens
    first: np.ndarray  # place of each text's leading end token; the next text's one is its closing one


def tokens_of(texts: list[bytes]) -> Tokens:
    """All texts are cut and hashed in one sweep over their bytes."""
    joined = b" ".join([b"", *texts, b""]).lower()
    at = np.frombuffer(joined, np.uint8)
    space = _SPACE[at]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _powers(len(at) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((at.astype(_U) + _U(1)) * up[: len(at)])])
    word = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    tail = at[ends - 2].astype(np.int64) << 8 | at[ends - 1]  # a word of one byte has the space before it
    begins = np.searchsorted(starts, np.cumsum([1, *[len(t) + 1 for t in texts]]))
    first = begins + np.arange(len(begins))
    n = len(word) + len(begins)
    is_end = np.zeros(n, bool)
    is_end[first] = True
    words, tails = np.zeros(n, _U), np.zeros(n, np.int64)
    words[~is_end], tails[~is_end] = np.maximum(word, _U(1)), tail
    return Tokens(words, tails, first)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about a megabyte of text, or one document."""
    at, size, texts = 0, 0, []
    for i in range(batch.num_rows):
        texts.append(memoryview(batch.column(column)[i].as_buffer()).tobytes())
        size += len(texts[-1])
        if size > 1 << 20:
            yield batch.slice(at, i + 1 - at), texts
            at, size, texts = i + 1, 0, []
    if texts:
        yield batch.slice(at), texts


class _Sums:
    """Sums by key that a task gathers, as sorted arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, n: np.ndarray | None = None) -> None:
        if n is None:
            kinds, sums = np.unique(keys, return_counts=True)
        else:
            order = np.argsort(keys, kind="stable")
            kinds, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])) if len(kinds) else np.zeros(0, np.int64)
            kinds, sums = kinds[first], np.add.reduceat(n, first) if len(first) else n
        self.parts.append((kinds, sums))
        self.size += len(kinds)
        if self.size > 2 * FLUSH:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            parts, self.parts, self.size = self.parts, [], 0
            self.add(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All sums, in bounded parts; nothing is left."""
        self.merge()
        for keys, n in self.parts:
            for i in range(0, len(keys), 100_000):
                yield keys[i : i + 100_000], n[i : i + 100_000]
        self.parts, self.size = [], 0


def _counted(texts: DataFrame, count: Callable[[Tokens], np.ndarray]) -> DataFrame:
    """(key, n): how often ``count`` gave each key, over all of ``texts``; summed within each task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()

        def out() -> Iterator[pa.RecordBatch]:
            for keys, n in sums.take():
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

        for whole in batches:
            for _, some in _texts(whole, 0):
                sums.add(count(tokens_of(some)))
                if sums.size > FLUSH:
                    sums.merge()
                    if sums.size > FLUSH:
                        yield from out()
        yield from out()

    return texts.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, tail, n) over all of ``texts``: each word's hash, last two bytes and count."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, tails = _Sums(), {}

        def out() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([t[0] for t in tails["at"]]) if tails else np.zeros(0, _U)
            ends = np.concatenate([t[1] for t in tails["at"]]) if tails else np.zeros(0, np.int64)
            order = np.argsort(keys, kind="stable")
            keys, ends = keys[order], ends[order]
            for word, n in sums.take():
                yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(ends[np.searchsorted(keys, word)]), pa.array(n)], ["word", "tail", "n"])
            tails.clear()

        for whole in batches:
            for _, some in _texts(whole, 0):
                t = tokens_of(some)
                word, tail = t.word[1:], t.tail[1:]  # the first end token is the context of the first text only
                kinds, where, times = np.unique(word, return_index=True, return_counts=True)
                sums.parts.append((kinds, times))
                sums.size += len(kinds)
                tails.setdefault("at", []).append((kinds, tail[where]))
                if sums.size > FLUSH:
                    yield from out()
        yield from out()

    return texts.mapInArrow(counted, "word long, tail long, n long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, tail, count) of the most frequent words, ``most`` at most, the frequent first: a cut through a histogram of counts, no sort."""
    level = F.floor(F.log("n") / np.log(1.05)).cast("int")
    room, least = most, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["level"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.where(level >= least).select("word", "tail", "n").toArrow()
    word, tail, n = (got[c].to_numpy() for c in ("word", "tail", "n"))
    word = word.view(_U)
    order = np.lexsort((word, -n))
    return word[order], tail[order], n[order]


def ending(tail: np.ndarray, endings: int) -> np.ndarray:
    return (_mix(tail.astype(_U) + _U(1)) % _U(endings)).astype(np.int64)


class Lexicon:
    """What executors know of words: the held ones by sorted hash, with count and class; a class for each ending."""

    def __init__(self, word: np.ndarray, n: np.ndarray, group: np.ndarray, of_group: np.ndarray) -> None:
        order = np.argsort(word)
        few = len(n) == 0 or int(n.max()) < 1 << 32
        self.word, self.n, self.of_group = word[order], n[order].astype(np.uint32 if few else np.int64), of_group
        self.group = group[order].astype(np.int16)

    def places(self, word: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if it isn't held."""
        if not len(self.word):
            return np.full(len(word), -1)
        kinds, of = np.unique(word, return_inverse=True)
        at = np.minimum(np.searchsorted(self.word, kinds), len(self.word) - 1)
        return np.where(self.word[at] == kinds, at, -1)[of]

    def groups(self, t: Tokens, places: np.ndarray) -> np.ndarray:
        """Unit or class of each token: its own if it is held, that of its ending, or the last for the end token."""
        end = len(self.of_group) - 1
        found = self.of_group[ending(t.tail, end)]
        if len(self.word):
            found = np.where(places >= 0, self.group[places], found)
        return np.where(t.word == _U(END), self.of_group[end], found)


def unit_bigrams(texts: DataFrame, units: Lexicon, n: int) -> np.ndarray:
    """Dense matrix of how often unit j follows unit i; the result has n**2 numbers at most, whatever the input."""

    def pairs(t: Tokens) -> np.ndarray:
        at = units.groups(t, units.places(t.word))
        return at[:-1] * n + at[1:]

    got = _counted(texts, pairs).toArrow()
    matrix = np.zeros(n * n)
    matrix[got["key"].to_numpy()] = got["n"].to_numpy()
    return matrix.reshape(n, n)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of a class table, but for what doesn't depend on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit. The last unit, the end, is alone in the last class; every other unit moves to the class
    that gains most likelihood, in the order of frequency, until a sweep moves none."""
    n = len(bigrams)
    free = max(1, classes - 1)
    uses = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.lexsort((np.arange(n - 1), -uses[:-1]))
    member = np.zeros(n, np.int64)
    member[order] = np.arange(n - 1) % free
    member[-1] = free
    k = free + 1
    one = np.zeros((n, k))
    one[np.arange(n), member] = 1
    after, before = bigrams @ one, bigrams.T @ one  # of each unit: counts of classes that follow and precede
    table = one.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not uses[w]:
                continue
            old, own = member[w], bigrams[w, w]
            right, left = after[w].copy(), before[w].copy()
            table[old] -= right
            table[:, old] -= left
            table[old, old] += own
            right[old] -= own
            left[old] -= own
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            gain = (_xlogx(table + right) - _xlogx(table)).sum(axis=1) + (_xlogx(table.T + left) - _xlogx(table.T)).sum(axis=1)
            corner = np.diag(table)
            gain -= _xlogx(corner + right) + _xlogx(corner + left) - _xlogx(corner)
            gain += _xlogx(corner + right + left + own)
            r, c = right.sum() + own, left.sum() + own
            rows, cols = rows + left, cols + right  # what they hold wherever the unit goes
            gain -= _xlogx(rows + r) - _xlogx(rows) + _xlogx(cols + c) - _xlogx(cols)
            new = int(np.argmax(gain[:free]))
            if gain[new] <= gain[old] + 1e-9 * abs(gain[old]):
                new = int(old)
            right[new] += own
            left[new] += own
            table[new] += right
            table[:, new] += left
            table[new, new] -= own
            if new != old:
                moved += 1
                member[w] = new
                after[:, old] -= bigrams[:, w]
                after[:, new] += bigrams[:, w]
                before[:, old] -= bigrams[w]
                before[:, new] += bigrams[w]
        if not moved:
            break
    return member


def _gains(side: np.ndarray, other: np.ndarray, n: np.ndarray, starts: np.ndarray, old: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Likelihood that each word brings to each class by its neighbours (side 0 follows the word, 1 precedes it): a row a word.

    A word's own counts are taken out of its old class first; that neighbours of one class may be the word itself is left out of account.
    """
    rows = np.where(side[:, None] == 0, table.T[other], table[other])  # counts of each class with that neighbour
    word = np.repeat(np.arange(len(starts)), np.diff([*starts, len(n)]))
    line = np.arange(len(n))
    rows[line, old[word]] = np.maximum(rows[line, old[word]] - n, 0)
    gain = np.add.reduceat(_xlogx(rows + n[:, None]) - _xlogx(rows), starts, axis=0)
    for s, total in ((0, table.sum(axis=1)), (1, table.sum(axis=0))):
        uses = np.add.reduceat(np.where(side == s, n, 0), starts)
        base = np.repeat(total[None, :], len(starts), axis=0)
        base[np.arange(len(starts)), old] = np.maximum(base[np.arange(len(starts)), old] - uses, 0)
        gain -= _xlogx(base + uses[:, None]) - _xlogx(base)
    return gain


def _moved(texts: DataFrame, lexicon: Lexicon, core: np.ndarray, classes: int, table: np.ndarray) -> np.ndarray:
    """Classes of the held words after one pass of parallel exchange; words of ``core`` stay where they are.

    Each task sums the neighbours of its words and sends them as sorted runs, one for so many held words as have about ``PART_TOKENS`` tokens,
    whose sums then meet in one task: a word has as many sums as there are classes on its two sides, however frequent it is.
    """
    fixed = core | (lexicon.n < LEAST)
    size = max(1, len(lexicon.word) * PART_TOKENS // max(1, int(lexicon.n[~fixed].sum())))
    span = 2 * classes * size

    def beside(t: Tokens) -> np.ndarray:
        place = lexicon.places(t.word)
        group = lexicon.groups(t, place)
        moves = (place >= 0) & ~fixed[place] & (t.word != _U(END))
        at = np.flatnonzero(moves)  # never the first or the last token: those are end tokens
        key = place[at] * 2 * classes
        return np.concatenate([key + group[at + 1], key + classes + group[at - 1]])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()

        def out() -> Iterator[pa.RecordBatch]:
            sums.merge()
            for keys, n in sums.parts:
                part = keys // span
                for at in np.split(np.arange(len(keys)), np.flatnonzero(part[1:] != part[:-1]) + 1):
                    if len(at):
                        yield pa.record_batch([pa.array(part[at[:1]], pa.int32()), pa.array([(keys[at] % span).astype(np.uint32).tobytes()]), pa.array([n[at].astype(np.uint32).tobytes()])], ["part", "keys", "n"])
            sums.parts, sums.size = [], 0

        for whole in batches:
            for _, some in _texts(whole, 0):
                sums.add(beside(tokens_of(some)))
                if sums.size > FLUSH:
                    sums.merge()
                    if sums.size > FLUSH:
                        yield from out()
        yield from out()

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = -1, _Sums()

        def best() -> Iterator[pa.RecordBatch]:
            sums.merge()
            for key, n in sums.parts:
                for lo in range(0, span, 2 * classes * 1000):  # a thousand words at a time
                    a, b = np.searchsorted(key, [lo, lo + 2 * classes * 1000])
                    if a == b:
                        continue
                    word, at = key[a:b] // (2 * classes) + part * size, key[a:b] % (2 * classes)
                    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                    old = lexicon.group[word[starts]]
                    gain = _gains(at // classes, at % classes, n[a:b].astype(np.float64), starts, old, table)[:, : classes - 1]
                    new = gain.argmax(axis=1)
                    line = np.arange(len(new))
                    stay = gain[line, new] <= gain[line, old] + 1e-9 * np.abs(gain[line, old])
                    yield pa.record_batch([pa.array(word[starts], pa.int32()), pa.array(np.where(stay, old, new), pa.int16())], ["place", "class"])
            sums.parts, sums.size = [], 0

        for batch in batches:
            for p, keys, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if p != part:
                    yield from best()
                    part = p
                keys, n = (np.frombuffer(memoryview(x.as_buffer()), np.uint32).astype(np.int64) for x in (keys, n))
                sums.add(keys, n)
        yield from best()

    cut = texts.mapInArrow(runs, "part int, keys binary, n binary")
    got = cut.repartition("part").sortWithinPartitions("part").mapInArrow(settled, "place int, class short").toArrow()
    group = lexicon.group.copy()
    group[got["place"].to_numpy()] = got["class"].to_numpy()
    return group


@dataclass
class ClassModel:
    lexicon: Lexicon
    table: np.ndarray  # how often a class follows another
    step: np.ndarray  # log10 P(class | class before) less log10 of the class's emission total
    tokens: int
    vocabulary: int
    end: int  # training count of the end token
    counts: DataFrame  # of words that are not held

    def class_of(self, word: bytes) -> int:
        t = tokens_of([word])
        return int(self.lexicon.groups(t, self.lexicon.places(t.word))[1])


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", units: int = UNITS, endings: int = ENDINGS, classes: int = CLASSES, held: int = HELD) -> ClassModel:
    """Counts, classes and probabilities from every document that isn't held out."""
    texts = df.where(~held_out(F.col(key))).select(utf8(F.col(text)).alias("text"))
    counts = stage(word_counts(texts), "words")
    end = counts.where(F.col("word") == END).first()
    counts = counts.where(F.col("word") != END)
    word, tail, n = frequent_words(counts, held)
    top = min(units, len(word))
    groups = np.arange(top, top + endings + 1)
    first = Lexicon(word[:top], n[:top], np.arange(top), groups)
    bigrams = unit_bigrams(texts, first, top + endings + 1)
    member = exchange(bigrams, classes)
    k = int(member.max()) + 1  # the end token's class is the last one
    of_group = member[groups]
    group = np.concatenate([member[:top], of_group[ending(tail[top:], endings)]])
    lexicon = Lexicon(word, n, group, of_group)
    core = np.isin(lexicon.word, word[:top])
    one = np.zeros((len(member), k))
    one[np.arange(len(member)), member] = 1
    table = one.T @ bigrams @ one
    if (~core & (lexicon.n >= LEAST)).any():
        for _ in range(ROUNDS):
            before, lexicon.group = lexicon.group, _moved(texts, lexicon, core, k, table)
            after = unit_bigrams(texts, lexicon, k)
            if likelihood(after) <= likelihood(table):  # all at once, words can move too far
                lexicon.group = before
                break
            table = after
    total = np.bincount(lexicon.group, weights=lexicon.n, minlength=k)
    kinds = np.bincount(lexicon.group, minlength=k).astype(np.float64)
    rare = counts.where(F.col("n") < int(n[-1])) if len(n) else counts
    # words as frequent as the last held one may be held or not: the cut is between levels of counts, so all are held
    rest = rare.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()  # 65,536 rows at most
    if rest.num_rows:
        of = of_group[ending(rest["tail"].to_numpy(), endings)]
        total += np.bincount(of, weights=rest["n"].to_numpy(), minlength=k)
        kinds += np.bincount(of, weights=rest["v"].to_numpy(), minlength=k)
    ends = end["n"] if end else 0
    total[k - 1] += ends
    kinds[k - 1] += ends > 0
    prior = (total + 1) / (total.sum() + k)
    to = (table + PULL * prior) / (table.sum(axis=1, keepdims=True) + PULL)
    step = np.log10(to) - np.log10(total + ADD * (kinds + 1))
    return ClassModel(lexicon, table, step, int(total.sum()), int(kinds.sum()), ends, rare)


def score(df: DataFrame, model: ClassModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    Both scores need the sum of log10(count + 0.1) over all tokens. Held words add theirs at once; a document's
    other words become rows that join the counts. No such word is frequent, so no join key is hot.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    sent = spark.sparkContext.broadcast((model.lexicon, model.step, model.end))
    names = ["doc_id", "k", "word", "times", "n_tokens", "n_known", "logs", "steps"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, step, end = sent.value
        for whole in batches:
            for batch, some in _texts(whole, 2):
                t = tokens_of(some)
                place = lexicon.places(t.word)
                path = lexicon.groups(t, place)
                is_end = t.word == _U(END)
                n = np.where(is_end, end, lexicon.n[place] if len(lexicon.n) else 0) * ((place >= 0) | is_end)
                before, last = t.first[:-1], t.first[1:]  # tokens of a text: after its leading end token, its closing one included
                logs = np.where((place >= 0) | is_end, np.log10(n + ADD), 0.0)
                steps = step[path[:-1], path[1:]]

                def per_text(x: np.ndarray) -> np.ndarray:
                    return np.add.reduceat(x, before)

                # x[i] belongs to token i + 1, so that sums run from a text's first word to its closing end token
                known, log_sum, step_sum = per_text((n > 0)[1:].astype(np.int64)), per_text(logs[1:]), per_text(steps)
                other = np.flatnonzero((place < 0) & ~is_end)
                doc = np.searchsorted(last, other)
                order = np.lexsort((t.word[other], doc))
                doc, word = doc[order], t.word[other][order]
                cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])) if len(doc) else np.zeros(0, np.int64)
                times = np.diff([*cut, len(doc)])
                m, r = len(some), len(cut)
                take = pa.array(np.concatenate([np.arange(m), doc[cut]]))
                zeros = np.zeros(r)
                words = pa.array(np.concatenate([np.zeros(m, np.int64), word[cut].view(np.int64)]), mask=np.concatenate([np.ones(m, bool), np.zeros(r, bool)]))
                counted = [pa.array(np.concatenate([x, zeros.astype(np.int64)])) for x in (last - before, known)]
                summed = [pa.array(np.concatenate([x, zeros])) for x in (log_sum, step_sum)]
                yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), words, pa.array(np.concatenate([np.zeros(m, np.int64), times])), *counted, *summed], names)

    rows = df.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("k"), utf8(F.col(text)).alias("text"))
    rows = rows.mapInArrow(scored, f"doc_id {kind}, k long, word long, times long, n_tokens long, n_known long, logs double, steps double")
    met = rows.join(model.counts.select("word", F.col("n").alias("c")), "word", "left")
    c, times = F.coalesce("c", F.lit(0)), F.col("times")
    total = met.groupBy("doc_id", "k").agg(
        F.count_if(times == 0).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, times).otherwise(0)).alias("n_known"),
        F.sum(F.col("logs") + times * F.log10(c + ADD)).alias("logs"),
        F.sum("steps").alias("steps"),
    )
    alike = total.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), *[(F.col(x) / F.col("copies")).alias(x) for x in ("n_tokens", "n_known", "logs", "steps")])
    tokens = F.col("n_tokens").cast("long")
    whole = float(np.log10(model.tokens + ADD * (model.vocabulary + 1)))
    out = alike.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), tokens.alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("logs") - tokens * whole).alias("base_score"), (F.col("logs") + F.col("steps")).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
