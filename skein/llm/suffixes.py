"""Suffix-array dedup: repeated byte strings by a distributed, common-prefix-aware merge sort of sparse suffixes.

Every window of ``LENGTH`` bytes is named by its anchor, the position in it whose ``SEED`` bytes hash least, so equal
windows have their anchor at the same place. Only suffixes at anchors are sorted, about one in 170 bytes, and only
those whose seed occurs again; each carries the bytes of its windows and no more. Tasks sort runs of them,
front-code each run (a suffix is stored as its common prefix with the one before, and the rest) and send ranges of
it to the parts of a fixed split of the hashed seeds. A part merges its runs with a loser tree that remembers common
prefixes and never compares their bytes again. The merged common prefixes tell how far each suffix may agree with
any other; windows within that reach are compared by content, and those that occur twice are covered.

Seeds that occur more than ``HOT`` times are not gathered: each unit of texts lists its windows by content hash, equal ones
in one row, rows are counted by hash, and those that occur twice go back to their unit to be joined to spans. Copies of a whole text are one text that covers itself.

Beside the removal stands ``passage``: whether a text has a run of over 50 words in common with a different text, however few
bytes that is. Of every ``PASSAGE`` words in a row the ``GRAM`` adjoining ones that hash least are looked up, so
no such run is missed; runs from GRAM words on may be told too.

Cases: a null or empty text has nothing to remove; texts shorter than LENGTH neither; matches never cross
documents; a string that repeats inside one document counts, overlapping itself or not; equal rows are
copies of each other; a null id is an id; a text of any length counts whole (beyond a megabyte in sweeps that overlap); of seeds that
hash alike the leftmost is the anchor; an empty table stays empty; extra columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stage, utf8

LENGTH = 400
SEED = 64
HOT = 4000
ITEMS_PER_PART = 4_000
RUN_BYTES = 16 << 20
#: Words of a passage that is told, and of the runs of words that are looked up.
PASSAGE, GRAM = 51, 40
#: Windows of hot seeds in a unit.
UNIT_WINDOWS = 1 << 20

_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_PLACE = 24  # bits of an anchor's place in the keys of a sweep
_SWEEP = 1 << 20


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(32))) * _U(0xD6E8FEB86659FD93)
    z = (z ^ (z >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return z ^ (z >> _U(32))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 2 * _SWEEP)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)])) for b in (_U(_BASE), _U(pow(_BASE, -1, 1 << 64)))]
    return _POWERS


def _sums(at: np.ndarray) -> np.ndarray:
    up = _powers(len(at) + 1)[0]
    return np.concatenate([np.zeros(1, _U), np.cumsum((at.astype(_U) + _U(1)) * up[: len(at)])])


def _hashes(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes at each start."""
    return _mix((sums[starts + length] - sums[starts]) * _powers(len(sums))[1][starts])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, place, first window, last window) of each anchor of one text, in order."""
    parts = []
    for begin in range(0, max(0, len(text) - LENGTH + 1), _SWEEP):
        at = np.frombuffer(text, np.uint8, min(len(text) - begin, _SWEEP + LENGTH - 1), begin)
        seeds = _hashes(_sums(at), np.arange(len(at) - SEED + 1), SEED)
        key = (seeds >> _U(_PLACE) << _U(_PLACE)) | np.arange(len(seeds), dtype=_U)  # the leftmost of equal seeds
        width, least = 1, key
        span = LENGTH - SEED + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & _U((1 << _PLACE) - 1)).astype(np.int64)
        turn = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([turn[1:] - 1, [len(place) - 1]])
        # the least of many hashes is small; hashed again, anchors spread evenly over the parts
        parts.append((_mix(seeds[place[turn]] + _U(_BASE)), place[turn] + begin, turn + begin, last + begin))
    if not parts:
        return (np.zeros(0, _U), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def grams(text: bytes) -> np.ndarray:
    """Hashes of the runs of GRAM words that are looked up for one text: the least of each PASSAGE words, once each."""
    at = np.frombuffer(b" " + text + b" ", np.uint8)
    space = _SPACE[at]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    if len(starts) < PASSAGE:
        return np.zeros(0, _U)
    sums = _sums(at)
    up, down = _powers(len(at) + 1)
    word = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    run = np.concatenate([np.zeros(1, _U), np.cumsum(word * up[: len(word)])])
    n = len(word) - GRAM + 1
    gram = _mix(_mix((run[GRAM:] - run[:n]) * down[:n]))
    return np.unique(np.lib.stride_tricks.sliding_window_view(gram, PASSAGE - GRAM + 1).min(axis=1))


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparing."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    return known + int((np.frombuffer(a, np.uint8, n - known, known) != np.frombuffer(b, np.uint8, n - known, known)).argmax())


class Run:
    """A decoded run: keys in order, each with its common prefix with the one before; owners and windows beside them."""

    def __init__(self, blob: bytes) -> None:
        owners, of, lo, hi, left_len, prefix, rest_len, packed, size = pickle.loads(blob)
        raw = pa.decompress(packed, size, "zstd", asbytes=True)
        self.owner = [owners[16 * i : 16 * i + 16] for i in of]
        self.lo, self.hi, self.prefix = lo, hi, prefix.tolist()
        self.key: list[bytes] = []
        self.left: list[bytes] = []
        at, last = 0, b""
        for p, r, n in zip(self.prefix, rest_len.tolist(), left_len.tolist(), strict=True):
            last = last[:p] + raw[at : at + r]
            self.key.append(last)
            self.left.append(raw[at + r : at + r + n])
            at += r + n


def front_code(items: list[tuple[bytes, bytes, bytes, int, int]]) -> bytes:
    """A run of sorted items (key, left, owner, lo, hi)."""
    owners = {o: i for i, o in enumerate(dict.fromkeys(x[2] for x in items))}
    prefix, rest, last = [], [], b""
    for key, left, *_ in items:
        p = common(last, key)
        prefix.append(p)
        rest += (key[p:], left)
        last = key
    raw = b"".join(rest)
    ints = [np.array(x, np.int64) for x in ([x[3] for x in items], [x[4] for x in items])]
    return pickle.dumps((b"".join(owners), np.array([owners[x[2]] for x in items], np.int32), *ints, np.array([len(x[1]) for x in items], np.int16), np.array(prefix, np.int16), np.array([len(x) for x in rest[::2]], np.int16), pa.compress(raw, "zstd", asbytes=True), len(raw)))


def merge(runs: list[Run]) -> list[tuple[int, int, int]]:
    """(run, index, common prefix with the item before) in sorted order, by a loser tree.

    A node keeps the loser with the length of its common prefix with the last item that went out. Of two
    items, the one that shares more with that item comes first, without a look at their bytes; only ties are
    compared, from the shared length on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    keys = [r.key for r in runs] + [[]] * (width - len(runs))
    at = [0] * width
    top: list[tuple[int, int]] = [(0, 0)] * (2 * width)
    lose: list[tuple[int, int]] = [(0, 0)] * width

    def play(a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """(winner, loser); entries are (run, prefix), an exhausted run has prefix -1."""
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        if a[1] < 0:
            return a, b
        x, y = keys[a[0]][at[a[0]]], keys[b[0]][at[b[0]]]
        n = common(x, y, a[1])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            return a, (b[0], n)
        return b, (a[0], n)

    for i in range(width):
        top[width + i] = (i, 0 if keys[i] else -1)
    for i in range(width - 1, 0, -1):
        top[i], lose[i] = play(top[2 * i], top[2 * i + 1])
    best, out = top[1], []
    while best[1] >= 0:
        run = best[0]
        out.append((run, at[run], best[1]))
        at[run] += 1
        best = (run, runs[run].prefix[at[run]] if at[run] < len(keys[run]) else -1)
        node = (width + run) // 2
        while node:
            best, lose[node] = play(best, lose[node])
            node //= 2
    return out


def covered_by(runs: list[Run]) -> Iterator[tuple[bytes, int, int]]:
    """(owner, start, end) covered by windows that occur more than once in the part."""
    order = merge(runs)
    reach = np.array([x[2] for x in order] + [0], np.int64) - 8  # the key starts with 8 bytes of the seed's hash
    reach = np.maximum(reach[:-1], reach[1:])
    reach[0] = max(reach[0], 0)
    texts, firsts, counts, items = [], [], [], []
    base = 0
    for (run, i, _), agree in zip(order, reach.tolist(), strict=True):
        r = runs[run]
        lo, hi, left = int(r.lo[i]), int(r.hi[i]), r.left[i]
        # window s has its anchor after lo + len(left) - s bytes; the rest of it must be within reach
        last = min(hi, lo + len(left) - LENGTH + agree)
        if last >= lo:
            texts.append(left + r.key[i][8:])
            firsts.append(base)
            counts.append(last - lo + 1)
            items.append((run, i))
            base += len(texts[-1])
    if not items:
        return
    at = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array(counts)
    of = np.repeat(np.arange(len(items)), sizes)
    step = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    window = _hashes(_sums(at), np.array(firsts)[of] + step, LENGTH)
    _, same, times = np.unique(window, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[same] > 1)
    if not len(again):
        return
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(again) != 1) | (np.diff(of[again]) != 0)]))
    ends = np.concatenate([cut[1:] - 1, [len(again) - 1]])
    for a, b in zip(again[cut].tolist(), again[ends].tolist(), strict=True):
        run, i = items[of[a]]
        lo = int(runs[run].lo[i])
        yield runs[run].owner[i], lo + int(step[a]), lo + int(step[b]) + LENGTH


def text_mark(text: Column) -> Column:
    """16 bytes that name a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(key).alias("doc_id"), utf8(F.col(text)).alias("text"))
    return rows.withColumn("mark", text_mark(F.col("text")))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, n_bytes, seeds, places, los, his, grams) per row."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [memoryview(x.as_buffer()).tobytes() for x in batch.column(1)]
                found = [anchors(x) for x in texts]
                columns = [pa.array([x.view(np.int64) for x, *_ in found], pa.list_(pa.int64()))]
                columns += [pa.array([x[i].astype(np.int32) for x in found], pa.list_(pa.int32())) for i in (1, 2, 3)]
                sizes = pa.array([len(x) for x in texts], pa.int64())
                told = pa.array([grams(x).view(np.int64) for x in texts], pa.list_(pa.int64()))
                yield pa.record_batch([batch.column(0), batch.column(2), sizes, *columns, told], ["doc_id", "mark", "n_bytes", "seeds", "places", "los", "his", "grams"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, mark binary, n_bytes long, seeds array<long>, places array<int>, los array<int>, his array<int>, grams array<long>"
    return _texts(df, key, text).mapInArrow(scanned, schema)


def _unit(owners: list[bytes], of: list[np.ndarray], starts: list[np.ndarray], windows: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each distinct window of a unit, with the owners and starts of all its occurrences."""
    name = uuid.uuid4().hex
    window, who, start = np.concatenate(windows), np.concatenate(of), np.concatenate(starts)
    order = np.argsort(window, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], window[order][1:] != window[order][:-1]]))
    marks = np.frombuffer(b"".join(owners), np.uint8).reshape(-1, 16)
    groups = np.split(order, cut[1:])
    n = len(groups)
    return pa.record_batch([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array([name] * n), pa.array(window[order][cut].view(np.int64)), pa.array([len(x) for x in groups], pa.int64()), pa.array([marks[who[x]].tobytes() for x in groups], pa.binary()), pa.array([start[x].astype(np.int32).tobytes() for x in groups], pa.binary())], schema=_CUT)


_CUT = pa.schema([("part", pa.int32()), ("run", pa.binary()), ("unit", pa.string()), ("window", pa.int64()), ("times", pa.int64()), ("owners", pa.binary()), ("starts", pa.binary())])


def _sorted_runs(texts: DataFrame, parts: int) -> DataFrame:
    """(part, run) and, for hot seeds, (unit, window, times, owners, starts): from (mark, text, hits)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[bytes, bytes, bytes, int, int]] = []
        size, done = 0, set()
        owners: list[bytes] = []
        hot: list[list[np.ndarray]] = [[], [], []]
        n_hot = 0

        def runs() -> Iterator[pa.RecordBatch]:
            items.sort(key=lambda x: x[:2])
            i = 0
            while i < len(items):
                part, j = int.from_bytes(items[i][0][:4], "big") * parts >> 32, i
                while j < len(items) and int.from_bytes(items[j][0][:4], "big") * parts >> 32 == part:
                    j += 1
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([front_code(items[i:j])], pa.binary()), *[pa.nulls(1, f.type) for f in list(_CUT)[2:]]], schema=_CUT)
                i = j
            items.clear()

        for batch in batches:
            for mark, text, hits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if mark in done:  # rows that are equal altogether
                    continue
                done.add(mark)
                text = memoryview(text.as_buffer()).tobytes()
                sums = None
                for h in hits.as_py():
                    seed, place, lo, hi = h["seed"], h["place"], h["lo"], h["hi"]
                    if h["hot"]:
                        if sums is None:
                            sums = _sums(np.frombuffer(text, np.uint8))
                            owners.append(mark)
                        starts = np.arange(lo, hi + 1)
                        for kept, new in zip(hot, (np.full(len(starts), len(owners) - 1), starts, _hashes(sums, starts, LENGTH)), strict=True):
                            kept.append(new)
                        n_hot += len(starts)
                    else:
                        items.append(((seed & (1 << 64) - 1).to_bytes(8, "big") + text[place : hi + LENGTH], text[lo:place], mark, lo, hi))
                        size += hi + LENGTH - lo
                if size > RUN_BYTES:
                    yield from runs()
                    size = 0
                if n_hot > UNIT_WINDOWS:
                    yield _unit(owners, *hot)
                    owners, hot, n_hot = [], [[], [], []], 0
        yield from runs()
        if n_hot:
            yield _unit(owners, *hot)

    return texts.mapInArrow(cut, "part int, run binary, unit string, window long, times long, owners binary, starts binary")


def _unit_spans(group: pd.DataFrame) -> pd.DataFrame:
    """Spans of a unit's repeated windows: adjoining starts of one owner make one."""
    owner = np.frombuffer(b"".join(group["owners"]), np.uint8).reshape(-1, 16)
    start = np.frombuffer(b"".join(group["starts"]), np.int32)
    who, of = np.unique(owner, axis=0, return_inverse=True)
    of = of.reshape(-1)
    order = np.lexsort((start, of))
    of, start = of[order], start[order]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(start) != 1)]))
    last = np.concatenate([cut[1:] - 1, [len(start) - 1]])
    return pd.DataFrame({"mark": [who[i].tobytes() for i in of[cut]], "start": start[cut], "end": start[last] + LENGTH})


def covered(df: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(mark, spans): covered pieces of each distinct text, from ``rows`` of scan()."""
    owners = rows.groupBy("mark").agg(F.min("doc_id").alias("rep"))
    owners = stage(owners, "owners")
    # one row a text: rows with the least id of their text; equal rows among them are dropped as such
    one = rows.join(owners, (rows["mark"] == owners["mark"]) & rows["doc_id"].eqNullSafe(owners["rep"]), "left_semi").where(F.size("seeds") > 0)
    found = one.select("mark", "doc_id", F.explode(F.arrays_zip("seeds", "places", "los", "his")).alias("x"))
    found = found.select("mark", "doc_id", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"), F.col("x.los").alias("lo"), F.col("x.his").alias("hi"))
    again = stage(found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "seeds")
    total = again.agg(F.sum("n")).first()[0] or 0
    hits = found.join(again, "seed").groupBy("mark", "doc_id").agg(F.collect_set(F.struct("seed", "place", "lo", "hi", (F.col("n") > HOT).alias("hot"))).alias("hits"))
    hits = stage(hits, "hits")
    at = _texts(df, key, text).alias("t")
    met = at.join(hits.alias("h"), (F.col("t.mark") == F.col("h.mark")) & F.col("t.doc_id").eqNullSafe(F.col("h.doc_id"))).select("h.mark", "t.text", "h.hits")
    parts = max(1, -(-total // ITEMS_PER_PART))
    cut = stage(_sorted_runs(met, parts), "runs", "lz4")

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(covered_by([Run(x) for x in group["run"]]), columns=["mark", "start", "end"])

    spans = cut.where("part is not null").select("part", "run").groupBy("part").applyInPandas(merged, "mark binary, start int, end int")
    hot = cut.where("part is null")
    twice = stage(hot.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1").select("window"), "windows")
    back = hot.select("unit", "window", "owners", "starts").join(twice, "window").select("unit", "owners", "starts")
    spans = spans.unionByName(back.groupBy("unit").applyInPandas(_unit_spans, "mark binary, start int, end int"))
    return stage(spans.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "spans")


def with_passages(rows: DataFrame) -> DataFrame:
    """(mark) of the texts that share a looked-up run of words with a different text, from ``rows`` of scan(); numbers stand for marks meanwhile."""
    named = rows.where(F.size("grams") > 0).select("mark", "grams").withColumn("m", F.xxhash64("mark"))
    found = named.select("m", F.explode("grams").alias("gram"))
    twice = found.groupBy("gram").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo <> hi").select("gram")
    told = found.join(twice, "gram", "left_semi").select("m").distinct()
    return named.join(told, "m", "left_semi").select("mark").distinct()


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (the digest of what is left) and passage."""
    rows = stage(scan(df, key, text), "anchors")
    copies = rows.groupBy("mark").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("size"))
    copies = stage(copies.where(f"copies > 1 and size >= {LENGTH}").select("mark"), "copies")
    spans = covered(df, rows, key, text)
    # one table, one join: texts with very many copies are then split by adaptive execution
    told = with_passages(rows).withColumn("passage", F.lit(True))
    effect = stage(spans.join(copies.withColumn("gone", F.lit(True)), "mark", "full").join(told, "mark", "full"), "effect")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, gone in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                content = memoryview(text.as_buffer()).tobytes()
                left, end, n = [], 0, 0
                for x in [{"start": 0, "end": len(content)}] if gone else spans or []:
                    if x["start"] > end or n == 0:
                        left.append(content[end : x["start"]])
                        n += 1
                    end = max(end, x["end"])
                rest = b"".join([*left, content[end:]])
                out.append((len(content), len(content) - len(rest), n, hashlib.sha256(rest).hexdigest()))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            passage = batch.column(4).fill_null(False)
            yield pa.record_batch([batch.column(0), *[pa.array([x[i] for x in out], pa.string() if i == 3 else pa.int64()) for i in range(4)], passage], ["doc_id", *names, "passage"])

    kind = df.schema[key].dataType.simpleString()
    whole = _texts(df, key, text).join(effect, "mark", "left")
    return whole.select("doc_id", "text", "spans", "gone", "passage").mapInArrow(kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage boolean")
