"""MinHash near-dedup as a Chosen Path set similarity join (Christiani, Pagh and Sivertsen's CPSJoin).

A document's set holds its distinct shingles of ``WORDS`` words; 64 minwise tokens stand for the set. A tree starts with
all documents in one node. A node chooses two of the 64 places and sends each document to a child for each,
named by the token it has there, and so do the children. Two sets of similarity s stay together in each child
with chance s, so a tree parts them in all its branches, at whatever depth, with a chance q that solves
q = (1 - s + s q)^2 at most: 0.03 at 0.85, 0.06 at 0.8. As many independent trees are taken as bring that to ``MISS``.

A node is settled when its documents are of one cluster, or when those outside its main cluster are few enough to be
compared with all of it; before that, all its documents are compared with one of them, which gathers groups of copies.
Documents whose tokens agree in enough of the 64 places (five standard deviations below the threshold) share a cluster,
so a node yields as many pairs as join its clusters, not all that are alike. Nodes of up to ``NODE`` documents
are walked in one task. Larger ones are taken a level at a time by DataFrame operations: their documents meet a
pivot, those outside the main cluster go to every part of the rest, or the node branches on.

Links are confirmed on full sets: a cluster of bounded size in one task, which compares its documents unless they are linked
already; a larger one by the same trees, whose nodes now offer the likeliest pairs across confirmed components, and
more of them until none is left. Equal sets count once throughout, so copies cost nothing.

Cases: texts without words have an empty set and no links; texts of fewer than ``WORDS`` words are one shingle; a text of any
length counts whole; rows that share an id are one document, linked by each of its texts, and each gets a row; a null id is
linked with nothing (its component is null, and it is kept); of a tie the least id stays; an empty table stays
empty; extra columns don't matter, whatever their names. Keys must be of an integer type: others raise TypeError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from math import ceil, floor, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import BROADCAST_ROWS, fresh_name, stage, utf8
from skein.operators.components import components

WORDS = 5
PLACES = 64
#: Chance that all trees part a pair at the threshold, at most.
MISS = 1e-10
#: Documents of a node that one task holds (136 bytes each).
NODE = 1 << 15
#: Pairs of a node that are compared rather than parted further.
PAIRS = 1 << 17
#: Levels below which a node that doesn't part is compared whole.
DEEPEST = 64
#: A cluster of at most so many documents and shingles is compared in one task (8 bytes a shingle).
CLUSTER_DOCUMENTS = 1 << 14
CLUSTER_SHINGLES = 4 << 20
#: Candidates that a document of a larger cluster gets from a node in the first round.
OFFERED = 4
#: 100 * intersection >= percent * union links two sets; op2's threshold.
PERCENT = 85


def least_agreeing(percent: int) -> int:
    """Tokens that must agree before full sets are compared: five standard deviations below the threshold."""
    s = percent / 100
    return floor(PLACES * s - 5 * sqrt(PLACES * s * (1 - s)))


def trees_for(percent: int) -> int:
    """Trees that part a pair at the threshold, all of them, with a chance of MISS at most."""
    s = percent / 100
    q = ((1 - s) / s) ** 2  # the lesser root of q = (1 - s + s q)^2; the other one is 1
    return min(PLACES // 2, ceil(log(MISS) / log(q)))


_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_MULTIPLY = (_RNG.integers(1, 1 << 31, PLACES, dtype=np.uint64) * _U(2) + _U(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, PLACES, dtype=np.uint64).astype(np.uint32)
_TURN = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * _U(2) + _U(1)
#: Places in the order in which trees take them for their roots, two each.
_ROOTS = _RNG.permutation(PLACES).tolist()
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)])) for b in (_U(_BASE), _U(pow(_BASE, -1, 1 << 64)))]
    return _POWERS


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; all texts are hashed in one sweep over their bytes."""
    joined = b" ".join([b"", *texts, b""]).lower()
    at = np.frombuffer(joined, np.uint8)
    space = _SPACE[at]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _powers(len(at) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((at.astype(_U) + _U(1)) * up[: len(at)])])
    word = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    n = len(word) - WORDS + 1
    shingle = _mix(sum((word[i : i + n] * _TURN[i] for i in range(WORDS)), np.zeros(n, _U))) if n > 0 else np.zeros(0, _U)
    offsets = np.cumsum([1, *[len(t) + 1 for t in texts]])
    first = np.searchsorted(starts, offsets)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(shingle[a : b - WORDS + 1]))
        elif b > a:
            out.append(_mix(np.array([sum(int(w) * int(t) for w, t in zip(word[a:b], _TURN, strict=False)) + (b - a) & (1 << 64) - 1], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def tokens(shingles: np.ndarray) -> bytes:
    """The 64 minwise tokens, 2 bytes each."""
    least = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    short = (shingles >> _U(32)).astype(np.uint32)
    for i in range(0, len(short), 512):
        np.minimum(least, (short[i : i + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return (_mix(least.astype(_U) + _U(1)) >> _U(48)).astype(np.uint16).tobytes()


def _chunks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about a megabyte of text, or one document."""
    at, size, texts = 0, 0, []
    for i in range(batch.num_rows):
        texts.append(memoryview(batch.column(text)[i].as_buffer()).tobytes())
        size += len(texts[-1])
        if size > 1 << 20:
            yield batch.slice(at, i + 1 - at), texts
            at, size, texts = i + 1, 0, []
    if texts:
        yield batch.slice(at), texts


def sketches(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, mark, tokens): mark is a digest of the set, null if it is empty."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _chunks(whole, 1):
                sets = shingle_sets(texts)
                marks = [blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                yield pa.record_batch([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array([tokens(x) if len(x) else None for x in sets], pa.binary())], ["doc_id", "n_shingles", "mark", "tokens"])

    return df.select(_long(df, key).alias("doc_id"), utf8(F.col(text)).alias("text")).mapInArrow(sketched, "doc_id long, n_shingles long, mark binary, tokens binary")


def _long(df: DataFrame, key: str) -> Column:
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"near-duplicate keys must be integers; {key} is {kind}")
    return F.col(key).cast("long")


# --- the trees: nodes within one task ---


def _hashed(z: int) -> int:
    z &= (1 << 64) - 1
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return z ^ z >> 31


def _two_places(name: int) -> tuple[int, int]:
    h = _hashed(name)
    first = h % PLACES
    return first, (first + 1 + (h >> 32) % (PLACES - 1)) % PLACES


def _child(name: int, place: int, token: int) -> int:
    return _hashed(_hashed(name) + (place << 16 | token))


def _children(tok: np.ndarray, at: np.ndarray, name: int) -> Iterator[tuple[np.ndarray, int]]:
    """(documents, name) of a node's children that hold more than one."""
    for place in _two_places(name):
        seen = tok[at, place]
        order = np.argsort(seen, kind="stable")
        cuts = np.flatnonzero(seen[order][1:] != seen[order][:-1]) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                yield at[part], _child(name, place, int(seen[part[0]]))


class _Clusters:
    """Clusters of a node's documents, and the pairs that joined them."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)
        self.pairs: list[tuple[int, int]] = []

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while not np.array_equal(nxt := self.parent[found], found):
            found = nxt
        self.parent[at] = found
        return found

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        """Join pairs of different clusters; of pairs between the same two, the first."""
        a, b = self.roots(left), self.roots(right)
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return
        _, first = np.unique(a[apart] * len(self.parent) + b[apart], return_index=True)
        for i in apart[first].tolist():
            x, y = self._root(int(left[i])), self._root(int(right[i]))
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.pairs.append((int(left[i]), int(right[i])))

    def _root(self, x: int) -> int:
        while (y := int(self.parent[x])) != x:
            x = y
        return x


def _agreeing(tok: np.ndarray, some: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(part of some, agreeing places with each of at), a bounded part at a time."""
    step = max(1, (1 << 15) // len(at))
    all_of = tok[at]
    for i in range(0, len(some), step):
        part = some[i : i + step]
        yield part, (tok[part][:, None, :] == all_of[None, :, :]).sum(axis=2, dtype=np.uint8)


def _outside(labels: np.ndarray) -> np.ndarray:
    """Which documents are not of the commonest label; the least one of a tie."""
    kinds, of, times = np.unique(labels, return_inverse=True, return_counts=True)
    return np.flatnonzero(of != times.argmax()) if len(kinds) > 1 else np.zeros(0, np.int64)


def node_pairs(tok: np.ndarray, name: int, agree: int) -> list[tuple[int, int]]:
    """Pairs (places in ``tok``) that join all clusters a node's subtree finds: no more than its documents less one."""
    clusters = _Clusters(len(tok))

    def compare(some: np.ndarray, at: np.ndarray) -> None:
        for part, same in _agreeing(tok, some, at):
            i, j = np.nonzero(same >= agree)
            clusters.join(part[i], at[j])

    todo = [(np.arange(len(tok)), name, 0)]
    while todo:
        at, name, depth = todo.pop()
        for pivot in (None, 0, 1):
            if pivot is not None:
                compare(at[[_hashed(name + pivot) % len(at)]], at)
            out = at[_outside(clusters.roots(at))]
            if len(out) * len(at) <= PAIRS or depth >= DEEPEST:
                if len(out):
                    compare(out, at)
                break
        else:
            todo += [(part, child, depth + 1) for part, child in _children(tok, at, name)]
    return clusters.pairs


def node_offers(tok: np.ndarray, labels: np.ndarray, name: int, agree: int, most: int) -> list[tuple[int, int, int, bool]]:
    """(place, other, agreeing, there are more): for each document outside a node's main label the ``most`` likeliest of other labels."""
    found: list[tuple[int, int, int, bool]] = []
    todo = [(np.arange(len(tok)), name, 0)]
    while todo:
        at, name, depth = todo.pop()
        out = at[_outside(labels[at])]
        if len(out) * len(at) <= 32 * PAIRS or depth >= DEEPEST:
            for part, same in _agreeing(tok, out, at) if len(out) else ():
                for row, o in zip(same, part.tolist(), strict=True):
                    near = np.flatnonzero((row >= agree) & (labels[at] != labels[o]))
                    best = near[np.argsort(-row[near].astype(np.int16), kind="stable")[:most]]
                    found += [(o, int(at[j]), int(row[j]), len(near) > most) for j in best]
        else:
            todo += [(part, child, depth + 1) for part, child in _children(tok, at, name)]
    return found


def _flat(column: pa.Array) -> np.ndarray:
    """The tokens of a batch, a row each; no token is null."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16).reshape(-1, PLACES)


def _by_node(rows: DataFrame, walk: Callable[[int, np.ndarray, np.ndarray, np.ndarray], list[tuple]], names: list[str], pairs: Callable | None = None) -> DataFrame:
    """Rows of ``walk`` (name, ids, tokens, labels) over the nodes of rows (node, id, tokens, label); a node is bounded and stands in one task."""
    schema = pa.schema([(n, pa.int64()) for n in names])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the last node, which may go on in the next batch

        def close(parts: list[tuple[np.ndarray, ...]]) -> list[tuple]:
            node, ids, tok, label = (np.concatenate(x) for x in zip(*parts, strict=True))
            return walk(int(node[0]), ids, tok, label) if len(ids) > 1 else []

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in range(len(names))], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            found: list[tuple] = []
            node, ids, tok, label = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _flat(batch.column(2)), batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
            if held and held[-1][0][0] != node[0]:
                found += close(held)
                held = []
            first = 0
            if held and len(cuts) > 2:  # the node of before ends here
                held.append(tuple(x[: cuts[1]] for x in (node, ids, tok, label)))
                found += close(held)
                held, first = [], 1
            starts, sizes = np.array(cuts[first:-2], np.int64), np.diff(cuts[first:-1])
            if pairs is not None and len(starts):
                twos = starts[sizes == 2]
                found += pairs(ids, tok, twos)
                starts, sizes = starts[sizes > 2], sizes[sizes > 2]
            for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                if n > 1:
                    found += walk(int(node[a]), ids[a : a + n], tok[a : a + n], label[a : a + n])
            held.append(tuple(np.array(x[cuts[-2] :]) for x in (node, ids, tok, label)))
            if found:
                yield out(found)
        if held:
            yield out(close(held))

    dealt = rows.select("node", "id", "tokens", "label").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(walked, ", ".join(f"{n} long" for n in names))


# --- the trees: nodes that no task should hold ---


def _named(name: Column, place: Column | int, token: Column) -> Column:
    return F.xxhash64(name, F.lit(place) if isinstance(place, int) else place, token)


def _token(place: Column | int) -> Column:
    at = place * 2 + 1 if isinstance(place, Column) else F.lit(place * 2 + 1)
    return F.substring(F.col("tokens"), at, F.lit(2))


def _rooted(members: DataFrame, percent: int) -> DataFrame:
    """(node, id, tokens, label): the children of all roots."""
    places = _ROOTS[: 2 * trees_for(percent)]
    return members.select("id", "tokens", "label", F.explode(F.array(*[_named(F.lit(p), p, _token(p)) for p in places])).alias("node"))


def _branched(rows: DataFrame) -> DataFrame:
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PLACES)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(PLACES - 1)).cast("int"), F.lit(PLACES))
    return rows.select("id", "tokens", "label", F.explode(F.array(*[_named(F.col("node"), p, _token(p)) for p in (first, second)])).alias("node"))


def _bounded(members: DataFrame, percent: int, gather: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows (node, id, tokens, label) whose nodes hold NODE documents at most, and pairs found on the way if ``gather``.

    A larger node's documents first meet a pivot if ``gather``, which labels them by cluster. If all have one label it is
    settled; if at most half of NODE are outside the main one, these go to every part of the others; else it branches.
    """
    rows, done, pairs = _rooted(members, percent), [], None
    if members.count() <= NODE:
        return rows, None
    for depth in range(DEEPEST + 1):
        large = stage(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > NODE), "large")
        if large.isEmpty():
            done.append(rows)
            break
        few = large.count() <= BROADCAST_ROWS
        done.append(rows.join(F.broadcast(large) if few else large, "node", "left_anti"))
        at = stage(rows.join(F.broadcast(large) if few else large, "node"), "members")
        if gather:
            star = stage(_with_pivots(at, least_agreeing(percent)), "star")
            pairs = star if pairs is None else pairs.unionByName(star)
            labels = stage(components(pairs, "a", "b"), "labels").select(F.col("node").alias("id"), "component")
            at = at.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
            at = stage(at, "members")
        by = at.groupBy("node", "label").agg(F.count("*").alias("k"))
        spread = by.groupBy("node").agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("main"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("out"))
        spread = stage(spread.where("out > 0"), "spread")
        at = at.select("node", "id", "tokens", "label").join(F.broadcast(spread) if few else spread, "node")
        mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        half = NODE // 2
        now = F.col("out") <= half
        dealt = at.where(now).withColumn("parts", F.ceil((F.col("n") - F.col("out")) / half).cast("int"))
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        dealt = dealt.withColumn("part", F.explode(F.when(F.col("label") == F.col("main"), F.array(mine)).otherwise(every)))
        done.append(dealt.select(F.xxhash64("node", F.lit("part"), "part").alias("node"), "id", "tokens", "label"))
        rows = at.where(~now)
        if depth == DEEPEST:  # every two parts meet
            met = rows.withColumn("parts", F.ceil(F.col("n") * 2 / half).cast("int"))
            met = met.withColumn("mine", mine).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            met = met.select(F.xxhash64("node", F.least("mine", "part"), F.greatest("mine", "part")).alias("node"), "id", "tokens", "label")
            done.append(met)
        else:
            rows = stage(_branched(rows.select("node", "id", "tokens", "label")), "branched")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part.select(*whole.columns))
    return whole, pairs


def _with_pivots(members: DataFrame, agree: int) -> DataFrame:
    """Pairs (a, b) of each member with its node's pivot whose tokens agree in ``agree`` places."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_flat(batch.column(1)) == _flat(batch.column(3))).sum(axis=1) >= agree
            yield pa.record_batch([batch.column(i).filter(pa.array(same)) for i in (0, 2)], ["a", "b"])

    pivots = stage(members.groupBy("node").agg(F.min_by(F.struct(F.col("id").alias("p"), F.col("tokens").alias("pt")), F.xxhash64("id", "node")).alias("x")).select("node", "x.*"), "pivots")
    met = members.join(F.broadcast(pivots) if pivots.count() <= BROADCAST_ROWS // 10 else pivots, "node").where("id <> p")
    return met.select("id", "tokens", "p", "pt").mapInArrow(compared, "a long, b long")


def similar_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of (id, tokens) that join every two documents whose tokens agree in enough places."""
    agree = least_agreeing(percent)

    def walk(name: int, ids: np.ndarray, tok: np.ndarray, _: np.ndarray) -> list[tuple]:
        return [(int(ids[i]), int(ids[j])) for i, j in node_pairs(tok, name, agree)]

    def twos(ids: np.ndarray, tok: np.ndarray, at: np.ndarray) -> list[tuple]:
        near = at[(tok[at] == tok[at + 1]).sum(axis=1) >= agree]
        return list(zip(ids[near].tolist(), ids[near + 1].tolist(), strict=True))

    rows, more = _bounded(members.select("id", "tokens", F.col("id").alias("label")), percent, True)
    found = _by_node(rows, walk, ["a", "b"], twos)
    found = found if more is None else found.unionByName(more)
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def offered_pairs(members: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b, agree, more) across the labels of (id, tokens, label); more is 1 where a node has further pairs of a."""
    agree = least_agreeing(percent)

    def walk(name: int, ids: np.ndarray, tok: np.ndarray, labels: np.ndarray) -> list[tuple]:
        return [(int(ids[i]), int(ids[j]), n, int(more)) for i, j, n, more in node_offers(tok, labels, name, agree, most)]

    return _by_node(_bounded(members, percent, False)[0], walk, ["a", "b", "agree", "more"])


# --- full sets ---


def _sets_of(df: DataFrame, wanted: DataFrame, columns: list[str], key: str, text: str) -> DataFrame:
    """(columns of wanted, shingles) of the wanted ids, recomputed from their texts."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _chunks(whole, len(columns)):
                yield pa.record_batch([*batch.columns[:-1], pa.array([x.tobytes() for x in shingle_sets(texts)], pa.binary())], [*columns, "shingles"])

    few = wanted.count() <= BROADCAST_ROWS
    rows = df.select(_long(df, key).alias("id"), utf8(F.col(text)).alias("text")).join(F.broadcast(wanted) if few else wanted, "id")
    return rows.select(*columns, "text").mapInArrow(built, ", ".join([*[f"{c} long" for c in columns], "shingles binary"]))


def linked_within(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of ids that join all linked documents: a pair is only counted out while its ends are in different components."""
    n = len(ids)
    place = np.frombuffer(b"".join(tokens(x) for x in sets), np.uint16).reshape(n, PLACES)
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    kinds, codes = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(len(kinds), bool)
    root, out = np.arange(n), []
    least = least_agreeing(percent)
    for low, high in ((PLACES - 6, PLACES + 1), (least, PLACES - 6)):  # likely links first: they spare comparing the others
        for i in range(n - 1):
            apart = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
            if not len(apart):
                continue
            same = (place[apart] == place[i]).sum(axis=1)
            near = apart[(same >= low) & (same < high) & (100 * np.minimum(sizes[apart], sizes[i]) >= percent * np.maximum(sizes[apart], sizes[i]))]
            if not len(near):
                continue
            own = codes[starts[i] : starts[i + 1]]
            held[own] = True
            for j in near.tolist():
                if root[j] != root[i]:
                    both = int(held[codes[starts[j] : starts[j + 1]]].sum())
                    if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                        out.append((ids[i], ids[j]))
                        root[root == root[j]] = root[i]
            held[own] = False
    return out


def _within_clusters(df: DataFrame, of: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Links that join all linked documents of each bounded cluster, from their full sets; each set travels once."""

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        return pd.DataFrame(linked_within(group["id"].tolist(), [np.frombuffer(x, np.uint64) for x in group["shingles"]], percent), columns=["a", "b"], dtype=np.int64)

    return _sets_of(df, of, ["component", "id"], key, text).groupBy("component").applyInPandas(linked, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(memoryview(z.as_buffer()), np.uint64) for z in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    met = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    met = met.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    return stage(met.select("a", "b", "x", "y").mapInArrow(kept, "a long, b long"), "links")


def _large_clusters(df: DataFrame, members: DataFrame, pairs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Links of clusters that no task should hold, from (id, tokens) and the pairs that made them clusters.

    Rounds offer the likeliest pairs across the components confirmed so far; pairs that were checked are not checked again.
    Where a round brings no link, more are offered; it ends when nodes have no pair that isn't checked.
    """
    sets = stage(_sets_of(df, members.select("id").distinct(), ["id"], key, text), "sets", "uncompressed")
    checked = stage(pairs.select("a", "b"), "checked")
    links, most = confirmed(checked, sets, percent), OFFERED
    while True:
        labels = stage(components(links, "a", "b"), "labels").withColumnRenamed("node", "id")
        at = stage(members.join(labels, "id", "left").select("id", "tokens", F.coalesce("component", "id").alias("label")), "labelled")
        offers = stage(offered_pairs(at, percent, most), "offers")
        new = offers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(checked, ["a", "b"], "left_anti")
        new = stage(new, "new")
        if new.isEmpty():
            if not offers.agg(F.max("more")).first()[0]:
                return links
            most *= 8
            continue
        found = confirmed(new, sets, percent)
        if found.isEmpty():
            most *= 8
        checked, links = checked.unionByName(new), links.unionByName(found)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Sets whose intersection is ``percent`` of their union or more are linked. Per row: doc_id, n_shingles, component_id (least id that links lead to) and kept (it is that one)."""
    rows = stage(sketches(df, key, text), "sketches")
    known = rows.where("mark is not null and doc_id is not null")
    reps = stage(known.groupBy("mark").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")), "classes")
    classes = reps.select("mark", F.col("id").alias("rep"))
    repeated = known.groupBy("doc_id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("doc_id")
    same_id = known.join(repeated, "doc_id", "left_semi").join(classes, "mark").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    pairs = stage(similar_pairs(reps, percent), "pairs")
    clusters = stage(components(pairs, "a", "b"), "clusters").select(F.col("node").alias("id"), "component")
    sizes = clusters.join(reps.select("id", "n_shingles"), "id").groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    fits = (F.col("n") <= CLUSTER_DOCUMENTS) & (F.col("shingles") <= CLUSTER_SHINGLES)
    of = stage(clusters.join(sizes.select("component", fits.alias("fits")), "component"), "clusters")
    links = stage(_within_clusters(df, of.where("fits").select("id", "component"), key, text, percent).unionByName(same_id), "links")
    large = of.where("not fits").select("id")
    if not large.isEmpty():
        own = pairs.join(large.withColumnRenamed("id", "a"), "a", "left_semi")
        links = links.unionByName(_large_clusters(df, reps.join(large, "id", "left_semi").select("id", "tokens"), own, key, text, percent))
    labels = stage(components(links, "a", "b"), "labels")

    moved = classes.join(labels, F.col("rep") == F.col("node"), "left").select("mark", F.coalesce("component", "rep").alias("least"))
    met = rows.withColumn("mark", F.when(F.col("doc_id").isNotNull(), F.col("mark"))).join(moved, "mark", "left")
    component = F.coalesce("least", "doc_id")
    return met.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_each_group(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` whose id is the least of its component, unchanged."""
    name = fresh_name(df, "dropped")
    dropped = near_duplicates(df, key, text, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return df.join(dropped, F.col(key) == F.col(name), "left_anti")
