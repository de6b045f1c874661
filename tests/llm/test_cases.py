"""Registered queries and pipeline stages against brute force; nulls, empty tables, repeats, ties, long texts and clashing names."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import urllib.parse
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import brown, decontam, media, mixing, neardup, pii, quality, queries, secrets, sharding, suffixes

SF = "/root/testdata/sf0.001"
TEXTS = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
#: Names that operators use inside, or used once.
CLASH = "doc_id long, text string, source string, __id long, __g long, __p long, __s long, __n long, __at long, placed long, graded long, dropped long, found_id long, found_mark long, media_of long, row long, id long, at long, turns long"


def words(text):
    return (text or "").encode().lower().split()


def rows_of(spark, name):
    return {r.doc_id: r for r in getattr(queries, name)(spark, SF).collect()}


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def matches(pattern, text, kind, keep, flags=0):
    return [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, flags | re.ASCII) if keep(m)]


def base_secrets(text):
    found = matches(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, "assign", lambda m: len(m[2]) >= 12, re.IGNORECASE)
    found += matches("AKIA[A-Z0-9]+", text, "access", lambda m: len(m[0]) >= 18) + matches("[0-9a-f]+", text, "hex", lambda m: len(m[0]) >= 16)
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_secrets_query(spark):
    got = rows_of(spark, "op6_recursive_secrets")
    assert set(got) == set(TEXTS)
    for i, text in TEXTS.items():
        base = base_secrets(text or "")
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex"))
        assert got[i].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert not base or set(joined(base).split(",")) <= set(got[i].spans.split(","))


def test_nested_layers_are_found():
    """Random nests of the encodings: the secret is found under them, at the span of the outermost one."""
    r = random.Random(2)
    layer = {
        "base64": lambda b: base64.b64encode(b),
        "url": lambda b: "".join(f"%{x:02X}" for x in b).encode(),
        "unicode": lambda b: "".join(f"\\u{x:04x}" for x in b).encode(),
        "gzip": lambda b: base64.b64encode(gzip.compress(b, mtime=0)),
        "zlib": lambda b: base64.b64encode(zlib.compress(b)),
        "quoted": lambda b: urllib.parse.quote_from_bytes(b, safe="").encode(),
    }
    for _ in range(60):
        inner = f'password = "{"".join(r.choices("abcdefghkmnpqrstuvwxyz123456789", k=20))}"'.encode()
        names = r.choices(list(layer), k=r.randrange(1, 4))
        for n in names:
            inner = layer[n](inner)
        text = f"before it {inner.decode()} after"
        spans = secrets.find_secrets(text)
        hits = [(s, e) for k, s, e in spans if k.split(".")[-1] == "assign"]
        assert hits and all(10 <= s < e <= 10 + len(inner) for s, e in hits), names


def luhn(digits):
    total = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def test_pii_query(spark):
    got = rows_of(spark, "op10_anchored_pii")
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    for i, text in TEXTS.items():
        t = text or ""
        base = matches(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t, "email", bool)
        base += matches(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t, "ip", lambda m: all(int(x) <= 255 for x in m[0].split(".")))
        base += matches(r"[0-9]([\x20-]?[0-9])+", t, "card", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)))
        base += matches(r"\+[0-9][\x20().0-9-]+[0-9]", t, "phone", lambda m: 9 <= len(digits(m)) <= 15)
        assert got[i].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == kind for k, *_ in base) for kind in ("email", "ip", "card", "phone"))


def test_other_kinds_of_pii():
    found = {k: t[s:e] for t in ("see https://a.example/x?y=1, now", "at 12 Elm Street today", "account number: 12345678 ok", "IBAN GB82 WEST 1234 5698 7654 32.") for k, s, e in pii.find_spans(t)}
    assert found["url"] == "https://a.example/x?y=1" and found["address"].endswith("Street") and "account" in found


def test_media_query(spark):
    got = rows_of(spark, "op5_interleaved_media")
    for i, text in TEXTS.items():
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        stored = b"P5 192 %d 255\n" % (len(payload) // 192) + payload
        r, x = got[i], np.frombuffer(payload, np.uint8).astype(float)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        mean, spread, mark = r.feature.split()
        assert float(mean) == pytest.approx(x.mean(), abs=1e-4) and float(spread) == pytest.approx(x.var(), abs=1e-3)
        bands = x.reshape(-1, 64, 3).sum(axis=(0, 2))
        assert mark == f"{int(''.join('1' if b * 64 > x.sum() else '0' for b in bands), 2):016x}"


def test_sequences_of_a_page(spark):
    page = "<p>one</p><figure><img src='media:aa' alt='x'><img src='media:bb'><figcaption>both <b>of</b> them</figcaption></figure><p>two<img src='media:aa' title='again'></p>three"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "doc_id long, html string")
    seq = {r.doc_id: r.sequence for r in media.interleave(df, "html").collect()}
    assert [(x.position, x.kind, x.text or x.ref, x.caption) for x in seq[1]] == [(0, "text", "one", None), (1, "image", "media:aa", "both of them"), (2, "image", "media:bb", "both of them"), (3, "text", "two", None), (4, "image", "media:aa", "again"), (5, "text", "three", None)]
    assert seq[2] == seq[3] == []
    texts = spark.createDataFrame([(1, "first & <b>line</b>\n\nsecond"), (2, None), (3, "one")], "doc_id long, text string")
    stored = media.store(texts)
    seq = {r.doc_id: r for r in media.interleave(stored, "html").collect()}
    assert [(x.kind, x.text or x.ref, x.caption) for x in seq[1].sequence] == [("text", "first & <b>line</b>", None), ("image", "media:" + seq[1].digest, f"{seq[1].n_bytes} bytes"), ("text", "second", None)]
    assert [x.kind for x in seq[2].sequence] == ["image"] and [x.kind for x in seq[3].sequence] == ["text", "image"]
    assert {r.doc_id: r.position for r in media.resolve(media.interleave(stored.select("doc_id", "html"), "html"), media.read_back(stored)).collect()} == {1: 1, 2: 0, 3: 1}


def jump(key, buckets):
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_query(spark):
    got = getattr(queries, "op3_jump_hash_shards")(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(TEXTS)
    slots = collections.defaultdict(list)
    for r in got:
        raw = (TEXTS[r.doc_id] or "").encode()
        key = int(sharding.mix64(np.array([r.doc_id], np.int64).view(np.uint64))[0])
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "key", jump(key, 24), jump(key, 25))
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def grade_by_hand(model, text, wanted):
    w = set(words(text))
    score = float(sum(float(model.weights[i]) for i in quality.features((text or "").encode())))
    assert {zlib.crc32(x.strip(b".,;:!?\"'()[]")) % quality.DIMENSIONS for x in w} <= set(quality.features((text or "").encode()).tolist())
    tails = [1 - 1 / (1 + math.exp(-(t - score))) for t in model.thresholds]
    return sum(tails), tails[wanted - 1]


def test_quality_against_the_formula(spark):
    good, bad, vile = ["clear", "calm", "kind", "fine"], ["junk", "spam", "meh", "dull"], ["vile", "foul", "rude", "grim"]
    r = random.Random(1)
    text = lambda g: " ".join(r.choice((vile, bad, good)[g]) if r.random() < 0.5 else f"w{r.randrange(50)}" for _ in range(30))
    rows = [(i, text(i % 3)) for i in range(300)]
    docs = spark.createDataFrame([*rows, (0, rows[0][1]), (None, "clear calm"), (998, None), (999, "")], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(4, 9), (5, None), (None, 1)], "doc_id long, grade int")
    model = quality.fit_grades(docs, ratings, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.grade_documents(docs, model, 2).collect()
    assert len(got) == 304
    for x in got:
        expected, tail = grade_by_hand(model, x.text, 2)
        assert x.expected_grade == pytest.approx(expected, abs=1e-5) and x.tail_probability == pytest.approx(tail, abs=1e-5) and x.keep == (x.tail_probability >= 0.5)
    assert sum(x.keep == (x.doc_id % 3 == 2) for x in got if x.doc_id is not None and x.doc_id < 300) > 290
    assert quality.fit_grades(docs, ratings.limit(0), 3) is None
    assert all(x.keep and x.tail_probability is None for x in quality.grade_documents(docs, None, 2).collect())
    assert quality.grade_documents(docs.limit(0), model, 2).count() == 0


def test_passages_of_few_bytes_are_told(spark):
    r = random.Random(6)
    some = lambda n: " ".join("".join(r.choices("abcdef", k=4)) for _ in range(n))
    passage, short = some(52), some(30)
    rows = [(1, some(80) + " " + passage), (2, passage + "\n" + some(9)), (3, some(90) + " " + short), (4, short + " " + some(90)), (5, some(200)), (6, None), (7, passage[:200]), (8, some(60)), (9, "")]
    rows.append((10, rows[7][1]))
    assert len(passage) < 400
    got = {x.doc_id: x for x in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(i for i in got if got[i].passage) == [1, 2]
    assert all(x.n_removed == 0 for x in got.values())


def test_long_texts(spark):
    """Texts beyond the sweeps, batches and buffers of the operators count whole."""
    r = random.Random(9)
    long = " ".join(r.choices([f"w{i}" for i in range(3000)], k=260_000))  # 1.4 MB
    tail = " ".join(f"t{i}" for i in range(120))
    docs = spark.createDataFrame([(1, long + " " + tail), (2, tail), (3, long + " mail a.b@c.example.org")], "doc_id long, text string")
    assert len(long) > 1 << 20
    near = {x.doc_id: x.component_id for x in neardup.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 2, 3: 1}
    gone = {x.doc_id: x for x in suffixes.remove_repeats(docs).collect()}
    assert gone[2].n_removed == len(tail) and gone[1].n_removed == gone[1].n_bytes and gone[3].n_removed == len(long) + 1
    assert {x.doc_id: x.n_email for x in pii.scan_pii(docs).collect()} == {1: 0, 2: 0, 3: 1}
    items = spark.createDataFrame([(1, tail)], "item_id long, text string")
    assert {x.doc_id: x.contaminated for x in decontam.decontaminate(docs, items).collect()} == {1: True, 2: True, 3: False}
    model = brown.learn(docs, units=50, classes=8)
    assert {x.doc_id: x.n_tokens for x in brown.score(docs, model).collect()} == {1: 260_121, 2: 121, 3: 260_003}


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, t, "s", *range(16)) for i, t in ((1, "one two three four five six"), (1, "other words stand in this row"), (None, "a b c"), (2, None))], CLASH)
    items = spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string")
    kept = decontam.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a b c"), (1, "other words stand in this row"), (2, "")]
    assert mixing.mixed_order(docs).columns == docs.columns and mixing.mixed_order(docs).count() > 3
    assert sharding.assign_shards(docs, 3).columns == [*docs.columns, "shard", "grown_shard"]
    assert quality.grade_documents(docs, None, 1).columns == [*docs.columns, "expected_grade", "tail_probability", "keep"]
    assert neardup.first_of_each_group(docs).columns == docs.columns
    none = docs.limit(0)
    stored = media.store(none)
    assert media.resolve(media.interleave(stored.select("doc_id", "n_bytes", "html"), "html"), media.read_back(stored)).count() == 0
    for empty in (secrets.scan_secrets(none), pii.scan_pii(none), pii.redact(none), decontam.decontaminate(none, items), suffixes.remove_repeats(none), mixing.mixed_order(none), sharding.assign_shards(none, 3), neardup.first_of_each_group(none), decontam.clean_documents(none, items)):
        assert empty.count() == 0
    assert decontam.clean_documents(docs, items.limit(0)).count() == 4
    assert pii.redact(spark.createDataFrame([(1, "to a@b.co"), (2, None)], "doc_id long, text string")).select("redacted").collect() == [("to [email]",), (None,)]


def contaminated(text, items):
    t = [x.decode() for x in words(text)]
    for item in items:
        w = [x.decode() for x in words(item)]
        for s in range(-len(w) + 1, len(t)):
            same = [0 <= s + j < len(t) and t[s + j] == x for j, x in enumerate(w)]
            if sum(same) >= 0.6 * len(w) or any(sum(same[j : j + 13]) >= 11 for j in range(len(w))):
                return True
    return False


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(12)
    vocabulary = [f"v{i}" for i in range(400)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [prose(20), prose(16)]
    rows = []
    for i in range(150):
        text = prose(60) + " fine clear" * 3 if i % 3 else prose(60) + " vile junk" * 3
        if i % 10 == 1:
            text += " " + items[i % 2]
        rows.append((i, text, f"s{i % 4}" if i % 7 else None))
    for i in range(150, 180):  # near copies of good ones, at all similarities
        w = rows[i - 149][1].split()
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w), "s1"))
    rows += [(180, rows[2][1], "s0"), (181, None, "s0"), (182, "", None), (None, prose(30) + " fine clear" * 3, "s2")]
    docs = spark.createDataFrame([(a, b, "en", c, len(b or "")) for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0 and i % 2)) for i in range(150)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = quality.fit_grades(docs, quality.label_grades(labels), 3)
    kept = [x for x in rows if grade_by_hand(model, x[1], 2)[1] >= 0.5]
    assert 90 < len(kept) < len(rows)
    sets = [set(map(tuple, zip(*[words(x[1])[k:] for k in range(5)], strict=False))) for x in kept]
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if None not in (kept[i][0], kept[j][0]) and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    least = {x: min((kept[i][0] for i in range(len(kept)) if root[i] == x and kept[i][0] is not None), default=None) for x in root}
    kept = [x for i, x in enumerate(kept) if x[0] is None or x[0] == least[root[i]]]
    kept = [x for x in kept if not contaminated(x[1], items)]
    plan = mixing.plan_mix(spark.createDataFrame(kept, "doc_id long, text string, source string")).collect()
    copies = collections.Counter({x.doc_id: sum(2 * c.words >= x.size for c in x.copies) for x in plan})

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(x.doc_id for x in got) == +copies
    texts = {x[0]: x[1] for x in kept}
    for x in got:
        key = int(sharding.mix64(np.array([sharding.NULL_KEY if x.doc_id is None else x.doc_id], np.int64).view(np.uint64))[0])
        assert x.text == texts[x.doc_id] and x.shard == jump(key, 24) and x.grown_shard == jump(key, 25)
    none = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, none, str(tmp_path)).where(F.lit(True)).count() == 0
