"""Operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from skein.llm import brown, decontam, media, mixing, neardup, pii, quality, secrets, sharding, suffixes

random.seed(5)
VOCABULARY = ["".join(random.choices("abcdefgh", k=5)) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


BASE = prose(150, 1)
NEAR = BASE.replace(BASE.split()[70], "other", 1)
PASSAGE = prose(110, 2)
TEXTS = [BASE, NEAR, BASE, PASSAGE + " " + prose(50, 3), prose(30, 4) + " " + PASSAGE, "", None, "two words", "two  WORDS", prose(3000, 9), PASSAGE, 'token = "abcdef0123456789"', "mail a.b@c.example.org now", prose(20, 6)]
ROWS = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", 7, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s0", 7, "x", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, size long, shard string, start int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards(docs, none):
    rows = sharding.shard_slots(docs, 5).collect()
    assert len(rows) == len(ROWS) and all(r.grown_shard in (r.shard, 5) for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.doc_id: r.size for r in rows}[6] == 8
    assert sharding.shard_slots(none, 5).count() == 0
    keys = np.arange(200_000, dtype=np.uint64)
    for n in (1, 7, 24):
        a, b = sharding.jump(sharding.mix64(keys), n), sharding.jump(sharding.mix64(keys), n + 1)
        assert ((a == b) | (b == n)).all() and np.bincount(a).min() > 0.9 * len(keys) / n


def test_mix(docs, none):
    rows = mixing.plan_mix(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((x[0], words(x[1])) for x in ROWS)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and all(r.taken <= 2 * r.size for r in own)
    assert sum(t for t in {r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert mixing.plan_mix(none).count() == 0
    order = mixing.mixed_order(docs)
    assert order.columns == docs.columns and order.count() > 0


def test_share_is_a_water_level():
    assert mixing.share([10, 100, 100], [3, 1, 2], 315, 2) == pytest.approx([20, 295 / 3, 590 / 3])


def test_near_duplicates(docs, none, monkeypatch):
    rows = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert [rows[i].component_id for i in range(6)] == [0, 0, 0, 3, 4, 5]
    assert rows[7].n_shingles == rows[8].n_shingles == 1 and rows[8].component_id == 7 and not rows[8].kept
    assert rows[5].n_shingles == 0 and rows[6].kept
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.first_of_each_group(docs).columns == docs.columns


def brute_components(rows, percent):
    sets = neardup.shingle_sets([t.encode() for _, t in rows])
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if root[i] != root[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return {rows[i][0]: rows[x][0] for i, x in enumerate(root)}


#: Sizes of a cluster and of a node that one task holds: as they are, and so small that the distributed ways run.
@pytest.mark.parametrize(("cap", "node", "pairs"), [(4000, 1 << 15, 1 << 17), (4, 1 << 15, 1 << 17), (4, 24, 40), (4000, 10, 8)])
def test_many_near_copies(spark, monkeypatch, cap, node, pairs):
    for name, value in (("CLUSTER_DOCUMENTS", cap), ("NODE", node), ("PAIRS", pairs), ("DEEPEST", 3)):
        monkeypatch.setattr(neardup, name, value)
    r, rows = random.Random(8), []
    for i in range(60):
        words = BASE.split()
        for _ in range(r.randrange(1, 6)):
            words[r.randrange(len(words))] = f"w{r.randrange(999)}"
        rows.append((i, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == brute_components(rows, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_pairs_in_boilerplate_are_found(spark, monkeypatch, percent):
    """Pairs at the threshold among documents that share half of their words: recall over all links is 0.99 or more."""
    monkeypatch.setattr(neardup, "PAIRS", 64)
    r, rows, shared = random.Random(3), [], prose(60, 77)
    for i in range(400):
        words = prose(60, 1000 + i).split()
        other = list(words)
        for _ in range(1 if percent == 85 else 2):
            other[r.randrange(60)] = f"o{r.randrange(99999)}"
        rows += [(2 * i, shared + " " + " ".join(words)), (2 * i + 1, shared + " " + " ".join(other))]
    want = brute_components(rows, percent)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    links = [k for k, v in want.items() if k != v]
    assert len(links) > 300 and sum(got[k] == want[k] for k in links) >= 0.99 * len(links)
    assert all(got[k] == k for k in want if want[k] == k)


def test_ids_of_near_copies(spark):
    rows = [(5, BASE), (5, PASSAGE), (None, BASE), (7, BASE), (2, PASSAGE), (None, None), (9, "")]
    got = [tuple(x)[:1] + tuple(x)[2:] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()]
    assert sorted(got, key=str) == sorted([(5, 2, False), (5, 2, False), (None, None, True), (7, 2, False), (2, 2, True), (None, None, True), (9, 9, True)], key=str)
    with pytest.raises(TypeError):
        neardup.near_duplicates(spark.createDataFrame([("a", BASE)], "doc_id string, text string"))
    clash = spark.createDataFrame([(1, BASE, 4, 5), (2, NEAR, 4, 5)], "doc_id long, text string, dropped long, __id long")
    assert [tuple(x) for x in neardup.first_of_each_group(clash).collect()] == [(1, BASE, 4, 5)]


@pytest.mark.parametrize("held", [30, 100_000])
def test_brown_scores(docs, none, held):
    """Counts, classes and both scores against dictionaries; the words that aren't held meet their counts in a join."""
    model = brown.learn(docs, units=20, endings=8, classes=6, held=held)
    rows = brown.score(docs, model).collect()
    assert len(rows) == len(ROWS)
    words = lambda t: (t or "").encode().lower().split()
    c, steps = collections.Counter(), collections.Counter()
    of = lambda w: model.class_of(w) if w else len(model.step) - 1
    for i, t, *_ in ROWS:
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*words(t), b""])
            path = [of(b""), *map(of, words(t)), of(b"")]
            steps.update(zip(path[:-1], path[1:], strict=True))
    n, v, k = sum(c.values()), len(c), len(model.step)
    total, kinds = collections.Counter(), collections.Counter()
    for w, x in c.items():
        total[of(w)] += x
        kinds[of(w)] += 1
    after = collections.Counter()
    for (a, _), x in steps.items():
        after[a] += x

    def log_p(a, w):
        b = of(w)
        to = (steps[a, b] + 10 * (total[b] + 1) / (n + k)) / (after[a] + 10)
        return math.log10(to) + math.log10((c[w] + 0.1) / (total[b] + 0.1 * (kinds[b] + 1)))

    texts = {x[0]: x[1] for x in ROWS}
    for r in rows:
        tokens = [*words(texts[r.doc_id]), b""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        assert r.score == pytest.approx(sum(log_p(of(a), w) for a, w in zip([b"", *tokens[:-1]], tokens, strict=True)))
        assert r.perplexity == pytest.approx(10 ** (-r.score / len(tokens)))
    empty = brown.learn(none, units=20, endings=8, classes=6)
    assert brown.score(none, empty).count() == 0
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in brown.score(docs, empty).collect())


def test_own_neighbours_beat_endings(spark, monkeypatch):
    """Words below the ``units`` most frequent are better foretold by classes of their own than by those of their endings."""
    r = random.Random(4)
    left, right = [f"l{i}x" for i in range(40)], [f"r{i}x" for i in range(40)]
    often = [1 / (i + 1) for i in range(40)]
    rows = [(i, " ".join(w for _ in range(20) for w in (*r.choices(left, often), *r.choices(right, often)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def unseen():
        return sum(x.score for x in brown.score(df, brown.learn(df, units=24, endings=2, classes=4)).collect() if x.held_out)

    own = unseen()
    monkeypatch.setattr(brown, "LEAST", 1 << 40)
    other = unseen()
    assert own > other, (own, other)
    words = brown.tokens_of([b"A bc a", b"", b"bc"])
    assert words.first.tolist() == [0, 4, 5, 7] and words.word[1] == words.word[3] and words.word[2] == words.word[6] and words.word[4] == words.word[5] == 0


def test_exchange_ends_where_no_move_gains():
    def gain(b, m):
        one = np.eye(4)[m]
        table = one.T @ b @ one
        x = lambda a: (a * np.log(np.maximum(a, 1))).sum()
        return x(table) - x(table.sum(0)) - x(table.sum(1))

    r = np.random.default_rng(0)
    for _ in range(20):
        b = r.integers(0, 30, (9, 9)) * (r.random((9, 9)) < 0.4).astype(float)
        b[8] = b[:, 8] = 0
        m = brown.exchange(b, 4, 50)
        assert max(gain(b, np.where(np.arange(9) == w, c, m)) for w in range(8) for c in range(3)) <= gain(b, m) + 1e-6


def test_media_round_trip(docs, none):
    stored = media.store(docs)
    rows = media.resolve(media.interleave(stored.select("doc_id", "n_bytes", "html"), "html"), media.read_back(stored)).collect()
    assert len(rows) == len(ROWS)
    texts = {x[0]: (x[1] or "").encode() for x in ROWS}
    for r in rows:
        t = texts[r.doc_id]
        payload = t.ljust(max(1, -(-len(t) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.pack(t)).hexdigest()
    assert media.read_back(media.store(none)).count() == 0


def test_sequences():
    page = "<p>One <b>two</b><figure><img src='media:x' alt='a'><figcaption>Cap</figcaption></figure><script>no</script>three<img src='media:x'>"
    got = media.parse_sequence(page)
    assert [(x["kind"], x["text"], x["ref"], x["caption"]) for x in got] == [("text", "One two", None, None), ("image", None, "media:x", "Cap"), ("text", "three", None, None), ("image", None, "media:x", None)]
    assert media.parse_sequence(None) == []


@pytest.mark.parametrize("hot", [4000, 1])
def test_repeats(docs, none, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = suffixes.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    texts = [(x[0], (x[1] or "").encode()) for x in ROWS]
    c = collections.Counter(t[i : i + 400] for _, t in texts for i in range(len(t) - 399))
    want = collections.Counter()
    for k, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if c[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        rest = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        want[k, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want
    assert suffixes.remove_repeats(none).count() == 0


def test_loser_tree_merges_any_runs():
    r = random.Random(4)
    keys = sorted(bytes(r.choices(b"ab", k=r.randrange(8, 14))) for _ in range(200))
    runs = [suffixes.Run(suffixes.front_code([(k, b"", b"o" * 16, 0, 0) for k in keys[i::7]])) for i in range(7)]
    out = suffixes.merge(runs)
    assert [runs[a].key[i] for a, i, _ in out] == keys
    assert [p for *_, p in out][1:] == [suffixes.common(a, b) for a, b in zip(keys, keys[1:], strict=False)]


def test_decontamination(spark, docs, none):
    item = " ".join(PASSAGE.split()[:30])
    changed = item.split()
    changed[7] = changed[20] = "zz"
    bench = spark.createDataFrame([(1, item), (2, "two words"), (3, ""), (4, None), (1, item)], "item_id long, text string")
    extra = spark.createDataFrame([(90, "x " + " ".join(changed) + " y", "en", "s", 1, "x", 1), (None, item, "en", "s", 1, "x", 1)], SCHEMA)
    rows = {r.doc_id: r for r in decontam.decontaminate(docs.unionByName(extra), bench).collect()}
    assert {k for k, r in rows.items() if r.contaminated} == {3, 4, 7, 8, 10, 90, None}
    assert rows[90].agree == 28
    assert decontam.decontaminate(none, bench).count() == 0
    assert decontam.clean_documents(docs, bench).columns == docs.columns
    assert decontam.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_quality(spark, none):
    r = random.Random(2)
    rows, grades = [], []
    for i in range(600):
        g = r.choice([0, 1, 2, 2, 2])
        words = prose(60, i).split()
        if g == 0:
            words[r.randrange(60)] = r.choice(["vile", "awful"])
        rows.append((i, " ".join(w + "###" for w in words) if g == 1 else " ".join(words)))
        grades.append((i, g if i % 50 else None))
    df, ratings = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(grades, "doc_id long, grade int")
    model = quality.fit_grades(df.where("doc_id < 450"), ratings, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = {x.doc_id: x.keep for x in quality.grade_documents(df.where("doc_id >= 450"), model, 2).collect()}
    truth = dict(grades)
    right = [got[k] == (truth[k] == 2) for k in got if truth[k] is not None]
    assert sum(right) / len(right) > 0.95
    assert quality.fit_grades(none, ratings, 3) is None
    assert quality.grade_documents(df, None, 2).where("not keep").count() == 0


def test_pii_equals_patterns(docs):
    r = random.Random(1)
    parts = ["1", "25", "4111111111111111", ".", ".", " ", "-", "+", "@", "a", "b%", "é", "(", "10.0.0.1", "x.com", "+1 (017) 555-7713"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(20)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert [x for x in pii.find_spans(t) if x[0] in pii.BASE] == want
    assert pii.find_spans("9" * 5000 + ".1.1.1") == []
    got = {x.doc_id: x for x in pii.scan_pii(docs).collect()}
    assert got[12].n_email == 1 and got[12].spans == "email:5:22" and got[6].spans == ""


def test_secrets_unwrap(docs):
    import base64
    import gzip

    inner = 'password = "hunter2hunter2"'
    twice = base64.b64encode(gzip.compress(base64.b64encode(inner.encode()))).decode()
    escaped = "".join(f"%{b:02x}" for b in inner.encode())
    assert ("base64.gzip.base64.assign", 2, 2 + len(twice)) in secrets.find_secrets("é " + twice + " z")
    # the closing quote is no part of the match: spans end at the last character of the value
    assert ("url.assign", 0, 3 * (len(inner) - 1)) in secrets.find_secrets(escaped)
    got = {x.doc_id: x for x in secrets.scan_secrets(docs).collect()}
    assert (got[11].n_assign, got[11].n_hex) == (1, 1) and got[5].spans == ""


def test_escaped_values_keep_their_keys():
    for text, kind in (('password: "abc%2Fdef%2Bghijkl"', "url.assign"), (r'''"token": "\u0061bc\u002Fdefghijklm"''', "unicode.assign")):
        start = text.index("p" if "pass" in text else "t")
        assert secrets.find_secrets(text) == [(kind, start, len(text) - 1)]
    # what the root shows already is not reported again by a layer that keeps it
    plain = "password=hunter2hunter2"
    assert secrets.find_secrets(plain + " 100%25 of %2525") == [("assign", 0, len(plain))]
    pair = r"\ud83d\ude00 secret=\u0061bcdefghijklm"
    assert secrets.find_secrets(pair) == [("unicode.assign", 13, len(pair))]


def test_short_wrapped_joined_and_unreadable_layers(monkeypatch):
    import base64
    import gzip

    def kinds(data, wrap=None):
        token = base64.b64encode(data).decode() if wrap is None else base64.encodebytes(data).decode().strip().replace("\n", wrap)
        return {k for k, s, e in secrets.find_secrets("a: " + token) if (s, e) == (3, 3 + len(token))}

    secret = b'password = "hunter2hunter2"'
    for n in (16, 17):
        assert "base64.hex" in kinds(b"0123456789abcdef0"[:n])
    noise = random.Random(3).randbytes(150)
    long = b"words " * 8 + secret + b" words" * 20
    for wrap in ("\n", "\r\n", "\n  "):
        assert "base64.assign" in kinds(long, wrap)
        assert "base64.gzip.assign" in kinds(gzip.compress(noise.hex().upper().encode() + b" " + secret), wrap)
    block = base64.b64encode(b"words " * 8 + secret + b" " * 38).decode()
    pem = f"-----BEGIN KEY-----\n{block[:76]}\n{block[76:]}\n-----END KEY-----"
    assert len(block) == 152 and ("base64.assign", 20, 173) in secrets.find_secrets(pem)
    assert "base64.gzip.assign" in kinds(gzip.compress(b"one") + gzip.compress(secret))
    assert "base64.assign" in kinds(noise + b" " + secret)
    monkeypatch.setattr(secrets, "MAX_LAYER", 1000)
    monkeypatch.setattr(secrets, "PART", 300)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    for at in range(4000, 4300, 7):
        assert {"base64.gzip.bomb", "base64.gzip.assign"} <= kinds(gzip.compress(b" " * at + secret + b" " * 3000))


def test_pipeline_takes_near_copies_from_four_fifths(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    other = ["x" if i in (30, 60) else w for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, prose(80, 70))], "doc_id long, text string")
    assert {x.doc_id for x in corpus_pipeline.distinct(spark, df, "").collect()} == {1, 3}
    assert all(x.kept for x in neardup.near_duplicates(df, percent=85).collect())
    for percent in (80, 85):
        s = percent / 100
        assert neardup.least_agreeing(percent) <= 64 * s - 5 * math.sqrt(64 * s * (1 - s))


def test_decontamination_finds_what_laying_side_by_side_finds(spark):
    r = random.Random(11)
    items = [(n, " ".join(r.choice(VOCABULARY) for _ in range(n))) for n in [*range(1, 24), 30, 45]]
    docs = []
    for n, text in items:
        for _ in range(6):
            words = text.split()
            for i in r.sample(range(n), n - math.ceil(0.6 * n)):  # as many substitutions as the rule allows
                words[i] = "zz"
            docs.append((len(docs), " ".join(["y"] * r.randrange(3) + words + ["y"] * r.randrange(3))))
        for step in (3, 4):
            docs.append((len(docs), " ".join("zz" if i % step == 0 else w for i, w in enumerate(text.split()))))

    def agrees(doc, item):
        best = 0
        for start in range(1 - len(item), len(doc)):
            same = [0 <= start + i < len(doc) and doc[start + i] == w for i, w in enumerate(item)]
            inside = [x for i, x in enumerate(same) if 0 <= start + i < len(doc)]
            best |= sum(same) >= 0.6 * len(item) or max(sum(inside[i : i + 13]) for i in range(max(1, len(inside) - 12))) >= 11
        return bool(best)

    want = {k for k, t in docs if any(agrees(t.split(), x.split()) for _, x in items)}
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {x.doc_id for x in got.collect() if x.contaminated} == want and len(want) > 150
