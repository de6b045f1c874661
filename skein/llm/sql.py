"""DuckDB SQL for the dealt operators that SQL can express."""

#: The weighting rule of the curriculum: targets by water level, documents laid end to end by the hash of the id.
_OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, md5(coalesce(doc_id::VARCHAR, '|' || coalesce(text, ''))) AS ord,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS ssize FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s0),
s2 AS (SELECT *, [3.0, 1.0, 2.0][(rk % 3 + 1)::INT]::DOUBLE AS w, [0.5, -0.5, 0.0][(rk % 3 + 1)::INT]::DOUBLE AS a FROM s1),
s3 AS (SELECT *, 2 * ssize / w AS cap FROM s2),
s4 AS (SELECT *, coalesce(sum(2 * ssize) OVER before, 0)::DOUBLE AS full_before, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS pull
  FROM s3 WINDOW before AS (ORDER BY cap, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, (1.5 * (sum(ssize) OVER ())::DOUBLE - full_before) / pull AS lvl FROM s4),
lv AS (SELECT lvl AS level FROM s5 WHERE lvl <= cap ORDER BY cap, rk LIMIT 1),
s6 AS (SELECT *, CASE WHEN ssize = 0 THEN 0.0 ELSE least((2 * ssize)::DOUBLE, w * level) END AS target FROM s5, lv),
s7 AS (SELECT *, round_even(target, 0)::BIGINT AS goal,
    w * (1 + a) * (target / ((w * (1 + a) + w * (1 - a)) / 2)) AS rate,
    (w * (1 - a) - w * (1 + a)) * (target / ((w * (1 + a) + w * (1 - a)) / 2)) AS slope FROM s6),
p AS (SELECT d.rid, d.doc_id, d.size, s7.ssize, s7.target, s7.goal, s7.rate, s7.slope,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source),
q AS (SELECT *, least(size, greatest(0, goal - start)) AS w1, least(size, greatest(0, goal - start - ssize)) AS w2 FROM p)
SELECT doc_id, size, ssize AS source_size, target, (w1 + w2)::BIGINT AS taken,
  CASE WHEN w1 > 0 OR (size = 0 AND start < goal) THEN
    CASE WHEN start <= 0 THEN 0.0 ELSE 2 * start::DOUBLE / (rate + sqrt(greatest(0.0, rate * rate + 2 * slope * start::DOUBLE))) END
  END AS position
FROM q
"""

#: Every item laid along every document at every place, by counting equal words on each diagonal: no seeds, no masks.
_OP9 = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
tw AS (SELECT rid, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM t),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM b),
equal AS (SELECT tw.rid, bw.item_id, bw.n, tw.pos - bw.pos AS s, bw.pos AS ip FROM tw JOIN bw ON tw.word = bw.word),
likely AS MATERIALIZED (SELECT rid, item_id, n, s, count(*) AS agree FROM equal GROUP BY rid, item_id, n, s HAVING count(*) >= least(0.6 * n, 11)),
runs AS (SELECT rid, item_id, s, max(k) AS run FROM (SELECT e.rid, e.item_id, e.s, count(*) OVER (PARTITION BY e.rid, e.item_id, e.s ORDER BY e.ip RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM equal e SEMI JOIN likely l ON l.rid = e.rid AND l.item_id = e.item_id AND l.s = e.s) GROUP BY rid, item_id, s),
ok AS (SELECT rid, item_id, agree, agree / n AS share FROM likely JOIN runs USING (rid, item_id, s) WHERE agree >= 0.6 * n OR run >= 11),
best AS (SELECT rid, count(DISTINCT item_id) AS n_items, max({'share': share, 'agree': agree, 'item': -item_id}) AS best FROM ok GROUP BY rid)
SELECT t.doc_id, best.rid IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, -best.item AS item_id, coalesce(best.agree, 0)::INT AS agree, coalesce(best.share, 0.0)::DOUBLE AS share
FROM t LEFT JOIN best USING (rid)
"""

#: Shingle sets joined by shingle, similarity counted on whole sets, components by spreading the least id.
_OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
u AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS seen FROM ways UNION SELECT reach.node, ways.b FROM reach JOIN ways ON ways.a = reach.seen),
label AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, coalesce(component, s.doc_id) AS component_id, s.doc_id = coalesce(component, s.doc_id) AS kept
FROM s LEFT JOIN label ON s.doc_id = label.node
"""

#: The reflected CRC polynomial shifted as the bits 1 to 128 of a byte ask for.
_CRC_BITS = [0xEDB88320]
for _ in range(7):
    _CRC_BITS.insert(0, (_CRC_BITS[0] >> 1) ^ (0xEDB88320 if _CRC_BITS[0] & 1 else 0))


def _crc32(data: str) -> str:
    """Unsigned CRC-32 of a list of bytes."""
    low = "((xor(c, b)) & 255)"
    step = "c >> 8"
    for i, x in enumerate(_CRC_BITS):
        step = f"xor({step}, (({low} >> {i}) & 1) * {x}::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {data}), lambda c, b: {step}), 4294967295::BIGINT)"


def _octets(text: str) -> str:
    """List of the UTF-8 bytes of a text."""
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"


#: Keys mixed and walked down their chains in 128-bit numbers, all shard counts from the same walk.
_OP3 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_crc32(_octets("coalesce(text, '')"))} AS text_crc32,
    ((coalesce(doc_id, 1853189228)::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT AS k FROM documents),
m0 AS (SELECT rid, (k + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM d),
m1 AS (SELECT rid, (xor(z, z >> 30::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM m0),
m2 AS (SELECT rid, (xor(z, z >> 27::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM m1),
mixed AS MATERIALIZED (SELECT rid, xor(z, z >> 31::UHUGEINT) AS z FROM m2),
walk AS (SELECT rid, z, 0::BIGINT AS bucket FROM mixed
  UNION ALL
  SELECT rid, z, floor((bucket + 1) * (2147483648.0::DOUBLE / ((z >> 33::UHUGEINT)::DOUBLE + 1.0)))::BIGINT AS bucket
  FROM (SELECT rid, bucket, (z * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM walk WHERE bucket < 25)),
placed AS (SELECT rid, (max(bucket) FILTER (bucket < 24))::INT AS shard, (max(bucket) FILTER (bucket < 25))::INT AS grown_shard FROM walk GROUP BY rid)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY z >> 1::UHUGEINT, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM d JOIN mixed USING (rid) JOIN placed USING (rid)
"""

#: The stored form built from the text, its features from single samples; the place of the figure follows from the first line.
_OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
r AS (SELECT *, greatest(1, (n_bytes + 191) // 192) AS n_rows FROM d),
p AS (SELECT *, encode(text) || encode(repeat(' ', (n_rows * 192 - n_bytes)::INT)) AS payload FROM r),
m AS MATERIALIZED (SELECT *, encode('P5 192 ' || n_rows || ' 255' || chr(10)) || payload AS media, regexp_extract_all(hex(payload), '..') AS h FROM p),
x AS (SELECT rid, unnest(range(0, len(h))) % 192 // 3 AS band, ('0x' || unnest(h))::BIGINT AS v FROM m),
b AS (SELECT rid, band, sum(v)::BIGINT AS s, sum(v * v)::BIGINT AS q, count(*) AS n FROM x GROUP BY rid, band),
t AS (SELECT rid, sum(s)::BIGINT AS total, sum(q)::BIGINT AS square, sum(n)::BIGINT AS n FROM b GROUP BY rid),
k AS (SELECT rid, sum(CASE WHEN s * 64 > total THEN 1::HUGEINT << (63 - band)::INT ELSE 0 END)::UBIGINT AS bits FROM b JOIN t USING (rid) GROUP BY rid),
f AS (SELECT rid, printf('%.4f %.4f ', total / n, greatest(0.0, square / n - (total / n) * (total / n)))
    || lpad(lower(hex(bits)), 16, '0') AS feature FROM t JOIN k USING (rid))
SELECT doc_id, n_bytes, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_sha256,
  {_crc32("list_transform(h[-16:], lambda x: ('0x' || x)::BIGINT)")} AS tail_crc32, octet_length(media) AS media_bytes, sha256(media) AS media_sha256, feature,
  regexp_matches(list_filter(string_split(text, chr(10)), lambda x: x <> '')[1], '[^\s\x0B\x1C-\x1F\x85\xA0]')::INT AS position, n_bytes || ' bytes' AS caption
FROM m JOIN f USING (rid)
"""

SQL = {
    "op2_chosen_path_neardup": _OP2,
    "op3_jump_hash_shards": _OP3,
    "op5_interleaved_media": _OP5,
    "op8_curriculum_mix": _OP8,
    "op9_spaced_seed_decontamination": _OP9,
}
