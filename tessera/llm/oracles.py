"""SQL that says what the operators do, where SQL can say it."""

#: every window of 200 bytes by its MD5, from stretches of 1,000 windows; texts are taken as hexadecimal digits
REPEATS = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, CAST(len(h) // 2 AS BIGINT) AS n FROM d),
c AS (SELECT k, b * 1000 AS base, substr(h, 2000 * b + 1, 2398) AS part FROM n, unnest(range(0, n // 1000 + 1)) t(b)),
w AS (SELECT k, base + j AS i, md5(substr(part, 2 * j + 1, 400)) AS m FROM c, unnest(range(0, least(1000, len(part) // 2 - 199))) t(j)),
r AS (SELECT k, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
e AS (SELECT k, i, CASE WHEN i > lag(i) OVER (PARTITION BY k ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM r),
g AS (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS run FROM e),
s AS (SELECT k, min(i) AS start, max(i) + 200 AS stop FROM g GROUP BY k, run),
p AS (SELECT k, start, coalesce(lag(stop) OVER (PARTITION BY k ORDER BY start), 0) AS before FROM s UNION ALL SELECT n.k, n.n, coalesce((SELECT max(stop) FROM s WHERE s.k = n.k), 0) FROM n),
t AS (SELECT n.k, string_agg(substr(n.h, 2 * p.before + 1, 2 * (p.start - p.before)), '' ORDER BY p.start, p.before) AS kept FROM n JOIN p ON p.k = n.k GROUP BY n.k),
a AS (SELECT k, sum(stop - start) AS gone, count(*) AS spans FROM s GROUP BY k)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(a.gone, 0) AS BIGINT) AS n_removed, coalesce(a.spans, 0) AS n_spans, sha256(unhex(t.kept)) AS kept_sha256 FROM n JOIN t ON t.k = n.k LEFT JOIN a ON a.k = n.k
"""

#: CRC-32 with its table of bytes, made by the rule; then prefix sums in order
SHARDS = r"""
WITH RECURSIVE z AS (SELECT n, n AS c, 0 AS i FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256)) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM z WHERE i < 8),
l AS (SELECT list(c ORDER BY n) AS crc FROM z WHERE i = 8),
b AS (SELECT doc_id, list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)(.)', ' ', 'g'), ' '), lambda x: x) AS unused, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, CAST(len(h) // 2 + 16 AS BIGINT) AS size, CASE WHEN len(h) = 0 THEN [] ELSE list_transform(regexp_extract_all(h, '..'), lambda x: CAST(CAST('0x' || x AS INTEGER) AS BIGINT)) END AS bytes FROM b),
k AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, x: xor(crc[(xor(a, x) & 255) + 1], a >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM d, l),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS r FROM k),
p AS (SELECT *, least((2 * before + size) * 40 // (2 * total), 39) AS s FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(s AS INTEGER) AS shard, r - min(r) OVER (PARTITION BY s) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""

_GROUPS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))

#: SHA-1 in base 32: five hexadecimal digits are four letters
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT page_id, first, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS h FROM p)
SELECT page_id, payload_bytes, {_GROUPS} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id > first THEN first END AS refers_to FROM d
"""

MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w, CAST(source_size * 2 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(w * max(CASE WHEN level * w <= cap THEN level END) OVER (), cap) AS target FROM l),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
 CAST(CAST('0x' || substr(md5('17|' || CAST(d.doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656 AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""

JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gs FROM w),
e AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS g FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c WHERE 100 * shared >= 90 * (na + nb - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT g.doc_id, CAST(len(g.gs) AS BIGINT) AS n_shingles, m.component_id, coalesce(k.n, 0) AS n_links FROM g JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = g.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = g.doc_id
"""
