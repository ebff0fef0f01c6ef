"""DuckDB SQL for those training-data queries that SQL can express, over the same whole tables."""

from __future__ import annotations

URL = r"""
SELECT page_id, host, path, rule, coalesce(ruling, 'allow') AS verdict
FROM (
  SELECT p.page_id, p.host, p.path, arg_max(r.h || r.p, length(r.h) + length(r.p)) AS rule, arg_max(r.v, length(r.h) + length(r.p)) AS ruling
  FROM (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
    FROM pages
  ) p
  LEFT JOIN (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(v, h, p)
    ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
  GROUP BY p.page_id, p.host, p.path
)
"""

# the checksum's table is made by its rule: eight halvings of each byte
SHARDS = r"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
texts AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT coalesce(text, '') AS x FROM documents)),
sums AS (
  SELECT x, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM texts, crc
),
rows AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS x FROM documents),
laid AS (
  SELECT *, sum(size) OVER (ORDER BY md5(x), doc_id ROWS UNBOUNDED PRECEDING) - size AS before, row_number() OVER (ORDER BY md5(x), doc_id) AS rank, sum(size) OVER () AS total FROM rows
),
dealt AS (SELECT *, ((2 * before + size) * 16 // (2 * total))::INTEGER AS shard FROM laid)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM dealt JOIN sums USING (x)
"""

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(k)
),
turns AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         role = 'assistant' AS trained
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
),
-- a text grows by its backslashes, the # that precede another and its end marks; a role by its colons, too
grown AS (
  SELECT *, list_transform([role, text], lambda x: length(x) + length(x) - length(replace(x, '\', ''))
            + coalesce(list_sum(list_transform(regexp_extract_all(x, '#+'), lambda r: length(r) - 1)), 0)
            + (length(x) - length(replace(x, '</turn>', ''))) // 7) AS long
  FROM turns
),
sized AS (SELECT *, 4 + long[1] + length(role) - length(replace(role, ':', '')) + 2 + long[2] + 8 AS piece FROM grown),
prefix AS (SELECT *, sum(piece) OVER (PARTITION BY conv_id ORDER BY n) AS so_far FROM sized)
SELECT conv_id, max(n_turns)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (trained), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (trained), '')) AS loss_sha256,
       sum(so_far) FILTER (trained OR n = n_turns)::BIGINT AS formatted_chars
FROM prefix GROUP BY conv_id
"""

NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS c FROM documents LEFT JOIN reach ON a = doc_id GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM named LEFT JOIN sizes USING (doc_id)
"""

ORACLE_SQL = {"op1_url_filters": URL, "op2_sharding": SHARDS, "op4_chat_formatting": CHAT, "op6_minhash": NEAR}


def _codes() -> str:
    """Six rounds of assignment and floored means, then codes: one chain of tables."""
    near = lambda k: f"""
near{k} AS MATERIALIZED (
  SELECT v.n, v.p, arg_min(b.e, (d, b.e)) AS e, min(d) AS d
  FROM parts v JOIN book{k} b USING (p), LATERAL (SELECT list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d)
  GROUP BY v.n, v.p
)"""  # noqa: E731
    move = lambda k: f"""
means{k} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT p, e, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM near{k} JOIN parts USING (n, p), (SELECT unnest(range(1, (SELECT len(x) FROM parts LIMIT 1) + 1)) AS i) GROUP BY p, e, i
  ) GROUP BY p, e
),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m USING (p, e))"""  # noqa: E731
    steps = ",".join(near(k) + "," + move(k) for k in range(6)) + "," + near(6)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x,
         row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
parts AS MATERIALIZED (SELECT n, p, list_slice(x, p * len(x) // 8 + 1, (p + 1) * len(x) // 8) AS x FROM kept, (SELECT unnest(range(8)) AS p)),
book0 AS (SELECT p, n - 1 AS e, x FROM parts WHERE n <= 16),{steps},
codes AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near6 GROUP BY n),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (n), books
"""


ORACLE_SQL["op12_vector_codes"] = _codes()

ORACLE_SQL["op11_source_divergence"] = r"""
WITH rows AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
),
said AS (
  SELECT n, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows
),
kept AS (SELECT lang, term FROM said GROUP BY lang, term HAVING count(DISTINCT n) >= 30),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM rows),
counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM said GROUP BY ALL) c USING (lang, source, term)
),
p AS (
  SELECT *, 1 + ((n + 5)::HUGEINT * 1000000000 // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)) AS p FROM counts JOIN size USING (lang)
),
q AS (
  SELECT lang, term, 1 + ((n + 5)::HUGEINT * 1000000000 // (sum(n) OVER (PARTITION BY lang) + 5 * v)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term) JOIN size USING (lang)
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) d
    ON d.lang = a.lang AND d.s = a.source AND d.t = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
"""

ORACLE_SQL["op5_line_dedup"] = r"""
WITH rows AS (SELECT row_number() OVER () AS n, doc_id, text, source FROM documents),
lines AS (
  SELECT n, source, i, l[i] AS line, trim(l[i], ' ' || chr(9) || chr(13)) AS key
  FROM (SELECT n, source, string_split(text, chr(10)) AS l FROM rows WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)
),
wide AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 10),
clean AS (
  SELECT n, count(*) AS n_lines, count(*) FILTER (key IN (FROM wide)) AS gone, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (FROM wide)), '') AS rest,
         bool_or(key <> '' AND key NOT IN (FROM wide)) AS holds
  FROM lines GROUP BY n
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, CASE WHEN holds THEN gone ELSE 0 END::BIGINT AS n_removed, CASE WHEN holds THEN rest ELSE text END AS text
FROM rows LEFT JOIN clean USING (n)
"""
