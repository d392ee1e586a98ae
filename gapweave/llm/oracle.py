"""DuckDB SQL for the queries that SQL can express."""

ORACLE = {}

# Measures and verdicts of the rules; the order of the cascade does not change them.
ORACLE["op4_rules"] = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS p FROM texts),
windows AS (
  SELECT r, p, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY r ORDER BY p)
),
twice AS (SELECT r, a, b, c FROM windows WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT r, count(DISTINCT q) AS n FROM (
    SELECT windows.r, unnest([p, p + 1, p + 2]) AS q FROM windows JOIN twice USING (r, a, b, c)
  ) GROUP BY r
),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
),
counts AS (
  SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars,
    count(*) FILTER (regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]')) AS n_lettered
  FROM words GROUP BY r
),
measured AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_lettered, 0) AS n_lettered,
    strlen(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, strlen(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters
  FROM texts LEFT JOIN counts USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_lettered < 8 * n_words OR 2 * n_upper > n_letters) AS kept
FROM measured
"""

# Revisit records refer to the smallest page among those with the same payload of at least 100 bytes.
ORACLE["op6_archive"] = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
seen AS (SELECT *, strlen(payload) AS n, min(page_id) OVER (PARTITION BY payload) AS first_id FROM payloads)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM seen
"""

# Tree by tree, then over the sources. crc is the CRC-32 of the decimal doc_id: a step per bit (-1) after each byte.
ORACLE["op11_manifest"] = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, *, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, 3988292384 * (s & 1)) END) AS crc
  FROM documents
),
leaves AS (
  SELECT r, doc_id, source, xor(crc, 4294967295) % 2 = 0 AS tampered,
    list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')) AS f,
    list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, replace(text, chr(10), '')], lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')) AS g
  FROM docs
),
placed AS (
  SELECT r, doc_id, source, sha256(array_to_string(f, '')) AS leaf,
    CASE WHEN tampered THEN sha256(array_to_string(g, '')) ELSE sha256(array_to_string(f, '')) END AS presented,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(array_to_string(f, ''))) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n
  FROM leaves
),
nodes AS (
  SELECT 0 AS level, source, i, n, leaf AS digest FROM placed
  UNION ALL
  SELECT level + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, source, i // 3, (n + 2) // 3
),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
),
tops AS (
  SELECT 0 AS level, i, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 3, (n + 2) // 3
),
inner_sides AS (
  SELECT a.level, a.source, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM nodes a JOIN nodes b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.i // 3 = b.i // 3 AND a.n > 1 GROUP BY 1, 2, 3
),
outer_sides AS (
  SELECT a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM tops a JOIN tops b ON a.level = b.level AND a.i // 3 = b.i // 3 AND a.n > 1 GROUP BY 1, 2
),
sides AS (
  SELECT p.r, s.level, s.before, s.after FROM placed p JOIN inner_sides s ON p.source IS NOT DISTINCT FROM s.source AND p.i // (3 ** s.level)::BIGINT = s.i
  UNION ALL
  SELECT p.r, 100 + s.level, s.before, s.after FROM placed p JOIN subroots t ON p.source IS NOT DISTINCT FROM t.source
  JOIN outer_sides s ON t.i // (3 ** s.level)::BIGINT = s.i
),
proofs AS (
  SELECT p.r, p.presented, coalesce(string_agg(before || after, '' ORDER BY level), '') AS proof,
    list(before || '|' || after ORDER BY level) FILTER (before IS NOT NULL) AS path
  FROM placed p LEFT JOIN sides USING (r) GROUP BY 1, 2
),
folded AS (
  SELECT r, proof, list_reduce(list_concat([presented], coalesce(path, [])),
    lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root FROM proofs
)
SELECT p.doc_id, p.leaf, t.subroot, o.digest AS root, sha256(f.proof) AS proof_sha256, f.folded_root, f.folded_root = o.digest AS verified
FROM placed p JOIN subroots t ON p.source IS NOT DISTINCT FROM t.source JOIN folded f USING (r) JOIN tops o ON o.n = 1
"""
