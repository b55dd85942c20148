"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from gridloom.llm.quality_rules import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t,
         regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid
), c AS (
  SELECT w.rid, doc_id,
         CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS n_stop,
         len(regexp_extract_all(t, '[A-Z]')) AS n_upper
  FROM w LEFT JOIN covered ON covered.rid = w.rid
), b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND n_words <= 200000
       AND word_chars / n_words BETWEEN 2.0 AND 14.0
       AND n_symbols / n_words <= 0.25
       AND NOT (n_words >= 60 AND n_stop / n_words < 0.01)
       AND n_upper / word_chars <= 0.5
       AND NOT (n_lines > 0 AND n_dup_lines / n_lines > 0.3) AS kept
FROM b
"""

CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, t, regexp_replace(t, '<(\\*)\|', '<\\\1|', 'g') AS e FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(e) + 11) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

# 40 hexadecimal digits are eight groups of five, and each makes four base-32 digits
WARC_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS sha, max(page_id) OVER (PARTITION BY sha1(h)) AS last FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((('0x' || substr(sha, CAST(i // 4 * 5 + 1 AS INT), 5))::INT >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, source_size * 2.0::DOUBLE AS top, source_size * 2.0::DOUBLE / w AS full_at,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s
), c AS (
  SELECT *, (SELECT level FROM l WHERE level < full_at ORDER BY full_at, source NULLS LAST LIMIT 1) AS common FROM l
), t AS (
  SELECT source, source_size, CASE WHEN common IS NULL THEN top ELSE least(top, common * w) END AS target FROM c
), e AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         (('0x' || substr(h, 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, floor(rate) AS whole, (u / (1 - u)) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) AS q FROM e
), k AS (
  SELECT *, CASE WHEN rate > whole AND size > 0 THEN CAST(floor(q / (1 + q) * 1099511627776.0::DOUBLE) AS BIGINT) END AS k,
         target - sum(whole * size) OVER (PARTITION BY source) AS want
  FROM q
), m AS (
  SELECT *, k IS NOT NULL AND sum(CASE WHEN k IS NULL THEN 0 ELSE size END)
            OVER (PARTITION BY source ORDER BY k NULLS LAST, h ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE <= want AS more
  FROM k
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN (whole + CASE WHEN more THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken
FROM m
"""

# the pages link within their own host only, so trust and distrust stay where the rules
# put them: each host's share of the allowed and of the blocked pages
URL_SQL = r"""
WITH u AS (
  SELECT page_id, html, position('://' IN url) AS pos, substr(url, position('://' IN url) + 3) AS rest FROM pages
), p AS (
  SELECT page_id, html,
         CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN pos > 0 THEN regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u
), r(rule, h, pre, verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'allow'),
         ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), j AS (
  SELECT p.*, (SELECT struct_pack(rule := rule, verdict := verdict) FROM r
               WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) ORDER BY length(rule) DESC LIMIT 1) AS b
  FROM p
), seeds AS (
  SELECT host, count(*) FILTER (WHERE b.verdict = 'allow') AS good, count(*) FILTER (WHERE b.verdict = 'block') AS bad FROM j WHERE b IS NOT NULL GROUP BY host
), v AS (
  SELECT host, bad / greatest(sum(bad) OVER (), 1) > good / greatest(sum(good) OVER (), 1) AS worse FROM seeds
)
SELECT page_id, j.host, path, b.rule AS rule, coalesce(b.verdict, CASE WHEN worse THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN v ON j.host = v.host
"""

_NORMAL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: A step of CRC-32 over eight bits, by its polynomial; the table of all bytes comes of it.
_BITS = "c"
for _ in range(8):
    _BITS = f"list_transform({_BITS}, lambda x: xor(x >> 1, (x & 1) * 3988292384))"

RESAMPLING_SQL = rf"""
WITH t AS (
  SELECT {_BITS} AS step FROM (SELECT range(256) AS c)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_NORMAL} AS w FROM documents
), f AS (
  SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d
), g AS (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
  FROM (SELECT {_NORMAL} AS w FROM benchmark)
), known AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM f UNION SELECT f FROM g)
), b AS (
  SELECT f, xor(4294967295, list_reduce(
           list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
           lambda a, x: xor(step[(xor(a, x) & 255) + 1], a >> 8))) % 10000 AS bucket
  FROM known, t
), s AS (
  SELECT bucket, count(*) AS s FROM f JOIN b USING (f) GROUP BY bucket
), u AS (
  SELECT bucket, count(*) AS t FROM g JOIN b USING (f) GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
                                      / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM u) + 10000)))) AS BIGINT) AS gain
  FROM s FULL JOIN u USING (bucket)
), per AS (
  SELECT rid, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM f JOIN b USING (f) JOIN gain USING (bucket) GROUP BY rid
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                           / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN per USING (rid)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place,
         count(*) OVER (PARTITION BY n_words >= 20) AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""

LEAKS_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_NORMAL} AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least(len(w), 10) AS n FROM (SELECT item_id, {_NORMAL} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT n, item, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), grams AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)
), found AS (
  SELECT rid, i, n, item FROM grams JOIN windows USING (n, g)
), hits AS (
  SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""


def _assigned(centroids: str) -> str:
    """Each vector's nearest centroid and the square of its distance."""
    square = "CAST(list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS BIGINT)"
    return f"""SELECT rid, vec_id, any_value(v) AS v, min(s).d AS distance, min(s).j AS j
  FROM (SELECT p.rid, p.vec_id, p.v, {{'d': {square}, 'j': c.j}} AS s FROM p, {centroids} c) GROUP BY rid, vec_id"""


def _moved(assigned: str, before: str) -> str:
    return f"""SELECT b.j, coalesce(m.v, b.v) AS v FROM {before} b LEFT JOIN (
    SELECT j, list(x ORDER BY i) AS v FROM (
      SELECT j, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM (SELECT j, v, unnest(range(1, 65)) AS i FROM {assigned}) GROUP BY j, i) GROUP BY j
  ) m ON m.j = b.j"""


_ROUNDS = ", ".join(f"a{r} AS MATERIALIZED ({_assigned(f'c{r}')})" + (f", c{r + 1} AS MATERIALIZED ({_moved(f'a{r}', f'c{r}')})" if r < 3 else "") for r in range(4))

KMEANS_SQL = rf"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS j, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM p ORDER BY h, v LIMIT 16)
), {_ROUNDS}
SELECT vec_id, a3.j AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a3.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON a3.j = c3.j
"""
