"""DuckDB SQL for the queries that SQL can express."""

_BENCH_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
_WORDS = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_BENCH_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)
),
hit AS (SELECT dw.rid, dw.i, dw.n, dw.p, bw.item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n),
words_hit AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS j FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY rid),
placed AS (SELECT p, t, min(place) AS place FROM (SELECT p, unnest(string_split(p, ' ')) AS t, unnest(generate_series(0, n - 1)) AS place FROM (SELECT DISTINCT p, n FROM bw)) GROUP BY p, t),
each_word AS (SELECT rid, unnest(w) AS t, unnest(generate_series(0, len(w) - 1)) AS pos FROM d WHERE len(w) > 0),
post AS (SELECT * FROM each_word SEMI JOIN placed USING (t)),
often AS (SELECT t, count(*) AS n FROM post GROUP BY t),
ranked AS (SELECT p, t, place, row_number() OVER (PARTITION BY p ORDER BY coalesce(n, 0), t) AS r, min(coalesce(n, 0)) OVER (PARTITION BY p) AS least FROM placed LEFT JOIN often USING (t)),
anchor AS (SELECT p, t, place, r, max(r) OVER (PARTITION BY p) AS ranks FROM ranked WHERE r <= 3 AND least > 0),
first_place AS (SELECT rid, p, ranks, pos - place AS start FROM anchor JOIN post USING (t) WHERE r = 1),
others AS (
  SELECT f.rid, f.p, f.start, count(DISTINCT a.r) AS n FROM first_place f JOIN anchor a ON a.p = f.p AND a.r > 1 JOIN post q ON q.rid = f.rid AND q.t = a.t AND abs(q.pos - a.place - f.start) <= 2
  GROUP BY ALL
),
near AS (
  SELECT f.rid, count(*) AS n_near FROM first_place f LEFT JOIN others o ON o.rid = f.rid AND o.p = f.p AND o.start = f.start
  ANTI JOIN hit ON hit.rid = f.rid AND hit.i = f.start + 1 AND hit.p = f.p
  WHERE coalesce(o.n, 0) = f.ranks - 1 GROUP BY f.rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN words_hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN near USING (rid)
"""

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS p FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT p FROM win GROUP BY p HAVING count(*) > 1),
gone AS (SELECT rid, list(DISTINCT j) AS js FROM (SELECT rid, unnest(generate_series(i, i + 34)) AS j FROM win JOIN again USING (p)) GROUP BY rid),
word AS (SELECT rid, unnest(w) AS t, unnest(generate_series(1, len(w))) AS j FROM d),
lost AS (SELECT rid, unnest(js) AS j FROM gone),
kept AS (SELECT word.rid, string_agg(t, ' ' ORDER BY j) AS s, count(*) AS n FROM word ANTI JOIN lost ON word.rid = lost.rid AND word.j = lost.j GROUP BY word.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

OP4 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
s AS (SELECT DISTINCT rid, doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pair AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.rid < b.rid GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT rid, rid AS to_rid FROM d UNION SELECT reach.rid, both_ways.y FROM reach JOIN both_ways ON reach.to_rid = both_ways.x),
comp AS (SELECT reach.rid, min(t.doc_id) AS component_id FROM reach JOIN d t ON t.rid = reach.to_rid GROUP BY reach.rid)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept FROM d LEFT JOIN n USING (rid) JOIN comp USING (rid)
"""

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS p FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT rid, p FROM win GROUP BY rid, p HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS j FROM win JOIN again USING (rid, p)) GROUP BY rid),
cut AS (SELECT rid, string_split(text, chr(10)) AS parts FROM d),
each_line AS (SELECT rid, unnest(parts) AS line, unnest(generate_series(1, len(parts))) AS place FROM cut),
split AS (SELECT rid, line, place, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM each_line),
worded AS (SELECT *, len(w)::BIGINT AS n, row_number() OVER (PARTITION BY rid, line ORDER BY place) > 1 AS repeated FROM split WHERE len(w) > 0),
judged AS (
  SELECT *, CASE
      WHEN (line LIKE '%|%' OR n > 2) AND len(list_filter(w, lambda x: list_contains(['|', '/', '>', '»', '›', '·', '•', '::', '-', '–', '—'], x))) > 0
           AND len(list_filter(w, lambda x: list_contains(['|', '/', '>', '»', '›', '·', '•', '::', '-', '–', '—'], x))) >= 0.2 * n THEN true
      WHEN len(regexp_extract_all(line, '[#*$%&|<>]')) > 0.3 * n THEN true
      WHEN len(list_filter(w, lambda x: regexp_matches(x, '[!?]{{2,}}$'))) > 0.3 * n AND regexp_matches(line, '!!|[?]!|[?][?]') THEN true
      WHEN n <= 40 AND regexp_matches(lower(line), 'lorem ipsum|all rights reserved|terms of use|terms of service|privacy policy|cookie policy|enable javascript|click here|sign up for|log in to') THEN true
      WHEN n >= 8 AND NOT list_contains(['.', '!', '?', ':', ';', '…', '。', '！', '？', '"', chr(39), '”', '’', '»', ')', ']'], right(w[-1], 1)) THEN true
      ELSE false END AS faulty,
    list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars
  FROM worded
),
docs AS (
  SELECT rid, sum(repeated::INT)::BIGINT AS n_dup_lines, sum((repeated OR faulty)::INT)::BIGINT AS n_lines_removed, sum(chars)::BIGINT AS word_chars,
         coalesce(sum(chars) FILTER (WHERE NOT (repeated OR faulty)), 0)::BIGINT AS kept_chars
  FROM judged GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
       coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(kept_chars, 0)::BIGINT AS kept_chars,
       len(w) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(w) AS base_failed,
       NOT (len(w) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(w)) AND coalesce(word_chars, 0) - coalesce(kept_chars, 0) <= 0.5 * coalesce(word_chars, 0) AS kept
FROM d LEFT JOIN covered USING (rid) LEFT JOIN docs USING (rid)
"""

OP5 = """
WITH RECURSIVE step AS (SELECT i AS c, 0 AS k, i AS v FROM range(256) AS t(i) UNION ALL SELECT c, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY c) AS tab FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
draw AS (SELECT rid, j, ('0x' || substr(md5(doc_id::VARCHAR || '/' || j), 1, 13))::BIGINT AS u FROM d, range(17) AS s(j)),
best AS (SELECT rid, arg_max(j, u) FILTER (WHERE j < 16) AS shard, arg_max(j, u) AS grown_shard FROM draw GROUP BY rid),
sums AS (
  SELECT rid, xor(list_reduce(list_transform(range(strlen(text)), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM (SELECT rid, text, hex(encode(text)) AS h FROM d), crc
)
SELECT doc_id, strlen(text)::BIGINT + 1 AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id::VARCHAR || '/' || text_crc32 || '/slot'), 1, 8))::BIGINT, doc_id, strlen(text), text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM d JOIN best USING (rid) JOIN sums USING (rid)
"""

OP7 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
b AS (SELECT h, list_aggregate(list_transform(range(40), lambda i: lpad(bin(('0x' || substr(h, (i + 1)::INT, 1))::INT), 4, '0')), 'string_agg', '') AS bits FROM m)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(5), lambda j: (substr(bits, (5 * i + j + 1)::INT, 1) = '1')::INT * (16 >> j::INT))))::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, NULL::VARCHAR AS fault
FROM p JOIN m USING (h) JOIN b USING (h)
"""

ORACLES: dict[str, str] = {
    "op1_positional_index": OP1,
    "op2_super_kmers": OP2,
    "op3_quality_rules": OP3,
    "op4_chosen_path": OP4,
    "op5_rendezvous_shards": OP5,
    "op7_warc_round_trip": OP7,
}
