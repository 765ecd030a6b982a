"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op5_benchmark_decontamination"] = r"""
WITH lowered_docs AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), lowered_items AS (
  SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM benchmark
), d AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered_docs
), b AS (
  SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered_items
), grams AS MATERIALIZED (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM d, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)
), hits AS MATERIALIZED (
  SELECT DISTINCT p.doc_id, p.i, p.n, g.item_id FROM places p JOIN grams g ON p.n = g.n AND p.run = g.run
), words_hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS place FROM hits) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""

ORACLES["op10_substring_dedup"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS run
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)
), numbered AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM windows
), gone AS (
  SELECT DISTINCT doc_id, place
  FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS place FROM numbered WHERE nth > 1)
), words AS (
  SELECT doc_id, place, w[place] AS word
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS place FROM d WHERE len(w) > 0)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS t
  FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op4_warc_derivatives"] = r"""
WITH responses AS (
  SELECT page_id, url, coalesce(html, '') AS payload,
         concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10),
                'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR)) AS headers
  FROM pages
), bare AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(payload,
      '(?s)<!--.*?(?:-->|\z)', '', 'g'),
      '(?is)<script[ \t\r\n/>].*?(?:</script[ \t\r\n]*>|\z)', '', 'g'),
      '(?is)<style[ \t\r\n/>].*?(?:</style[ \t\r\n]*>|\z)', '', 'g') AS t
  FROM responses
), untagged AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\n]+', ' ', 'g'),
      '(?i)</?(?:p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|th|table|title|article|section|nav|header|footer|blockquote|pre|hr|form)(?:[ \t\r\n/][^>]*)?>',
      chr(10), 'g'), '</?[A-Za-z!?][^>]*>', '', 'g') AS u
  FROM bare
), decoded AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(u, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
      '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS v
  FROM untagged
), texts AS (
  SELECT *, trim(regexp_replace(regexp_replace(v, '[ \t\r\x0B\x0C]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), concat(chr(10), ' ')) AS text,
         md5(concat_ws('|', 'response', CAST(page_id AS VARCHAR), url)) AS r
  FROM decoded
), named AS (
  SELECT *, concat('<urn:uuid:', r[1:8], '-', r[9:12], '-', r[13:16], '-', r[17:20], '-', r[21:32], '>') AS refers_to,
         concat('sha256:', sha256(concat(headers, chr(13), chr(10), chr(13), chr(10), payload))) AS source_block_digest,
         concat('sha256:', sha256(payload)) AS source_payload_digest
  FROM texts
), ids AS (
  SELECT *, md5(concat('conversion|', refers_to)) AS c, md5(concat('metadata|', refers_to)) AS m FROM named
), linked AS (
  SELECT *, concat('<urn:uuid:', c[1:8], '-', c[9:12], '-', c[13:16], '-', c[17:20], '-', c[21:32], '>') AS conversion_id,
         concat('<urn:uuid:', m[1:8], '-', m[9:12], '-', m[13:16], '-', m[17:20], '-', m[21:32], '>') AS metadata_id
  FROM ids
), records AS (
  SELECT *, metadata_id AS record_id, 'metadata' AS warc_type, CAST(NULL AS VARCHAR) AS concurrent_to,
         'application/warc-fields' AS content_type,
         concat('conversion: ', conversion_id, chr(13), chr(10), 'sourcePayloadDigest: ', source_payload_digest,
                chr(13), chr(10), 'textLength: ', CAST(length(text) AS VARCHAR), chr(13), chr(10)) AS block
  FROM linked
  UNION ALL
  SELECT *, conversion_id, 'conversion', metadata_id, 'text/plain; charset=utf-8', text FROM linked
)
SELECT page_id, record_id, warc_type, refers_to, concurrent_to, url AS target_uri, content_type,
       CAST(strlen(block) AS BIGINT) AS content_length, concat('sha256:', sha256(block)) AS block_digest,
       headers AS source_headers, source_block_digest, source_payload_digest
FROM records
"""


def _url_levels() -> str:
    """The three levels of the tree, each from the one above."""
    text = ""
    for k in (1, 2, 3):
        above = f"level{k - 1}"
        text += f"""
), wide{k} AS (
  SELECT host, template, count(*) AS n_values, sum(n) AS n
  FROM (SELECT host, template, s{k}, sum(pages) AS n FROM {above} WHERE s{k} IS NOT NULL GROUP BY ALL) GROUP BY ALL
), branches{k} AS (
  SELECT a.*, concat(a.template, CASE WHEN s{k} IS NULL THEN '' WHEN n_values > 20 AND n < 3 * n_values THEN '/*'
                                      ELSE concat('/', s{k}) END) AS branch
  FROM {above} a LEFT JOIN wide{k} w ON a.host = w.host AND a.template = w.template
), sums{k} AS (
  SELECT host, template, branch, purity, sum(labelled) AS n, sum(blocked) AS b FROM branches{k} GROUP BY ALL
), tested{k} AS (
  SELECT *, n = 0 OR abs(b - n * purity) <= 2.0::DOUBLE * sqrt(n * purity * (1.0::DOUBLE - purity)) AS alike FROM sums{k}
), pooled{k} AS (
  SELECT host, template, sum(n) AS n_alike, sum(b) AS b_alike FROM tested{k} WHERE alike GROUP BY ALL
), judged{k} AS (
  SELECT t.host, t.template, branch,
         (CASE WHEN alike THEN b_alike ELSE b END + 4.0::DOUBLE * purity)
           / (CASE WHEN alike THEN n_alike ELSE n END + 4.0::DOUBLE) AS below
  FROM tested{k} t LEFT JOIN pooled{k} p ON t.host = p.host AND t.template = p.template
), level{k} AS MATERIALIZED (
  SELECT b.host, s1, s2, s3, pages, labelled, blocked, b.branch AS template, below AS purity
  FROM branches{k} b JOIN judged{k} j ON b.host = j.host AND b.template = j.template AND b.branch = j.branch"""
    return text


ORACLES["op2_url_templates"] = (
    r"""
WITH rests AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fitting AS (
  SELECT page_id, concat(rule_host, rule_path) AS rule, rule_verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, concat('.', rule_host))) AND starts_with(path, rule_path)
), ruled AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS by_rule
  FROM fitting GROUP BY page_id
), cut AS (
  SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM parts LEFT JOIN ruled USING (page_id)
), paged AS MATERIALIZED (
  SELECT page_id, host, path, rule, by_rule, regexp_replace(p[1], '[0-9]+', '{n}', 'g') AS s1,
         regexp_replace(p[2], '[0-9]+', '{n}', 'g') AS s2, regexp_replace(p[3], '[0-9]+', '{n}', 'g') AS s3,
         CASE by_rule WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS label
  FROM cut
), shapes AS MATERIALIZED (
  SELECT host, s1, s2, s3, count(*) AS pages, count(label) AS labelled, coalesce(sum(label), 0) AS blocked
  FROM paged GROUP BY ALL
), overall AS (
  SELECT CASE WHEN sum(labelled) > 0 THEN CAST(sum(blocked) AS DOUBLE) / sum(labelled) ELSE 0 END AS q FROM shapes
), hosts AS (
  SELECT host, (sum(blocked) + 4.0::DOUBLE * any_value(q)) / (sum(labelled) + 4.0::DOUBLE) AS purity
  FROM shapes, overall GROUP BY host
), level0 AS (
  SELECT shapes.*, '' AS template, purity FROM shapes JOIN hosts USING (host)"""
    + _url_levels()
    + """
)
SELECT page_id, paged.host, path, rule, template, round(purity, 6) AS purity,
       coalesce(by_rule, CASE WHEN purity >= 0.8::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM paged LEFT JOIN level3 l ON paged.host = l.host AND paged.s1 IS NOT DISTINCT FROM l.s1
  AND paged.s2 IS NOT DISTINCT FROM l.s2 AND paged.s3 IS NOT DISTINCT FROM l.s3
"""
)

ORACLES["op7_quality_rules"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lined AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS filled FROM d
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS run
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS place FROM repeated) GROUP BY doc_id
), crc AS MATERIALIZED (
  SELECT list(c ORDER BY n) AS crc_table
  FROM (SELECT n, list_reduce(list_concat([n], range(0, 8)), lambda c, k:
          CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(0, 256)) AS n))
), words AS MATERIALIZED (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d
), spelled AS (
  SELECT word, list_transform(range(0, strlen(word)), lambda i: CAST(concat('0x', substr(hex(encode(word)), 2 * i + 1, 2)) AS BIGINT)) AS b
  FROM (SELECT DISTINCT word FROM words)
), buckets AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])),
                   4294967295) % 16384 AS bucket
  FROM spelled, crc
), placed AS MATERIALIZED (
  SELECT doc_id, bucket, lead(bucket) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM words JOIN buckets USING (word)
), grams AS MATERIALIZED (
  SELECT doc_id, 1 AS n_order, bucket FROM placed
  UNION ALL SELECT doc_id, 2, (31 * bucket + following) % 16384 FROM placed WHERE following IS NOT NULL
), raw AS (
  SELECT n_order, bucket, count(*) AS r FROM grams GROUP BY ALL
), trusted AS (
  SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0
), target AS (
  SELECT n_order, bucket, count(*) AS t FROM grams JOIN trusted USING (doc_id) GROUP BY ALL
), totals AS (
  SELECT n_order, sum(r)::DOUBLE AS all_r, coalesce(sum(t), 0)::DOUBLE AS all_t
  FROM raw LEFT JOIN target USING (n_order, bucket) GROUP BY n_order
), weights AS MATERIALIZED (
  SELECT n_order, bucket,
         CAST(round(ln((coalesce(t, 0) + 4.0::DOUBLE) / (r * (all_t / all_r) + 4.0::DOUBLE)) * 10000) AS BIGINT) AS weight
  FROM raw LEFT JOIN target USING (n_order, bucket) JOIN totals USING (n_order)
), by_order AS (
  SELECT doc_id, n_order, CAST(sum(weight) AS BIGINT) AS units, count(*) AS n
  FROM grams JOIN weights USING (n_order, bucket) GROUP BY ALL
), sums AS (
  SELECT doc_id, CAST(sum(units) AS BIGINT) AS ratio_units, CAST(sum(n) AS BIGINT) AS n_grams,
         CAST(floor(sum(units::DOUBLE / n::DOUBLE)) AS BIGINT) AS mean_units
  FROM by_order GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(ratio_units, 0) AS ratio_units,
         coalesce(n_grams, 0) AS n_grams, coalesce(mean_units, 0) AS mean_units
  FROM d JOIN lined USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN sums USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND mean_units >= -2400 AS kept
FROM counted
"""

ORACLES["op13_block_neighbours"] = r"""
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, q.e AS own, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND (q.vec_id <> c.vec_id OR q.e <> c.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT query_id, vec_id, score,
             row_number() OVER (PARTITION BY query_id, own ORDER BY round(score, 12) DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

ORACLES["op12_prefix_trie"] = r"""
WITH crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY n) AS crc_table
  FROM (SELECT n, list_reduce(list_concat([n], range(0, 8)), lambda c, k:
          CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(0, 256)) AS n))
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
), own AS MATERIALIZED (
  SELECT conv_id, list({'id': id, 'b': b} ORDER BY turn NULLS FIRST, id) AS own,
         CAST(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
                lambda c, d: xor(c >> 8, any_value(crc_table)[(xor(c, d) & 255) + 1])), 4294967295) % 9 AS BIGINT) AS h
  FROM (SELECT conv_id, turn, md5(concat(CAST(strlen(r) AS VARCHAR), ':', r, x)) AS id, strlen(x) AS b FROM turns), crc_table
  GROUP BY conv_id
), built AS (
  SELECT c.conv_id, list_concat(coalesce(p.own[1:c.h], []), c.own[c.h + 1:]) AS s
  FROM own c LEFT JOIN own p ON p.conv_id = c.conv_id - c.conv_id % 5
), places AS (
  SELECT conv_id, len(s) AS whole, d, array_to_string(list_transform(s[1:d], lambda t: t.id), '') AS prefix, coalesce(s[d].b, 0) AS b
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built)
), nodes AS MATERIALIZED (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = whole) AS ends
  FROM places GROUP BY d, prefix
), children AS (
  SELECT d - 1 AS d, left(prefix, CAST(32 * (d - 1) AS BIGINT)) AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), counted AS MATERIALIZED (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (d, prefix)
), subtrees AS (
  SELECT k AS d, left(prefix, CAST(32 * k AS BIGINT)) AS prefix,
         count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * b) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM counted) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
       sha256(coalesce(n.ends, '')) AS ends_sha256
FROM counted n JOIN subtrees s USING (d, prefix)
  LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = left(n.prefix, CAST(32 * (n.d - 1) AS BIGINT))
"""

ORACLES["op11_ranked_search"] = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), asked AS MATERIALIZED (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0
), wanted AS (
  SELECT item, term, count(*) AS times FROM (SELECT item, unnest(t) AS term FROM asked) GROUP BY item, term
), counted AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM wanted) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counted, totals GROUP BY term
), lengths AS (
  SELECT r, doc_id, 75 + (25 * len(t) * n_docs) // n_terms AS m FROM d, totals
), scored AS (
  SELECT item, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (r) GROUP BY item, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
  JOIN asked USING (item)
WHERE rank <= 20
"""
