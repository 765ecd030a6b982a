"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from collections.abc import Iterable

from critiq import fixed_values as fixed
from critiq.functions import speech as S
from critiq.functions import text as T
from critiq.operators.sentiment import UNITS
from critiq.plans import parameters as P

ORACLES: dict[str, str] = {}


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: Iterable[str]) -> str:
    return ", ".join(_quote(value) for value in values)


# --- Text --------------------------------------------------------------------

# Spelled out here and not taken from the functions, so that a wrong pattern there shows up.
_BLANKS = r"\t-\r\x1c-\x20\x{85}\p{Z}"
_NO_URLS = f"regexp_replace(lower(text), 'http[^{_BLANKS}]+|www[^{_BLANKS}]+', '', 'g')"
_NO_PUNCTUATION = rf"regexp_replace({_NO_URLS}, '[^\p{{L}}\p{{N}}_{_BLANKS}]', '', 'g')"


def _squeezed(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '[{_BLANKS}]+', ' ', 'g'))"


_CLEANED = _squeezed(_NO_PUNCTUATION)
_NO_DIGITS = rf"regexp_replace({_NO_PUNCTUATION}, '\p{{Nd}}+', '', 'g')"
_SPLIT_CONTRACTIONS = "CASE w " + " ".join(
    f"WHEN {_quote(whole)} THEN [{_list(halves)}]" for whole, halves in fixed.CONTRACTIONS.items()
) + " ELSE [w] END"
_CONTENT_TOKENS = (
    f"[t FOR t IN flatten([{_SPLIT_CONTRACTIONS} FOR w IN string_split({_squeezed(_NO_DIGITS)}, ' ')"
    f" IF w <> '']) IF t NOT IN ({_list(P.STOP_WORDS)})]"
)

ORACLES["clean_review_text"] = f"SELECT doc_id, {_CLEANED} AS cleaned_text FROM documents"
ORACLES["clean_text"] = (
    f"SELECT doc_id, array_to_string({_CONTENT_TOKENS}, ' ') AS cleaned_text FROM documents"
)
_LEMMATISED = f"""
WITH lemmas AS (
  SELECT DISTINCT token, left(token, length(token) - 1) AS lemma
  FROM (SELECT unnest(string_split({_CLEANED}, ' ')) AS token FROM benchmark) WHERE token LIKE '__%s'),
words AS (
  SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS place
  FROM (SELECT doc_id, {_CONTENT_TOKENS} AS ws FROM documents)),
texts AS (
  SELECT doc_id, string_agg(coalesce(lemma, token), ' ' ORDER BY place) AS cleaned_text
  FROM words LEFT JOIN lemmas USING (token) GROUP BY doc_id)
SELECT doc_id, coalesce(cleaned_text, '') AS cleaned_text FROM documents LEFT JOIN texts USING (doc_id)"""
ORACLES["clean_text_lemmas"] = _LEMMATISED
ORACLES["clean_text_lemmas_joined"] = _LEMMATISED


def _found(text: str, pattern: str) -> str:
    return f"regexp_matches(lower({text}), {_quote(pattern)})"


def _flags(text: str, vocabulary: S.SpeechVocabulary) -> str:
    sarcasm = " OR ".join(f"contains(lower({text}), {_quote(w)})" for w in vocabulary.sarcasm)
    return f"""({sarcasm}) AS is_sarcastic,
      {_found(text, S.exaggeration_pattern(vocabulary))} AS is_exaggerated,
      {_found(text, T.whole_words(vocabulary.personal))} AS is_personal,
      {_found(text, T.whole_words(vocabulary.recommendation))} AS is_recommendation"""


_LEXICON_ROWS = ", ".join(
    f"({_quote(word)}, {round(score * UNITS)})" for word, score in P.LEXICON.items()
)
_ANALYSED = f"""
WITH cleaned AS (SELECT doc_id, n_chars, {_CLEANED} AS cleaned_text FROM documents),
words AS (
  SELECT doc_id, w FROM (SELECT doc_id, unnest(string_split(cleaned_text, ' ')) AS w FROM cleaned)
  WHERE w <> ''),
lexicon(w, units) AS (VALUES {_LEXICON_ROWS}),
tally AS (
  SELECT doc_id, sum(units) AS units, count(units) AS hits, count(*) AS n_words,
    count(*) FILTER (units > 0) AS positive, count(*) FILTER (units < 0) AS negative
  FROM words LEFT JOIN lexicon USING (w) GROUP BY doc_id),
scored AS (
  SELECT c.doc_id, n_chars, cleaned_text, coalesce(n_words, 0) AS n_words,
    coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative,
    coalesce(units, 0) / {UNITS}::DOUBLE AS total,
    CASE WHEN hits > 0 THEN units / ({UNITS}::DOUBLE * hits) ELSE 0::DOUBLE END AS polarity
  FROM cleaned c LEFT JOIN tally USING (doc_id)),
flagged AS (
  SELECT *, abs(polarity) AS intensity, abs(polarity) > 0.7::DOUBLE AS is_emotional,
      {_flags('cleaned_text', P.VOCABULARY)}
  FROM scored),
analysed AS (
  SELECT *, abs(polarity) > 0.8::DOUBLE OR (is_sarcastic AND is_exaggerated) OR is_emotional AS is_anomaly
  FROM flagged),
typed AS (
  SELECT *, CASE WHEN polarity > 0 THEN 'Positive' ELSE 'Negative' END AS sentiment,
    CASE WHEN abs(polarity) > 0.5::DOUBLE THEN 'High' ELSE 'Low' END AS band,
    [t.name FOR t IN [
       {{'name': 'Emotional', 'yes': is_emotional}}, {{'name': 'Sarcastic', 'yes': is_sarcastic}},
       {{'name': 'Exaggerated', 'yes': is_exaggerated}}, {{'name': 'Personal', 'yes': is_personal}},
       {{'name': 'Recommendation', 'yes': is_recommendation}}] IF t.yes] AS types
  FROM analysed)
"""


def _share(count: str) -> str:
    return f"CASE WHEN n_words > 0 THEN ({count}) / n_words::DOUBLE ELSE 0 END"


ORACLES["lexicon_sentiment"] = f"""{_ANALYSED}
SELECT doc_id, polarity, {_share('negative')} AS neg,
  {_share('n_words - negative - positive')} AS neu, {_share('positive')} AS pos,
  total / sqrt(total * total + 15) AS compound
FROM scored"""
ORACLES["lexicon_sentiment_large"] = f"""
WITH cleaned AS (SELECT doc_id, {_CLEANED} AS cleaned_text FROM documents),
lexicon AS (
  SELECT DISTINCT w, (length(w) % 9 - 4) * 1250 AS units
  FROM (SELECT unnest(string_split({_CLEANED}, ' ')) AS w FROM benchmark) WHERE w <> ''),
words AS (
  SELECT doc_id, w FROM (SELECT doc_id, unnest(string_split(cleaned_text, ' ')) AS w FROM cleaned) WHERE w <> ''),
tally AS (
  SELECT doc_id, sum(units) AS units, count(units) AS hits, count(*) AS n_words,
    count(*) FILTER (units > 0) AS positive, count(*) FILTER (units < 0) AS negative
  FROM words LEFT JOIN lexicon USING (w) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(positive, 0) AS positive,
    coalesce(negative, 0) AS negative, coalesce(units, 0) / 10000::DOUBLE AS total,
    CASE WHEN hits > 0 THEN units / (10000::DOUBLE * hits) ELSE 0::DOUBLE END AS polarity
  FROM cleaned LEFT JOIN tally USING (doc_id))
SELECT doc_id, polarity, {_share('negative')} AS neg,
  {_share('n_words - negative - positive')} AS neu, {_share('positive')} AS pos,
  total / sqrt(total * total + 15) AS compound
FROM scored"""
ORACLES["lexicon_sentiment_joined"] = ORACLES["lexicon_sentiment_large"]
ORACLES["speech_patterns"] = f"""{_ANALYSED}
SELECT doc_id, intensity AS emotional_intensity, is_sarcastic, is_exaggerated,
  is_personal, is_recommendation FROM analysed"""
ORACLES["speech_patterns_builtin"] = f"""
SELECT conv_id, turn, {_flags('text', S.DEFAULT_VOCABULARY)} FROM conversations"""
ORACLES["review_anomaly"] = f"""{_ANALYSED}
SELECT doc_id, polarity, is_sarcastic, is_exaggerated, is_emotional, is_anomaly
FROM analysed"""
ORACLES["review_stream"] = f"""{_ANALYSED}
SELECT doc_id, polarity, is_anomaly FROM analysed"""
ORACLES["review_report"] = f"""{_ANALYSED}
SELECT count(*) AS total_reviews, count(*) FILTER (is_anomaly) AS anomaly_count,
  round(100.0::DOUBLE * count(*) FILTER (is_anomaly) / nullif(count(*), 0), 6) AS anomaly_pct,
  count(*) FILTER (polarity > 0) AS positive, count(*) FILTER (polarity < 0) AS negative,
  count(*) FILTER (polarity = 0) AS neutral, count(*) FILTER (is_emotional) AS emotional,
  count(*) FILTER (is_sarcastic) AS sarcastic, count(*) FILTER (is_exaggerated) AS exaggerated,
  count(*) FILTER (is_personal) AS personal, count(*) FILTER (is_recommendation) AS recommendation
FROM analysed"""
ORACLES["type_sentiment_counts"] = f"""{_ANALYSED}
SELECT type, sentiment, count(*) AS n
FROM (SELECT sentiment, unnest(types) AS type FROM typed) GROUP BY ALL"""
ORACLES["emotion_flow"] = f"""{_ANALYSED},
entries AS (
  SELECT type, sentiment, band FROM (SELECT sentiment, band, unnest(types) AS type FROM typed)
  WHERE type IN ('Emotional', 'Sarcastic')),
links(source, target) AS (VALUES
  ('Emotional', 'Positive'), ('Emotional', 'Negative'), ('Sarcastic', 'Positive'),
  ('Sarcastic', 'Negative'), ('Positive', 'High'), ('Positive', 'Low'),
  ('Negative', 'High'), ('Negative', 'Low')),
flows AS (
  SELECT type AS source, sentiment AS target FROM entries
  UNION ALL SELECT sentiment, band FROM entries)
SELECT l.source, l.target, count(f.source) AS n
FROM links l LEFT JOIN flows f ON l.source = f.source AND l.target = f.target GROUP BY ALL"""
ORACLES["type_cooccurrence"] = f"""{_ANALYSED},
numbered AS (
  SELECT doc_id, unnest(types) AS type, unnest(range(len(types))) AS place FROM typed)
SELECT a.type AS type_a, b.type AS type_b, count(*) AS weight
FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND a.place < b.place GROUP BY ALL"""
ORACLES["type_term_counts"] = f"""{_ANALYSED},
counted AS (
  SELECT type, w AS token, count(*) AS n
  FROM (SELECT doc_id, unnest(types) AS type FROM typed) JOIN words USING (doc_id)
  WHERE type <> 'Exaggerated' AND length(w) >= 2 AND w NOT IN ({_list(P.STOP_WORDS)})
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, token)::INTEGER AS rank FROM counted)
SELECT type, token, n, rank FROM ranked WHERE rank <= 50"""
ORACLES["review_timeline"] = f"""{_ANALYSED}
SELECT strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') AS event_ts, polarity,
  CASE WHEN is_emotional THEN 'Emotional' WHEN is_sarcastic THEN 'Sarcastic'
    WHEN is_personal THEN 'Personal' WHEN is_recommendation THEN 'Recommendation'
    ELSE 'Other' END AS type, is_anomaly
FROM analysed a LEFT JOIN events e ON e.event_id = a.doc_id"""
ORACLES["review_features"] = f"""{_ANALYSED}
SELECT doc_id, polarity AS f0, n_chars / (n_chars + 1000::DOUBLE) AS f1,
  intensity AS f2, is_sarcastic::DOUBLE AS f3, is_exaggerated::DOUBLE AS f4,
  is_personal::DOUBLE AS f5, is_recommendation::DOUBLE AS f6 FROM analysed"""

# --- Word lists --------------------------------------------------------------

_PART_WORDS = """(SELECT p_brand AS list_name, p_name AS word, p_type AS category,
  (p_size % 5 + 1)::INTEGER AS severity, p_partkey AS position FROM part)"""
ORACLES["words_by_list"] = f"SELECT * FROM {_PART_WORDS} WHERE list_name = 'Brand#3'"
ORACLES["words_by_severity"] = f"SELECT * FROM {_PART_WORDS} WHERE severity BETWEEN 2 AND 4"

ORACLES["word_list_scan"] = """
SELECT p_name AS word, p_type AS category, (p_size % 5 + 1)::INTEGER AS severity, NULL::VARCHAR AS reason FROM part
WHERE p_size % 11 <> 0 AND p_size % 7 <> 0 AND p_size % 13 <> 0
UNION ALL SELECT concat(p_name, ' | ', p_type, ' | ', p_size % 5 + 1, '.5'), NULL, NULL, 'severity' FROM part
WHERE p_size % 11 <> 0 AND p_size % 7 = 0"""

_ENTRY_ROWS = ", ".join(
    f"({_quote(name)}, {_quote(word)}, {severity})"
    for name, lines in fixed.DEFAULT_WORD_LISTS.items()
    for word, _, severity in (line.split("|") for line in lines.strip().splitlines())
)
_MATCHED = f"""
WITH entries(list_name, word, severity) AS (VALUES {_ENTRY_ROWS}),
matched AS (
  SELECT doc_id, list_name, word, severity::INTEGER AS severity
  FROM documents JOIN entries ON contains(lower(text), lower(word))),
summed AS (
  SELECT doc_id, list_name, count(*) AS n_matches, sum(severity)::BIGINT AS total_severity
  FROM matched GROUP BY ALL),
judged AS (
  SELECT doc_id, coalesce(bool_and(total_severity <= {P.MAX_SEVERITY}), true) AS is_appropriate,
    coalesce(sum(n_matches), 0)::BIGINT AS n_matches
  FROM documents LEFT JOIN summed USING (doc_id) GROUP BY doc_id)
"""
_SPEECH_ROWS = ", ".join(
    f"({_quote(phrase)}, {severity})"
    for phrase, _, severity in (line.split(", ") for line in fixed.SPEECH_PATTERNS.strip().splitlines())
)
ORACLES["speech_list_matches"] = f"""
WITH phrases(word, severity) AS (VALUES {_SPEECH_ROWS})
SELECT doc_id, word, severity::INTEGER AS severity FROM documents JOIN phrases ON contains(lower(text), lower(word))"""
ORACLES["content_matches"] = f"{_MATCHED} SELECT * FROM matched"
ORACLES["content_matches_joined"] = ORACLES["content_matches"]
ORACLES["severity_summary"] = f"{_MATCHED} SELECT doc_id, list_name, total_severity FROM summed"
ORACLES["content_check"] = f"{_MATCHED} SELECT * FROM summed"
ORACLES["content_appropriate"] = f"{_MATCHED} SELECT doc_id, is_appropriate FROM judged"

# --- Review tables -----------------------------------------------------------

_RATED = """(
  SELECT l_quantity AS rating, length(l_returnflag) AS review_length, p_brand AS category
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""
ORACLES["reviews_books_join"] = """
SELECT l_partkey AS asin, l_orderkey, l_linenumber, p_name AS title, p_brand AS main_category
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey"""
ORACLES["reviews_books_join_salted"] = ORACLES["reviews_books_join"]
ORACLES["prepare_reviews"] = f"""
SELECT doc_id, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS review_time,
  length(text) AS review_length,
  len(regexp_extract_all(text, '[^{_BLANKS}]+')) AS word_count
FROM documents LEFT JOIN orders ON o_orderkey = doc_id"""
_CSV = """
SELECT source AS title, coalesce(text, '') AS text, coalesce(n_chars, 0)::DOUBLE AS rating,
  'book_' || rn AS asin, 'book_' || rn AS parent_asin, 'user_' || rn AS user_id,
  0 AS helpful_votes, 0 AS sort_timestamp, false AS verified_purchase
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)"""
ORACLES["csv_reviews_normalize"] = _CSV
ORACLES["csv_reviews_first_rows"] = f"{_CSV} WHERE rn < 130"
ORACLES["lines_first"] = """
WITH first_lines AS (SELECT * FROM documents ORDER BY doc_id LIMIT 130)
SELECT 'doc_id' AS field, 'number' AS value_kind, count(*) AS n FROM first_lines WHERE doc_id IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'lang', 'string', count(*) FROM first_lines WHERE lang IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'even', 'string', count(*) FROM first_lines WHERE n_chars % 2 = 0 HAVING count(*) > 0"""
ORACLES["csv_reviews_load"] = _CSV
ORACLES["training_text"] = """
SELECT doc_id, 'Title: ' || source || ' Review: ' || text AS text,
  (n_chars % 3 > 0)::INTEGER AS is_helpful FROM documents"""
ORACLES["books_scan"] = """
SELECT p_partkey::VARCHAR AS asin, p_name AS title,
  CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END AS author,
  CASE WHEN p_size % 4 <> 0 THEN p_type ELSE '' END AS description,
  p_brand || '|' || p_type AS categories,
  CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE 0 END AS price,
  '' AS store, p_brand AS main_category,
  CASE WHEN p_size % 5 <> 0 THEN p_type END AS image_url,
  round(p_size / 10::DOUBLE, 6) AS average_rating, p_size AS rating_count, 0 AS n_details, NULL::VARCHAR AS reason
FROM part WHERE p_size % 10 <> 0
UNION ALL SELECT p_partkey::VARCHAR, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'price'
FROM part WHERE p_size % 10 = 0"""
ORACLES["reviews_scan"] = """
SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey::VARCHAR ELSE '' END AS asin,
  'R' || o_orderkey AS "reviewerID", o_orderpriority AS review_text, o_totalprice AS rating,
  o_orderkey % 2 = 0 AS verified, strftime(o_orderdate, '%Y-%m-%d') AS review_date,
  CASE WHEN o_orderkey % 3 <> 0 THEN epoch(o_orderdate)::BIGINT ELSE 0 END AS unix_review_time,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 9 ELSE 0 END::INTEGER AS helpful_votes,
  CASE WHEN o_orderkey % 4 = 0 THEN 9 ELSE 0 END AS all_votes, '' AS vote,
  length(o_orderpriority) AS review_length,
  len(string_split(o_orderpriority, ' ')) AS word_count, NULL::VARCHAR AS reason
FROM orders WHERE o_orderkey % 13 <> 0
UNION ALL SELECT NULL, 'R' || o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not JSON'
FROM orders WHERE o_orderkey % 13 = 0"""
ORACLES["rating_summary"] = f"""
SELECT count(*) AS total_reviews, round(avg(rating), 6) AS average_rating,
  round(stddev_samp(rating), 6) AS rating_std, min(rating) AS min_rating, max(rating) AS max_rating,
  round(avg(review_length), 6) AS average_review_length,
  count(DISTINCT category) + max((category IS NULL)::INTEGER) AS total_categories FROM {_RATED}"""
_BY_CATEGORY = f"""
SELECT category, round(avg(rating), 6) AS avg_rating FROM {_RATED}
WHERE category IS NOT NULL GROUP BY category ORDER BY avg(rating) DESC, category"""
ORACLES["category_ratings"] = _BY_CATEGORY
ORACLES["top_categories"] = f"{_BY_CATEGORY} LIMIT 10"


def _bin(value: str, low: str, high: str, bins: int) -> str:
    guess = f"least(floor(({value} - {low}) / ({high} - {low}) * {bins}), {bins - 1})"
    width = f"(({high} - {low}) / {bins})"
    return f"""CASE WHEN {high} = {low} THEN 0 ELSE {guess}
      - ({value} < {low} + {guess} * {width})::INTEGER
      + ({guess} < {bins - 1} AND {value} >= {low} + ({guess} + 1) * {width})::INTEGER
      END::INTEGER"""


def _histogram(values: str, bins: int) -> str:
    return f"""
SELECT {_bin('v', 'low', 'high', bins)} AS bin, count(*) AS n
FROM (SELECT v, min(v) OVER () AS low, max(v) OVER () AS high FROM ({values})) GROUP BY 1"""


def _box(column: str, wrap: str) -> str:
    def out(expression: str, name: str) -> str:
        return f"{wrap.format(expression)} AS {name}"

    return f"""
WITH q AS (
  SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS median,
    quantile_cont({column}, 0.75) AS q3 FROM lineitem),
judged AS (
  SELECT {column} AS v, {column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM lineitem, q)
SELECT {out('any_value(q1)', 'q1')}, {out('any_value(median)', 'median')}, {out('any_value(q3)', 'q3')},
  {out('min(v) FILTER (inside)', 'lower_whisker')}, {out('max(v) FILTER (inside)', 'upper_whisker')},
  count(*) FILTER (NOT inside) AS n_outliers
FROM judged, q"""


ORACLES["rating_histogram"] = _histogram("SELECT l_quantity AS v FROM lineitem", 20)
ORACLES["rating_box"] = _box("l_quantity", "{}")
ORACLES["price_box"] = _box("l_extendedprice", "round({}, 6)")
ORACLES["row_numbers"] = """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders"""
ORACLES["json_profile"] = """
SELECT field, CASE json_type(json_extract(props, '$.' || field))
    WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' WHEN 'VARCHAR' THEN 'string'
    WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS value_kind,
  count(*) AS n
FROM (SELECT props, unnest(json_keys(props)) AS field FROM events) GROUP BY ALL"""
ORACLES["json_value_summary"] = """
SELECT doc_id, 'text' AS field,
  CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS summary FROM documents
UNION ALL SELECT doc_id, 'parts', 'List with ' || len(string_split(text, ' ')) || ' items' FROM documents
UNION ALL SELECT doc_id, 'meta', 'Dict with 2 keys' FROM documents
UNION ALL SELECT doc_id, 'n_chars', n_chars::VARCHAR FROM documents"""

# --- Behaviour and splits ----------------------------------------------------

_USERS = """
WITH gaps AS (
  SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
  FROM events WHERE user_id IS NOT NULL),
users AS (
  SELECT user_id, count(ts) AS review_frequency, avg(gap) / 1e6 AS avg_gap_seconds,
    (SELECT avg(gap) / 1e6 FROM gaps) AS global_avg_gap_seconds, avg(value) AS avg_rating,
    stddev_samp(value) AS rating_std, avg(length(props)) AS avg_review_length
  FROM gaps GROUP BY user_id)
"""
ORACLES["behavioral_features"] = f"""{_USERS}
SELECT user_id, review_frequency, round(avg_gap_seconds, 6) AS avg_gap_seconds,
  round(global_avg_gap_seconds, 6) AS global_avg_gap_seconds, round(avg_rating, 6) AS avg_rating,
  round(rating_std, 6) AS rating_std, round(avg_review_length, 6) AS avg_review_length FROM users"""
ORACLES["review_gaps"] = """
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS review_time, n AS n_reviews,
  round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6, 6) AS gap_seconds
FROM (SELECT user_id, ts, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL)"""
ORACLES["behavioral_features_windowed"] = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id,
  count(ts) AS review_frequency, round(avg(value), 6) AS avg_rating,
  round(stddev_samp(value), 6) AS rating_std, round(avg(length(props)), 6) AS avg_review_length
FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2"""
ORACLES["train_test_split_exact"] = f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('{fixed.SEED}:' || doc_id)) <= {P.TEST_ROWS}
  THEN 'test' ELSE 'train' END AS split FROM documents"""
ORACLES["train_test_split_by_two_columns"] = f"""
SELECT conv_id, turn, CASE WHEN row_number() OVER (
    ORDER BY md5('{fixed.SEED}:["' || conv_id || '","' || turn || '"]')) <= {P.TEST_ROWS}
  THEN 'test' ELSE 'train' END AS split FROM conversations"""

# --- Evaluation --------------------------------------------------------------

_BY_LENGTH = """
WITH scored AS (
  SELECT quality AS y_true, (n_chars + 1) / (n_chars + 1001::DOUBLE) AS y_score,
    ((n_chars + 1) / (n_chars + 1001::DOUBLE) > 0.5::DOUBLE)::INTEGER AS y_pred
  FROM labels JOIN documents USING (doc_id))"""
_INSULTS = f"len(regexp_extract_all(lower(text), {_quote('|'.join(P.INSULTS))}))"
_BY_INSULTS = f"""
scored_by_insults AS (
  SELECT quality AS y_true, ({_INSULTS} = 0)::INTEGER AS y_pred, toxic,
    {_INSULTS} / ({_INSULTS} + 1::DOUBLE) AS insult_score
  FROM labels JOIN documents USING (doc_id))"""


def _ratio(part: str, whole: str) -> str:
    return f"coalesce(({part}) / nullif(({whole})::DOUBLE, 0), 0)"


def _classes(scored: str) -> str:
    return f"""(
  SELECT label, support, hits, {_ratio('hits', 'predicted')} AS precision, {_ratio('hits', 'support')} AS recall,
    {_ratio('2 * hits', 'predicted + support')} AS f1
  FROM (
    SELECT label, (SELECT count(*) FROM {scored} WHERE y_true = label) AS support,
      (SELECT count(*) FROM {scored} WHERE y_pred = label) AS predicted,
      (SELECT count(*) FROM {scored} WHERE y_true = label AND y_pred = label) AS hits
    FROM (SELECT y_true AS label FROM {scored} UNION SELECT y_pred FROM {scored})))"""


def _weighted(metric: str) -> str:
    return f"round(sum({metric} * support) / sum(support), 6)"


ORACLES["binary_metrics"] = f"""{_BY_LENGTH},
counts AS (
  SELECT count(*) FILTER (y_true = 1 AND y_pred = 1) AS hits, count(*) FILTER (y_pred = 1) AS predicted,
    count(*) FILTER (y_true = 1) AS actual, avg((y_true = y_pred)::INTEGER) AS accuracy FROM scored)
SELECT round(accuracy, 6) AS accuracy, round({_ratio('hits', 'predicted')}, 6) AS precision,
  round({_ratio('hits', 'actual')}, 6) AS recall,
  round({_ratio('2 * hits', 'predicted + actual')}, 6) AS f1_score FROM counts"""
ORACLES["weighted_metrics"] = f"""{_BY_LENGTH}
SELECT round(sum(hits) / sum(support), 6) AS accuracy, {_weighted('precision')} AS precision,
  {_weighted('recall')} AS recall, {_weighted('f1')} AS f1 FROM {_classes('scored')}"""
ORACLES["classification_report"] = f"""WITH {_BY_INSULTS},
classes AS (SELECT * FROM {_classes('scored_by_insults')})
SELECT label::VARCHAR AS row_label, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support FROM classes
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), sum(support)::BIGINT FROM classes
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  sum(support)::BIGINT FROM classes
UNION ALL SELECT 'weighted avg', {_weighted('precision')}, {_weighted('recall')}, {_weighted('f1')},
  sum(support)::BIGINT FROM classes"""
ORACLES["confusion_matrix"] = f"""WITH {_BY_INSULTS},
label_values AS (SELECT y_true AS v FROM scored_by_insults UNION SELECT y_pred FROM scored_by_insults)
SELECT t.v AS y_true, p.v AS y_pred,
  (SELECT count(*) FROM scored_by_insults s WHERE s.y_true = t.v AND s.y_pred = p.v) AS n
FROM label_values t, label_values p"""
ORACLES["prediction_distribution"] = f"""{_BY_LENGTH}
SELECT y_pred, count(*) AS n FROM scored GROUP BY y_pred"""
ORACLES["roc_curve"] = f"""{_BY_LENGTH},
steps AS (
  SELECT y_score, count(*) FILTER (y_true = 1) AS tp, count(*) FILTER (y_true <> 1) AS fp
  FROM scored GROUP BY y_score),
running AS (
  SELECT *, sum(tp) OVER down AS ctp, sum(fp) OVER down AS cfp, lead(tp) OVER down AS ntp,
    lead(fp) OVER down AS nfp, row_number() OVER down AS rn, sum(tp) OVER () AS p, sum(fp) OVER () AS n
  FROM steps WINDOW down AS (ORDER BY y_score DESC))
SELECT round(cfp / n::DOUBLE, 6) AS fpr, round(ctp / p::DOUBLE, 6) AS tpr, round(y_score, 6) AS threshold
FROM running WHERE rn = 1 OR ntp IS NULL OR ntp <> tp OR nfp <> fp
UNION ALL SELECT 0, 0, 'inf'::DOUBLE"""


def _auc(scored: str, y_true: str, score: str) -> str:
    ranked = f"(SELECT {y_true} AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2::DOUBLE AS r FROM {scored})"
    ones, zeros = "count(*) FILTER (y = 1)", "count(*) FILTER (y <> 1)"
    return f"(SELECT round((sum(r) FILTER (y = 1) - {ones} * ({ones} + 1) / 2::DOUBLE) / nullif({ones} * {zeros}, 0), 6) FROM {ranked})"


ORACLES["roc_auc"] = f"""{_BY_LENGTH}, {_BY_INSULTS}
SELECT 'length' AS model, {_auc('scored', 'y_true', 'y_score')} AS roc_auc
UNION ALL SELECT 'insults', {_auc('scored_by_insults', 'toxic', 'insult_score')}"""
ORACLES["scored_loss_accuracy"] = f"""{_BY_LENGTH}
SELECT round(avg(-ln(CASE WHEN y_true = 1 THEN y_score ELSE 1 - y_score END)), 6) AS loss,
  round(avg((y_true = y_pred)::INTEGER), 6) AS accuracy FROM scored"""
ORACLES["logits_to_predictions"] = """
SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS y_pred,
  round(1 / list_sum([exp(x::DOUBLE - list_max(embedding)::DOUBLE) FOR x IN embedding]), 6) AS p_max
FROM embeddings"""


def _compared(model: str, scored: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{model}' AS model, '{name}' AS metric, {_weighted(metric)} AS value FROM {_classes(scored)}"
        for name, metric in (("precision", "precision"), ("recall", "recall"), ("f1-score", "f1"))
    )


ORACLES["model_comparison"] = f"""{_BY_LENGTH}, {_BY_INSULTS}
{_compared('length', 'scored')} UNION ALL {_compared('insults', 'scored_by_insults')}"""

# --- Vectors -----------------------------------------------------------------

_CELLS = """
cells AS (
  SELECT vec_id, label, label < 5 AS is_real, unnest(embedding)::DOUBLE AS v,
    unnest(range(len(embedding)))::INTEGER AS pos FROM embeddings)"""
ORACLES["feature_statistics"] = f"""WITH {_CELLS}
SELECT pos, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
  round(max(v), 6) AS max FROM cells GROUP BY pos"""
ORACLES["feature_histograms"] = f"""WITH {_CELLS},
spans AS (
  SELECT CASE WHEN is_real THEN 'Real' ELSE 'Generated' END AS origin, pos, v,
    min(v) OVER (PARTITION BY is_real, pos) AS low, max(v) OVER (PARTITION BY is_real, pos) AS high
  FROM cells)
SELECT origin, pos, {_bin('v', 'low', 'high', 20)} AS bin, count(*) AS n FROM spans GROUP BY 1, 2, 3"""
_DISTANCES = f"""
WITH {_CELLS},
counts AS (
  SELECT pos, v, count(*) FILTER (is_real) AS r, count(*) FILTER (NOT is_real) AS f
  FROM cells GROUP BY pos, v),
steps AS (
  SELECT pos, v, lead(v) OVER up - v AS width,
    sum(r) OVER up / sum(r) OVER (PARTITION BY pos)::DOUBLE AS cr,
    sum(f) OVER up / sum(f) OVER (PARTITION BY pos)::DOUBLE AS cf
  FROM counts WINDOW up AS (PARTITION BY pos ORDER BY v)),
distances AS (SELECT pos, sum(abs(cr - cf) * coalesce(width, 0)) AS distance FROM steps GROUP BY pos)"""
ORACLES["wasserstein_distance"] = f"""{_DISTANCES}
SELECT round(avg(distance), 6) AS wasserstein_distance FROM distances"""
ORACLES["wasserstein_by_feature"] = f"""{_DISTANCES}
SELECT pos, round(distance, 6) AS distance FROM distances"""
_DIVERSITY = """(
  SELECT avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.label >= 5 AND b.label >= 5)"""
ORACLES["diversity_score"] = """
SELECT round(avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS diversity_score
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"""
ORACLES["two_sample_evaluation"] = f"""{_DISTANCES},
scores AS (
  SELECT label < 5 AS is_real, 1 / (1 + exp(-8 * embedding[1]::DOUBLE)) AS score FROM embeddings),
verdicts AS (
  SELECT count(*) FILTER (is_real AND score > 0.5::DOUBLE) AS hits, count(*) FILTER (score > 0.5::DOUBLE) AS predicted,
    count(*) FILTER (is_real) AS actual, avg(score) FILTER (is_real) AS real_mean,
    avg(score) FILTER (NOT is_real) AS fake_mean FROM scores)
SELECT round((SELECT avg(distance) FROM distances), 6) AS wasserstein_distance,
  round({_DIVERSITY}, 6) AS diversity_score,
  round({_ratio('hits', 'predicted')}, 6) AS discriminator_precision,
  round({_ratio('hits', 'actual')}, 6) AS discriminator_recall,
  round({_ratio('2 * hits', 'predicted + actual')}, 6) AS discriminator_f1,
  round(real_mean, 6) AS real_mean_score, round(fake_mean, 6) AS fake_mean_score FROM verdicts"""
_ERRORS = f"""
WITH {_CELLS},
centred AS (SELECT vec_id, v - avg(v) OVER (PARTITION BY label, pos) AS d FROM cells),
errors AS (SELECT vec_id, avg(d * d) AS error FROM centred GROUP BY vec_id)"""
ORACLES["reconstruction_anomaly"] = f"""{_ERRORS}
SELECT vec_id, round(error, 6) AS error, error > {P.RECONSTRUCTION_CUT}::DOUBLE AS is_anomaly FROM errors"""
ORACLES["error_histogram"] = f"{_ERRORS} {_histogram('SELECT error AS v FROM errors', 50)}"
ORACLES["standard_scale"] = f"""WITH {_CELLS}
SELECT vec_id, pos, round((v - avg(v) OVER (PARTITION BY pos)) / stddev_pop(v) OVER (PARTITION BY pos), 6) AS value
FROM cells"""
ORACLES["combined_features"] = f"""{_USERS},
kinds AS (
  SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b,
    count(*) FILTER (event_type = 'error') AS c, count(*) FILTER (event_type = 'purchase') AS p,
    count(*) FILTER (event_type = 'signup') AS s FROM events GROUP BY user_id),
listed AS (
  SELECT user_id, unnest([a::DOUBLE, b, c, p, s, review_frequency, avg_gap_seconds, avg_rating, rating_std,
    avg_review_length]) AS v, unnest(range(10))::INTEGER AS pos FROM kinds JOIN users USING (user_id))
SELECT user_id, pos, round((v - avg(v) OVER (PARTITION BY pos))
  / CASE WHEN stddev_pop(v) OVER (PARTITION BY pos) > 1e-9 THEN stddev_pop(v) OVER (PARTITION BY pos) ELSE 1 END, 6) AS value
FROM listed"""

# --- Text features -----------------------------------------------------------

_TFIDF = f"""
WITH long_words AS (
  SELECT doc_id, [t FOR t IN {_CONTENT_TOKENS} IF length(t) >= 2] AS ws FROM documents),
terms AS (
  SELECT doc_id, unnest(ws || [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS term
  FROM long_words),
tf AS (SELECT doc_id, term, count(*) AS n FROM terms GROUP BY ALL),
vocabulary AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= {fixed.MIN_DF}
  ORDER BY sum(n) DESC, term LIMIT {fixed.MAX_FEATURES}),
size AS (SELECT count(*)::DOUBLE AS docs FROM documents),
weighted AS MATERIALIZED (
  SELECT doc_id, term, n * (ln((1 + docs) / (1 + df)) + 1) AS w
  FROM tf JOIN vocabulary USING (term), size),
scores AS MATERIALIZED (
  SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS score FROM weighted)
"""
ORACLES["tfidf_scores"] = f"{_TFIDF} SELECT doc_id, term, round(score, 6) AS score FROM scores"
ORACLES["top_keywords"] = f"""{_TFIDF}
SELECT term, round(sum(score) / any_value(docs), 6) AS score FROM scores, size
GROUP BY term ORDER BY sum(score) DESC, term LIMIT {fixed.TOP_KEYWORDS}"""
ORACLES["scaled_tfidf"] = f"""{_TFIDF},
moments AS MATERIALIZED (
  SELECT term, sum(score) / any_value(docs) AS mean, sum(score * score) / any_value(docs) AS square
  FROM scores, size GROUP BY term),
stats AS MATERIALIZED (SELECT term, mean, sqrt(square - mean * mean) AS dev FROM moments)
SELECT doc_id, term, round((score - mean) / dev, 6) AS value FROM scores JOIN stats USING (term)
UNION ALL SELECT NULL, term, round(-mean / dev, 6) FROM stats"""
ORACLES["content_analysis"] = f"""{_TFIDF}, {_MATCHED.strip()[len('WITH '):]},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term)::INTEGER AS rank FROM scores)
SELECT doc_id, is_appropriate, n_matches, rank, term AS keyword, round(score, 6) AS score
FROM ranked JOIN judged USING (doc_id) WHERE rank <= 10"""

# --- Components, streams, files of runs --------------------------------------

ORACLES["pca_score_lengths"] = f"""WITH {_CELLS}, centred AS (SELECT vec_id, v - avg(v) OVER (PARTITION BY pos) AS d FROM cells)
SELECT vec_id, round(sum(d * d), 6) AS squared_length FROM centred GROUP BY vec_id"""
ORACLES["pca_component_correlation"] = """
SELECT a.i::INTEGER AS a, b.i::INTEGER AS b, CASE WHEN a.i = b.i THEN 1::DOUBLE ELSE 0::DOUBLE END AS r
FROM range(5) a(i), range(5) b(i)"""
ORACLES["pca_variance"] = f"""WITH {_CELLS}, spread AS (SELECT pos, var_samp(v) AS s FROM cells GROUP BY pos)
SELECT round(sum(s), 6) AS total_variance, true AS falls FROM spread"""
ORACLES["projection_lengths"] = f"""{_ANALYSED},
listed AS (
  SELECT doc_id, unnest([polarity, n_chars / (n_chars + 1000::DOUBLE), intensity, is_sarcastic::DOUBLE, is_exaggerated::DOUBLE,
    is_personal::DOUBLE, is_recommendation::DOUBLE]) AS v, unnest(range(7)) AS pos FROM analysed),
centred AS (SELECT doc_id, v - avg(v) OVER (PARTITION BY pos) AS d FROM listed)
SELECT doc_id, round(sum(d * d), 6) AS squared_length FROM centred GROUP BY doc_id"""
ORACLES["behavior_stream"] = """
WITH start AS (SELECT date_trunc('day', min(ts)) AS t0, max(ts) AS latest FROM events),
in_time AS (
  SELECT e.*, date_trunc('day', ts) AS day, latest FROM events e, start
  WHERE NOT (event_id % 97 = 0 AND ts < t0 + INTERVAL 10 DAY))
SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS window_start, user_id, count(ts) AS review_frequency,
  round(avg(value), 6) AS avg_rating, round(stddev_samp(value), 6) AS rating_std, round(avg(length(props)), 6) AS avg_review_length
FROM in_time WHERE user_id IS NOT NULL AND day + INTERVAL 1 DAY <= latest - INTERVAL 1 DAY GROUP BY day, user_id"""
_RUNS = f"""
WITH parts AS (
  SELECT c_nationkey AS run, c_custkey % 8 AS epoch, max(c_acctbal / 1000::DOUBLE) AS loss,
    (count(*) FILTER (c_acctbal > 0))::DOUBLE AS acc FROM customer GROUP BY ALL),
placed AS (
  SELECT run, row_number() OVER up - 1 AS epoch, row_number() OVER down - 1 AS from_end, loss, acc FROM parts
  WINDOW up AS (PARTITION BY run ORDER BY epoch), down AS (PARTITION BY run ORDER BY epoch DESC))
"""
ORACLES["run_histories"] = f"""{_RUNS}
SELECT p.run::INTEGER AS run, p.epoch::INTEGER AS epoch, p.loss AS train_loss, p.acc AS train_acc, q.loss AS val_loss, 0::INTEGER AS n_val_acc
FROM placed p JOIN placed q ON p.run = q.run AND p.epoch = q.from_end"""
ORACLES["history_compare"] = f"""{_RUNS}
SELECT run::INTEGER AS run, loss AS final_loss, acc AS final_acc FROM placed WHERE from_end = 0"""
ORACLES["run_evaluations"] = """
SELECT l_linenumber::INTEGER AS run, round(avg(((l_returnflag = 'R') = (l_quantity > 25))::INTEGER), 6) AS accuracy,
  count(*) FILTER (l_returnflag <> 'R' AND l_quantity <= 25) AS n00, count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 25) AS n01,
  count(*) FILTER (l_returnflag = 'R' AND l_quantity <= 25) AS n10, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS n11
FROM lineitem GROUP BY l_linenumber"""
ORACLES["latest_run"] = "SELECT r_name AS run FROM region ORDER BY r_regionkey LIMIT 1"
ORACLES["json_report"] = _BY_CATEGORY
ORACLES["held_out_rows"] = f"""
WITH hashed AS (
  SELECT text, quality AS label, row_number() OVER (ORDER BY md5('{fixed.SEED}:' || doc_id)) AS place
  FROM labels JOIN documents USING (doc_id))
SELECT md5(text) AS text_md5, label FROM hashed WHERE place <= {P.TEST_ROWS}"""
ORACLES["csv_missing_cells"] = """
SELECT doc_id, CASE WHEN n_chars % 7 = 5 THEN 'kept' END AS cell, lang FROM documents"""
ORACLES["evaluate_all"] = f"""{_BY_LENGTH},
classes AS (SELECT * FROM {_classes('scored')}),
single AS (
  SELECT count(*) FILTER (y_true = 1 AND y_pred = 1) AS hits, count(*) FILTER (y_pred = 1) AS predicted,
    count(*) FILTER (y_true = 1) AS actual, avg((y_true = y_pred)::INTEGER) AS accuracy FROM scored),
labels_seen AS (SELECT y_true AS v FROM scored UNION SELECT y_pred FROM scored)
SELECT 'accuracy' AS metric, NULL::VARCHAR AS label, NULL::VARCHAR AS other, round(accuracy, 6) AS value FROM single
UNION ALL SELECT 'precision', NULL, NULL, round({_ratio('hits', 'predicted')}, 6) FROM single
UNION ALL SELECT 'recall', NULL, NULL, round({_ratio('hits', 'actual')}, 6) FROM single
UNION ALL SELECT 'f1_score', NULL, NULL, round({_ratio('2 * hits', 'predicted + actual')}, 6) FROM single
UNION ALL SELECT 'weighted_precision', NULL, NULL, {_weighted('precision')} FROM classes
UNION ALL SELECT 'weighted_recall', NULL, NULL, {_weighted('recall')} FROM classes
UNION ALL SELECT 'weighted_f1', NULL, NULL, {_weighted('f1')} FROM classes
UNION ALL SELECT 'class_precision', label::VARCHAR, NULL, round(precision, 6) FROM classes
UNION ALL SELECT 'class_recall', label::VARCHAR, NULL, round(recall, 6) FROM classes
UNION ALL SELECT 'class_f1', label::VARCHAR, NULL, round(f1, 6) FROM classes
UNION ALL SELECT 'support', label::VARCHAR, NULL, support::DOUBLE FROM classes
UNION ALL SELECT 'confusion', t.v::VARCHAR, p.v::VARCHAR,
  (SELECT count(*) FROM scored s WHERE s.y_true = t.v AND s.y_pred = p.v)::DOUBLE FROM labels_seen t, labels_seen p
UNION ALL SELECT 'roc_auc', NULL, NULL, {_auc('scored', 'y_true', 'y_score')}"""
