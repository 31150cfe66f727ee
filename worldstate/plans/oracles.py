"""SQL that gives the same rows as queries.py, for DuckDB."""

from __future__ import annotations

from ..functions import text

OBS = "obs AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS \"at\", floor(value / 10)::BIGINT AS key FROM events)"
CHANGES = f"{OBS}, c AS (SELECT *, coalesce(key <> lag(key) OVER w, false) AS is_change, row_number() OVER w = 1 AS first FROM obs WINDOW w AS (PARTITION BY user_id, event_type ORDER BY \"at\", event_id))"
URLS = r"""
u AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS auth,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query
  FROM pages
), args AS (
  SELECT page_id, string_agg(p, '&' ORDER BY n, i) AS args
  FROM (SELECT page_id, p, i, split_part(p, '=', 1) AS n FROM (SELECT page_id, unnest(string_split(query, '&')) AS p, generate_subscripts(string_split(query, '&'), 1) AS i FROM u))
  WHERE p <> '' AND NOT starts_with(lower(n), 'utm_') AND lower(n) NOT IN ('gclid','fbclid','mc_cid','mc_eid','ref_src','igshid','msclkid','dclid','gbraid','wbraid','yclid','twclid','_hsenc','_hsmi','mkt_tok')
  GROUP BY page_id
), canon AS (
  SELECT u.page_id, CASE WHEN scheme = '' THEN url ELSE scheme || '://' || CASE WHEN (scheme = 'https' AND auth LIKE '%:443') OR (scheme <> 'https' AND auth LIKE '%:80') THEN regexp_replace(auth, ':(80|443)$', '') ELSE auth END
    || CASE WHEN path = '' THEN '/' ELSE path END || coalesce('?' || args, '') END AS canonical,
    regexp_replace(regexp_extract(auth, '^(?:[^@]*@)?([^:]*)', 1), '\.$', '') AS host
  FROM u LEFT JOIN args ON u.page_id = args.page_id
)"""

WORDS = r"[\p{L}\p{M}\p{N}_]+"
QUOTE_LINES = rf"""
WITH b AS (SELECT item_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM benchmark),
n AS (
  SELECT item_id, line, doc_id, regexp_replace(trim(regexp_replace(lower(translate(regexp_replace(text, '[\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}\x{{ad}}]', '', 'g'), '{text.ALIKE[0]}', '{text.ALIKE[1].replace("'", "''")}')), '[\t-\r\x{{85}}\p{{Z}}]+', ' ', 'g')), '({WORDS})', chr(1) || '\1' || chr(2), 'g') AS t
  FROM (SELECT item_id, line, NULL AS doc_id, text FROM b UNION ALL SELECT NULL, NULL, doc_id, text FROM documents)
)
SELECT DISTINCT q.item_id, q.line::BIGINT AS line, d.doc_id FROM n q JOIN n d ON contains(d.t, q.t) WHERE q.item_id IS NOT NULL AND d.item_id IS NULL AND contains(q.t, chr(1))
"""

ORACLES = {
    "w_fact_versions": f"WITH {CHANGES} SELECT user_id, event_type, arg_max(key, (\"at\", event_id)) AS current, min(\"at\") AS first_seen, max(CASE WHEN is_change THEN \"at\" END) AS last_changed, count(*) AS n_versions, count(*) FILTER (is_change) AS n_changes FROM c GROUP BY ALL",
    "w_value_trail": f"WITH {CHANGES} SELECT user_id, event_type, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY \"at\", event_id))::INT AS step, key AS value, \"at\" AS since FROM c WHERE first OR is_change",
    "j11_as_of": f"WITH {OBS} SELECT user_id, event_type, arg_max(key, (\"at\", event_id)) AS value, max(\"at\") AS since FROM obs WHERE \"at\" <= 1705276800000000 GROUP BY ALL",
    "w5_last_versions": f"WITH {OBS} SELECT user_id, event_type, n::INT AS nth, event_id, key FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY \"at\" DESC, event_id DESC) AS n FROM obs) WHERE n <= 3",
    "w8_first_per_month": "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL",
    "w9_latest_per_key": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY ALL",
    "w14_dense_ids": "SELECT o_custkey, o_orderkey, 'S' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS label FROM orders",
    "g1_attention_funnel": "SELECT count(*) AS checks, count(*) FILTER (event_type <> 'view') AS changes, count(*) FILTER (event_type = 'click') AS filtered, count(*) FILTER (event_type = 'signup') AS investigated, count(*) FILTER (event_type = 'purchase') AS published, count(*) FILTER (event_type NOT IN ('view', 'click')) AS material FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
    "g4_entity_summary": "SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS n_live, epoch_us(max(CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate END)) AS last_live FROM orders GROUP BY ALL",
    "g10_evidence_status": """
WITH i AS (
  SELECT user_id AS claim_id, CASE WHEN event_type = 'purchase' THEN 'p' WHEN event_type IN ('view', 'click') THEN 'i' ELSE 'c' END AS k,
    CASE WHEN value >= 10 THEN 's' WHEN value < 2 THEN 'c' ELSE 'x' END AS st, (props::JSON->>'$.k')::INT % 50 = 0 AS ok, 'p' || (props::JSON->>'$.k') AS pub FROM events
), a AS (
  SELECT claim_id, coalesce(bool_or(ok AND k = 'p' AND st = 's'), false) AS ps, coalesce(bool_or(ok AND k = 'p' AND st = 'c'), false) AS pc,
    coalesce(bool_or(ok AND k = 'i' AND st = 's'), false) AS si, coalesce(bool_or(ok AND k = 'i' AND st = 'c'), false) AS ci,
    count(DISTINCT pub) FILTER (ok AND k = 'i' AND st = 's') AS n, coalesce(string_agg(DISTINCT pub, ', ' ORDER BY pub) FILTER (ok AND k = 'i' AND st = 's'), '') AS publishers
  FROM i GROUP BY claim_id
)
SELECT claim_id, CASE WHEN pc THEN 'conflicting' WHEN ps THEN 'confirmed' WHEN si AND ci THEN 'conflicting' WHEN n >= 2 THEN 'corroborated' WHEN n = 1 THEN 'single_source' ELSE 'unverified' END AS status, n AS n_origins, publishers FROM a
""",
    "g18_severity_counts": """
WITH s AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS r,
    CASE WHEN o_orderstatus NOT IN ('F', 'O') OR o_totalprice < 50000 THEN 2 WHEN o_orderstatus = 'O' THEN 3 ELSE 4 END AS most FROM orders
)
SELECT ['none', 'low', 'medium', 'high', 'critical'][least(r, most) + 1] AS severity, count(*) AS n FROM s GROUP BY ALL
""",
    "j8_unread": "SELECT c_mktsegment, count(*) AS n_unread FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY ALL",
    "j11_as_of_join": f"WITH {OBS} SELECT l.user_id, l.event_id, max(r.\"at\") AS matched_at, arg_max(r.key, r.\"at\") AS key FROM obs l LEFT JOIN obs r ON r.user_id = l.user_id AND r.event_type = 'view' AND r.\"at\" <= l.\"at\" WHERE l.event_type = 'purchase' GROUP BY ALL",
    "j12_nearest": f"WITH {OBS} SELECT l.user_id, l.event_id, arg_min(r.\"at\", (abs(r.\"at\" - l.\"at\"), r.\"at\")) AS matched_at FROM obs l LEFT JOIN obs r ON r.user_id = l.user_id AND r.event_type = 'purchase' AND abs(r.\"at\" - l.\"at\") <= 270000000000 WHERE l.event_type = 'signup' GROUP BY ALL",
    "j14_interval_join": f"WITH {OBS} SELECT l.user_id, l.event_id, count(*) AS n_near FROM obs l JOIN obs r ON r.user_id = l.user_id AND r.event_type = 'view' AND r.\"at\" BETWEEN l.\"at\" - 151200000000 AND l.\"at\" + 75600000000 WHERE l.event_type = 'error' GROUP BY ALL",
    "t1_ranked_search": "SELECT item_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ('hein', 'the', 'thent')))::BIGINT AS score FROM benchmark WHERE score > 0 ORDER BY score DESC, item_id LIMIT 10",
    "t4_keyset_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
    "t8_activity": f"WITH {OBS}, t AS (SELECT event_type, event_id, \"at\", row_number() OVER (PARTITION BY event_type ORDER BY \"at\" DESC, event_id DESC) AS n FROM obs) SELECT event_type, event_id, \"at\" FROM t WHERE n <= 20 ORDER BY \"at\" DESC, event_id DESC LIMIT 30",
    "u1_canonical_urls": rf"WITH {URLS} SELECT page_id, canonical, host, CASE WHEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> '' THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) ELSE host END AS publisher FROM canon",
    "e1_dedup_urls": f"WITH {URLS} SELECT canonical, min(page_id) AS page_id FROM canon GROUP BY ALL",
    "j10_unseen": f"WITH {URLS} SELECT page_id, canonical FROM canon WHERE page_id % 2 = 1 AND canonical NOT IN (SELECT canonical FROM canon WHERE page_id % 2 = 0)",
    "e6_routed_teams": "SELECT o_custkey, string_agg(DISTINCT t, ',' ORDER BY t) AS teams FROM (SELECT o_custkey, o_orderpriority AS t FROM orders UNION SELECT o_custkey, o_orderstatus FROM orders) GROUP BY ALL",
    "e12_new_since_visit": f"WITH {OBS}, v AS (SELECT *, coalesce(\"at\" > max(\"at\") FILTER (event_type = 'signup') OVER (PARTITION BY user_id), false) AS is_new FROM obs) SELECT user_id, count(*) FILTER (is_new) AS n_new, count(*) FILTER (NOT is_new) AS n_earlier FROM v GROUP BY ALL",
    "p1_quality_gate": r"SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '[^ \t\n\r]+'))::BIGINT AS n_words, CASE WHEN page_id % 17 = 0 THEN 'blocked' WHEN page_id % 19 = 0 OR n_words < 105 THEN 'degenerate' ELSE 'ok' END AS verdict FROM pages",
    "m2_next_interval": "WITH e AS (SELECT event_id, event_type, greatest(user_id % 90, 5) AS base, event_id % 5000 AS cur, event_id % 9 AS f, user_id % 2 = 0 AS page FROM events) SELECT event_id, (CASE WHEN NOT page OR event_type NOT IN ('view', 'error') THEN base WHEN event_type IN ('view', 'error') AND (event_type = 'view' OR event_id % 2 = 0) THEN least(floor(greatest(cur, base) * 1.5), base * 4, 10080) ELSE least(base * pow(2, least(f, 5)), 2880) END)::BIGINT AS minutes FROM e",
    "f11_numbers": r"WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]{1,3}(?:,[0-9]{2,3})+(?:\.[0-9]+)?') THEN replace(x, ',', '') ELSE x END) AS a FROM documents) SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '|') AS numbers FROM n",
    "f13_quotes": "SELECT item_id, doc_id FROM (SELECT item_id, string_split(text, chr(10))[1] AS quote FROM benchmark) b JOIN documents d ON contains(d.text, quote) AND len(string_split(quote, ' ')) >= 5",
    "f13_quote_lines": QUOTE_LINES,
}
