"""DuckDB SQL for the named queries, written from the definitions and not from the Spark code.

Shared table expressions are kept once; a query takes the ones its text mentions.
"""

from __future__ import annotations

import re

from profilum.fixed_values import (
    APOLOGY,
    ANALYST_CLOSING,
    ANALYST_OPENING,
    ANALYST_QUERY,
    BUDGETED_CLOSING,
    BUDGETED_INSTRUCTIONS,
    COMPARE_QUESTION,
    CUSTOMER_INFO_WORDS,
    EMAIL_PATTERN,
    INTENT_WORDS,
    INTERACTION_ERROR,
    PRESET_QUESTIONS,
    PRODUCTS_PER_INTENT,
    PROMPT_CLOSING,
    PROMPT_INSTRUCTIONS,
    SENTIMENT_CLOSING,
    SENTIMENT_OPENING,
    STOP_WORDS,
    TICKETS_PER_INTENT,
    WORD_PUNCTUATION,
)

AS_OF = "DATE '2001-08-02'"
EVENTS_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _email(column: str) -> str:
    return f"'customer' || lpad(({column})::VARCHAR, 9, '0') || '@example.com'"


_OWNER = "(doc_id * 7919) % (100 + 100 * (doc_id % 11))"
_ASKER = "(conv_id * 7919) % (100 + 100 * (conv_id % 11))"
_START = "TIMESTAMP '2001-01-01 00:00:00'"


def _ticket_text(subject: str, description: str) -> str:
    return (
        f"'Subject: ' || coalesce({subject}, '') || chr(10) || 'Description: ' || coalesce({description}, '') || chr(10) || "
        "'Status: ' || status || chr(10) || 'Priority: ' || priority"
    )


def _health_mean() -> str:
    recency = "CASE WHEN days_since_last_purchase < 30 THEN 100 WHEN days_since_last_purchase < 90 THEN 75 WHEN days_since_last_purchase < 180 THEN 50 WHEN days_since_last_purchase >= 180 THEN 25 END"
    parts = [
        f"({recency})::DOUBLE",
        "CASE WHEN total_orders > 0 THEN least(100.0::DOUBLE, (total_orders / 10.0::DOUBLE) * 100.0::DOUBLE) END",
        "CASE WHEN lifetime_value > 0 THEN least(100.0::DOUBLE, lifetime_value / 100.0::DOUBLE) END",
        "CASE WHEN avg_satisfaction_score <> 0 THEN (avg_satisfaction_score / 5.0::DOUBLE) * 100.0::DOUBLE END",
        "(CASE WHEN open_tickets = 0 THEN 100 WHEN open_tickets <= 2 THEN 70 ELSE 30 END)::DOUBLE",
    ]
    total = " + ".join(f"coalesce({part}, 0.0::DOUBLE)" for part in parts)
    count = " + ".join(f"(CASE WHEN ({part}) IS NULL THEN 0 ELSE 1 END)" for part in parts)
    return f"trunc(({total}) / ({count}))::INTEGER"


HEALTH_MEAN = _health_mean()
HEALTH_DEDUCTION = """greatest(0, least(100, 100
  - CASE churn_risk WHEN 'High Risk' THEN 30 WHEN 'Medium Risk' THEN 15 ELSE 0 END
  - CASE WHEN days_since_last_purchase > 90 THEN 20 WHEN days_since_last_purchase > 60 THEN 10 ELSE 0 END
  - CASE WHEN open_tickets > 3 THEN 15 WHEN open_tickets > 0 THEN 5 ELSE 0 END
  + CASE WHEN lifetime_value > 5000 THEN 10 ELSE 0 END))::INTEGER"""
CHURN_PROBABILITY = """least(1.0::DOUBLE,
  CASE WHEN days_since_last_purchase > 180 THEN 0.4::DOUBLE WHEN days_since_last_purchase > 90 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN open_tickets > 3 THEN 0.3::DOUBLE WHEN open_tickets > 1 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN avg_satisfaction_score = 0 THEN 0.0::DOUBLE WHEN avg_satisfaction_score < 3.0 THEN 0.3::DOUBLE WHEN avg_satisfaction_score < 3.5 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)"""
SEGMENT_SIMPLE = "CASE WHEN p.lifetime_value > 10000 THEN 'VIP' WHEN p.lifetime_value > 5000 THEN 'High Value' WHEN p.lifetime_value > 1000 THEN 'Medium Value' ELSE 'Low Value' END"
SEGMENT_RFM = """CASE WHEN coalesce(p.lifetime_value, 0) >= 10000 AND coalesce(p.total_orders, 0) >= 10 THEN 'VIP' WHEN coalesce(p.lifetime_value, 0) >= 5000 THEN 'High Value'
  WHEN coalesce(p.lifetime_value, 0) >= 1000 THEN 'Medium Value' WHEN coalesce(p.lifetime_value, 0) >= 100 THEN 'Low Value' ELSE 'General' END"""


def _risk(policy: str, days: str, tickets: str) -> str:
    tests = {
        "simple": (f"{days} > 180 AND {tickets} > 0", f"{days} > 90"),
        "rfm_and": (f"{days} > 180 AND coalesce({tickets}, 0) > 1", f"{days} > 90 AND coalesce({tickets}, 0) > 0"),
        "rfm_or": (f"{days} > 180 OR coalesce({tickets}, 0) > 2", f"{days} > 90 OR coalesce({tickets}, 0) > 0"),
    }
    high, medium = tests[policy]
    return f"CASE WHEN {high} THEN 'High Risk' WHEN {medium} THEN 'Medium Risk' ELSE 'Low Risk' END"


_DAYS = f"date_diff('day', p.last_purchase_date::DATE, {AS_OF})::INTEGER"


def _profile_sql(policy: str) -> str:
    rich = policy != "simple"
    bought = "m_purchase_by_id p ON p.customer_id = c.customer_id" if rich else "m_purchase p ON p.customer_email = c.email"
    helped = "m_support_elapsed" if rich else "m_support"
    pages = "m_pages_recent" if rich else "m_pages"
    extra_columns = ", m.preferred_payment_methods, t.common_ticket_tags, a.acquisition_sources" if rich else ""
    extra_joins = (
        " LEFT JOIN m_payments m ON m.customer_id = c.customer_id LEFT JOIN m_tags t ON t.customer_email = c.email LEFT JOIN m_traffic a ON a.user_id = c.customer_id"
        if rich
        else ""
    )
    return f"""SELECT c.customer_id, c.email, c.first_name, c.last_name, c.phone, c.company AS account_name, c.industry, c.customer_since, c.acquisition_channel,
  coalesce(p.total_orders, 0) AS total_orders, coalesce(p.lifetime_value, 0.0::DOUBLE) AS lifetime_value, p.last_purchase_date,
  coalesce(p.avg_order_value, 0.0::DOUBLE) AS avg_order_value, '' AS purchased_product_ids,
  coalesce(s.total_tickets, 0) AS total_tickets, coalesce(s.open_tickets, 0) AS open_tickets, s.avg_resolution_hours, s.last_ticket_date, s.avg_satisfaction_score,
  coalesce(w.total_sessions, 0) AS total_sessions, coalesce(w.total_page_views, 0) AS total_page_views, w.last_visit, coalesce(v.visited_pages, '') AS visited_pages,
  {_DAYS} AS days_since_last_purchase, {SEGMENT_RFM if rich else SEGMENT_SIMPLE} AS customer_segment, {_risk(policy, _DAYS, 's.open_tickets')} AS churn_risk{extra_columns}
FROM m_customers c LEFT JOIN {bought} LEFT JOIN {helped} s ON s.customer_email = c.email
  LEFT JOIN m_web w ON w.user_id = c.customer_id LEFT JOIN {pages} v ON v.user_id = c.customer_id{extra_joins}
WHERE c.email IS NOT NULL"""


def _support_sql(hours: str) -> str:
    return f"""SELECT customer_email, count(DISTINCT ticket_id) AS total_tickets, count(DISTINCT CASE WHEN status IN ('open', 'pending') THEN ticket_id END) AS open_tickets,
  avg({hours}) AS avg_resolution_hours, max(created_at) AS last_ticket_date, avg(satisfaction_rating) AS avg_satisfaction_score
FROM m_tickets WHERE customer_email IS NOT NULL GROUP BY customer_email"""


def _purchase_sql(key: str) -> str:
    return f"""SELECT {key}, count(DISTINCT order_id) AS total_orders, sum(total_amount)::DOUBLE AS lifetime_value, max(order_date) AS last_purchase_date,
  sum(total_amount)::DOUBLE / count(total_amount) AS avg_order_value FROM m_orders WHERE {key} IS NOT NULL GROUP BY {key}"""


def _hits_sql(queries: str, corpus: str, key: str, k: int, join: str = "TRUE") -> str:
    return f"""SELECT query_id, {key}, score, rank FROM (
  SELECT query_id, {key}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM (
    SELECT q.query_id, d.{key}, round(list_cosine_similarity(d.embedding::DOUBLE[], q.query_vector::DOUBLE[]), 12) AS score
    FROM {queries} q JOIN {corpus} d ON {join} WHERE d.embedding IS NOT NULL AND d.{key} <> q.exclude_id) s) r WHERE rank <= {k}"""


def _ticket_columns(hits: str) -> str:
    return f"""SELECT h.query_id, h.rank::INTEGER AS rank, h.ticket_id::VARCHAR AS doc_id, 'support_ticket' AS source_type, h.score, t.subject AS title,
  left(t.full_text, 1000) AS content, t.created_at FROM {hits} h JOIN m_tix t USING (ticket_id)"""


def _product_columns(hits: str) -> str:
    return f"""SELECT h.query_id, h.rank::INTEGER AS rank, h.product_id::VARCHAR AS doc_id, 'product' AS source_type, h.score, p.product_name AS title,
  left(coalesce(p.full_text, ''), 500) AS content, NULL::TIMESTAMP AS created_at FROM {hits} h JOIN m_prods p USING (product_id)"""


def _contains(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{word}')" for word in words) + ")"


def _intent(question: str, known: str) -> str:
    low = f"lower({question})"
    first = " ".join(f"WHEN {_contains(low, words)} THEN '{name}'" for name, words in INTENT_WORDS)
    return f"CASE {first} WHEN {known} AND {_contains(low, CUSTOMER_INFO_WORDS)} THEN 'customer_info' ELSE 'general' END"


def _per_intent(counts: dict[str, int]) -> str:
    return "CASE intent " + " ".join(f"WHEN '{name}' THEN {count}" for name, count in counts.items()) + " END"


_TICKET_COUNT, _PRODUCT_COUNT = _per_intent(TICKETS_PER_INTENT), _per_intent(PRODUCTS_PER_INTENT)


def _numbered(hits: str, threshold: float) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE source_type WHEN 'support_ticket' THEN 0 ELSE 1 END, rank)::INTEGER AS source_no
  FROM {hits} WHERE score > {threshold}) n WHERE source_no <= 5"""


def _money(column: str) -> str:
    return f"'$' || format('{{:,.2f}}', {column})"


_NAME = "coalesce(nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), ''), 'Unknown')"


def _profile_block() -> str:
    lines = [
        ("Name", _NAME), ("Email", "email"), ("Customer ID", "customer_id::VARCHAR"), ("Segment", "customer_segment"), ("Lifetime Value", _money("lifetime_value")),
        ("Total Orders", "total_orders::VARCHAR"), ("Average Order Value", _money("avg_order_value")),
        ("Days Since Last Purchase", "coalesce(days_since_last_purchase::VARCHAR, 'None')"), ("Total Support Tickets", "total_tickets::VARCHAR"),
        ("Open Support Tickets", "open_tickets::VARCHAR"), ("Satisfaction Score", "coalesce(nullif(avg_satisfaction_score, 0)::VARCHAR, 'N/A') || '/5.0'"),
        ("Churn Risk", "churn_risk"), ("Health Score", f"({HEALTH_DEDUCTION})::VARCHAR || '/100'"),
        ("Customer Since", "coalesce(strftime(customer_since, '%Y-%m-%d %H:%M:%S'), 'None')"),
    ]
    body = " || chr(10) || ".join(f"'- {label}: ' || {value}" for label, value in lines)
    return f"CASE WHEN customer_id IS NOT NULL THEN chr(10) || 'CUSTOMER PROFILE:' || chr(10) || {body} || chr(10) END"


def _budgeted_block() -> str:
    lines = [
        ("Name", _NAME), ("Email", "email"), ("Segment", "customer_segment"), ("Lifetime Value", _money("lifetime_value")), ("Total Orders", "total_orders::VARCHAR"),
        ("Days Since Last Purchase", "coalesce(nullif(days_since_last_purchase, 0)::VARCHAR, 'N/A')"), ("Open Support Tickets", "open_tickets::VARCHAR"),
        ("Satisfaction Score", "coalesce(nullif(avg_satisfaction_score, 0)::VARCHAR, 'N/A')"), ("Churn Risk", "churn_risk"),
    ]
    body = " || chr(10) || ".join(f"'- {label}: ' || {value}" for label, value in lines)
    return f"CASE WHEN customer_id IS NOT NULL THEN chr(10) || 'Customer Context:' || chr(10) || {body} || chr(10) END"


def _blocks(sources: str) -> str:
    return f"""SELECT query_id, count(*) AS num_sources, string_agg(concat_ws(chr(10),
    chr(10) || '[Source ' || source_no || '] (' || CASE source_type WHEN 'support_ticket' THEN 'Support Ticket' ELSE 'Product' END || printf(', Relevance: %.1f%%)', score * 100),
    'Title: ' || nullif(title, ''), 'Date: ' || strftime(created_at, '%Y-%m-%d %H:%M:%S'), 'Content: ' || left(content, 800)), chr(10) ORDER BY source_no) AS blocks
  FROM {sources} GROUP BY query_id"""


def _prompt(question: str) -> str:
    return f"""concat_ws(chr(10), {_text(PROMPT_INSTRUCTIONS)}, {_profile_block()},
  CASE WHEN blocks IS NOT NULL THEN chr(10) || 'RELEVANT HISTORICAL DATA:' || chr(10) || blocks END, chr(10) || 'USER QUERY: ' || {question}, {_text(PROMPT_CLOSING)})"""


_WORDS = "regexp_split_to_array"
_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_DAILY_ROUND = "round((sum(sentiment_score::DECIMAL(18,6))::DOUBLE / count(sentiment_score))::VARCHAR::DECIMAL(38,22), 3)::DOUBLE"
_PRESETS = " UNION ALL ".join(
    f"SELECT {_text(name)} AS preset, {place} AS place, {_text(question)} AS query_text" for place, (name, question) in enumerate(sorted(PRESET_QUESTIONS.items()))
)
_RULES = [
    "lifetime_value >= 0", "total_orders >= 0", "avg_order_value >= 0", "total_sessions >= 0", "total_page_views >= 0", "open_tickets >= 0", "total_tickets >= 0",
]
_SCORES = ["overall_score", "recency_score", "frequency_score", "monetary_score", "satisfaction_score", "support_health_score"]

SHARED: dict[str, str] = {
    "m_orders": f"SELECT o_orderkey AS order_id, o_custkey AS customer_id, {_email('o_custkey')} AS customer_email, o_orderdate AS order_date, o_orderstatus AS status, (o_totalprice::DECIMAL(18,2) * 0.002)::DECIMAL(22,5) AS total_amount, o_orderpriority AS payment_method FROM orders",
    "m_items": "SELECT l_orderkey AS order_id, count(*) AS num_items FROM lineitem GROUP BY 1",
    "m_customers": f"SELECT c_custkey AS customer_id, {_email('c_custkey')} AS email, 'Customer' AS first_name, lpad(c_custkey::VARCHAR, 9, '0') AS last_name, NULL::VARCHAR AS phone, NULL::VARCHAR AS company, c_mktsegment AS industry, (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS customer_since, r_name AS acquisition_channel, 'Active' AS account_status FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
    "m_tickets": f"""SELECT doc_id AS ticket_id, {_OWNER} AS customer_id, {_email(_OWNER)} AS customer_email, left(text, 40) AS subject, text AS description,
  CASE (doc_id // 11) % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'pending' ELSE 'solved' END AS status, CASE WHEN doc_id % 5 < 2 THEN 'low' WHEN doc_id % 5 < 4 THEN 'medium' ELSE 'high' END AS priority,
  {_START} + to_hours((doc_id % 5000)::INTEGER) AS created_at, CASE WHEN (doc_id // 11) % 3 = 2 THEN {_START} + to_hours((doc_id % 5000 + 1 + doc_id % 72)::INTEGER) END AS resolved_at,
  CASE WHEN (doc_id // 11) % 3 = 2 THEN 1 + doc_id % 72 END AS resolution_time_hours, CASE WHEN (doc_id // 11) % 3 = 2 THEN 1 + doc_id % 5 END AS satisfaction_rating, concat_ws('|', lang, source) AS tags FROM documents""",
    "m_tix": f"SELECT t.*, {_ticket_text('subject', 'description')} AS full_text, e.embedding FROM m_tickets t LEFT JOIN embeddings e ON e.vec_id = t.ticket_id",
    "m_products": "SELECT p_partkey AS product_id, p_name AS product_name, p_brand || ' ' || p_type AS description, p_type AS category, p_retailprice AS price FROM part",
    "m_prods": "SELECT p.*, 'Product: ' || product_name || chr(10) || 'Category: ' || coalesce(category, 'General') || chr(10) || 'Description: ' || coalesce(description, '') || chr(10) || 'Price: $' || price::DECIMAL(18,2)::VARCHAR AS full_text, e.embedding FROM m_products p LEFT JOIN embeddings e ON e.vec_id = p.product_id",
    "m_events": "SELECT event_id, user_id, user_id::VARCHAR || '-' || ts::DATE::VARCHAR AS session_id, '/' || event_type AS page_path, ts AS event_timestamp, event_type AS traffic_source FROM events",
    "m_interactions": "SELECT event_id AS interaction_id, user_id AS customer_id, ts AS timestamp, event_type AS channel, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50.0::DOUBLE) / 50.0::DOUBLE)) AS sentiment_score, props AS content FROM events",
    "m_interaction_docs": "SELECT interaction_id, customer_id, timestamp, trim('Interaction ID: ' || interaction_id || chr(10) || 'Customer: ' || customer_id || chr(10) || 'Channel: ' || channel || chr(10) || 'Sentiment: ' || sentiment_score::VARCHAR || chr(10) || 'Date: ' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || chr(10) || 'Content: ' || content) AS content FROM m_interactions",
    "m_queries": f"SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS query_id, CASE conv_id % 5 WHEN 0 THEN 'Recommend a product. ' WHEN 1 THEN 'Open support ticket. ' WHEN 2 THEN 'Churn and retention. ' WHEN 3 THEN 'Profile, please. ' ELSE '' END || text AS query_text, CASE WHEN conv_id % 7 <> 6 THEN {_email(_ASKER)} END AS customer_email, CASE WHEN conv_id % 7 <> 6 THEN {_ASKER} END AS asker_id, conv_id % vectors AS exclude_id, embedding AS query_vector FROM conversations CROSS JOIN (SELECT count(*) AS vectors FROM embeddings) v LEFT JOIN embeddings ON vec_id = conv_id % vectors WHERE role = 'user'",
    "m_answers": "SELECT conv_id::VARCHAR || '-' || (turn - 1)::VARCHAR AS query_id, conv_id::VARCHAR || '-' || turn::VARCHAR AS answer_id, text || ' [Source ' || (1 + turn % 7)::VARCHAR || ']' || CASE WHEN turn % 2 = 0 THEN ' [Source 1]' ELSE '' END AS answer_text, conv_id % 9 = 4 AS structured, CASE WHEN conv_id % 23 = 7 THEN 'the model took too long' END AS error, 'answer-model' AS model_used, TIMESTAMP '2001-08-02 00:00:00' + to_hours(turn::INTEGER) AS answered_at, 100 + 10 * turn AS response_time_ms FROM conversations WHERE role = 'assistant'",
    "m_purchase": _purchase_sql("customer_email"),
    "m_purchase_by_id": _purchase_sql("customer_id"),
    "m_support": _support_sql("resolution_time_hours"),
    "m_support_elapsed": _support_sql("CASE WHEN status = 'solved' THEN date_sub('hour', created_at, resolved_at) END"),
    "m_web": "SELECT user_id, count(DISTINCT session_id) AS total_sessions, count(DISTINCT event_id) AS total_page_views, max(event_timestamp) AS last_visit FROM m_events WHERE user_id IS NOT NULL GROUP BY 1",
    "m_pages": "SELECT user_id, string_agg(page_path, ', ' ORDER BY page_path) AS visited_pages FROM (SELECT user_id, page_path, row_number() OVER (PARTITION BY user_id ORDER BY page_path) AS n FROM (SELECT DISTINCT user_id, page_path FROM m_events) d) r WHERE n <= 10 GROUP BY 1",
    "m_pages_recent": "SELECT user_id, string_agg(page_path, ', ' ORDER BY n) AS visited_pages FROM (SELECT user_id, page_path, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, page_path) AS n FROM (SELECT user_id, page_path, max(event_timestamp) AS seen FROM m_events GROUP BY 1, 2) d) r WHERE n <= 10 GROUP BY 1",
    "m_payments": "SELECT customer_id, string_agg(DISTINCT payment_method, ', ' ORDER BY payment_method) AS preferred_payment_methods FROM m_orders GROUP BY 1",
    "m_tags": "SELECT customer_email, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS common_ticket_tags FROM (SELECT customer_email, unnest(string_split(tags, '|')) AS tag FROM m_tickets) u WHERE tag <> '' GROUP BY 1",
    "m_traffic": "SELECT user_id, string_agg(DISTINCT traffic_source, ', ' ORDER BY traffic_source) AS acquisition_sources FROM m_events GROUP BY 1",
    "m_profile": _profile_sql("simple"),
    "m_profile_and": _profile_sql("rfm_and"),
    "m_profile_or": _profile_sql("rfm_or"),
    "m_scores": """SELECT customer_id, days_since_last_purchase, open_tickets, total_orders, lifetime_value, avg_satisfaction_score, churn_risk, customer_segment,
  CASE WHEN days_since_last_purchase IS NULL THEN 50 WHEN days_since_last_purchase < 30 THEN 100 WHEN days_since_last_purchase < 90 THEN 75 WHEN days_since_last_purchase < 180 THEN 50 ELSE 25 END AS recency_score,
  least(100, trunc((total_orders / 10.0::DOUBLE) * 100.0::DOUBLE)::INTEGER) AS frequency_score, least(100, trunc(lifetime_value / 100.0::DOUBLE)::INTEGER) AS monetary_score,
  CASE WHEN avg_satisfaction_score IS NULL OR avg_satisfaction_score = 0 THEN 50 ELSE trunc((avg_satisfaction_score / 5.0::DOUBLE) * 100.0::DOUBLE)::INTEGER END AS satisfaction_score,
  CASE WHEN open_tickets = 0 THEN 100 WHEN open_tickets <= 2 THEN 70 ELSE 30 END AS support_health_score FROM m_profile""",
    "m_detailed": "SELECT *, trunc(recency_score * 0.25::DOUBLE + frequency_score * 0.20::DOUBLE + monetary_score * 0.25::DOUBLE + satisfaction_score * 0.15::DOUBLE + support_health_score * 0.15::DOUBLE)::INTEGER AS overall_score FROM m_scores",
    "m_daily": f"SELECT customer_id, date, avg_sentiment, interactions FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY date DESC) AS n FROM (SELECT customer_id, timestamp::DATE AS date, {_DAILY_ROUND} AS avg_sentiment, count(*) AS interactions FROM m_interactions WHERE timestamp >= {EVENTS_AS_OF} - INTERVAL 90 DAY GROUP BY 1, 2) d) r WHERE n <= 30",
    "m_trend": """SELECT *, CASE WHEN spread > 0.5 THEN 'volatile' WHEN slope > 0.005 THEN 'improving' WHEN slope < -0.005 THEN 'declining' ELSE 'stable' END AS trend FROM (
  SELECT customer_id, arg_max(avg_sentiment, date) AS latest_avg_sentiment, round(CASE WHEN count(*) > 1 THEN regr_slope(avg_sentiment, (date - DATE '2024-01-31')::DOUBLE) END, 6) AS slope, round(stddev_pop(avg_sentiment), 6) AS spread, count(*) AS days, sum(interactions)::BIGINT AS interactions FROM m_daily GROUP BY 1) s""",
    "m_context": f"""SELECT customer_id, 1 AS source_no, 'SENTIMENT_SUMMARY' AS doc_id, 'Customer ' || customer_id || ' Sentiment Analysis:' || chr(10) || 'Summary: ' || trend || chr(10) || 'Latest Average Score: ' || latest_avg_sentiment::VARCHAR AS content FROM m_trend
  UNION ALL SELECT customer_id, (n + 1)::INTEGER, interaction_id::VARCHAR, content FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY timestamp DESC, interaction_id) AS n FROM m_interaction_docs WHERE timestamp >= {EVENTS_AS_OF} - INTERVAL 30 DAY) r WHERE n <= 5""",
    "m_context_blocks": "SELECT customer_id, string_agg('--- SOURCE ' || source_no || ' ---' || chr(10) || content || chr(10) || '--- END SOURCE ' || source_no || ' ---' || chr(10), chr(10) ORDER BY source_no) AS context_block, count(*) AS sources FROM m_context GROUP BY 1",
    "m_asked": f"SELECT *, {_intent('query_text', 'customer_known')} AS intent FROM (SELECT q.*, c.customer_id IS NOT NULL AS customer_known FROM m_queries q LEFT JOIN m_customers c ON lower(c.email) = lower(q.customer_email)) k",
    "m_owned": _hits_sql("m_asked", "m_tix", "ticket_id", 5, "lower(d.customer_email) = lower(q.customer_email)"),
    "m_open_queries": "SELECT * FROM m_asked WHERE customer_email IS NULL",
    "m_anyone": _hits_sql("m_open_queries", "m_tix", "ticket_id", 5),
    "m_goods": _hits_sql("m_asked", "m_prods", "product_id", 5),
    "m_ticket_hits": "SELECT * FROM m_owned UNION ALL SELECT * FROM m_anyone",
    "m_found": f"SELECT f.* FROM ({_ticket_columns('m_ticket_hits')}) f JOIN m_asked a USING (query_id) WHERE f.rank <= {_TICKET_COUNT} UNION ALL SELECT f.* FROM ({_product_columns('m_goods')}) f JOIN m_asked a USING (query_id) WHERE f.rank <= {_PRODUCT_COUNT}",
    "m_sources": _numbered("m_found", 0.3),
    "m_blocks": _blocks("m_sources"),
    "m_offered": "SELECT customer_id, source_no, doc_id FROM m_context UNION ALL SELECT DISTINCT asker_id, 1, 'SENTIMENT_SUMMARY' FROM m_queries WHERE asker_id IS NOT NULL AND asker_id NOT IN (SELECT customer_id FROM m_context)",
    "m_label_means": "SELECT label, list(mean ORDER BY i) AS query_vector FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) m GROUP BY 1",
    "m_presets": f"SELECT p.*, {_intent('query_text', 'TRUE')} AS intent, query_vector, -1 AS exclude_id FROM ({_PRESETS}) p LEFT JOIN m_label_means ON label = place",
    "m_preset_asked": "SELECT preset || ':' || customer_id AS query_id, p.preset, p.query_text, p.intent, p.query_vector, -1 AS exclude_id, f.* FROM m_profile f CROSS JOIN m_presets p",
    "m_preset_tickets": "SELECT * FROM m_preset_asked WHERE intent <> 'product_recommendation'",
    "m_preset_owned": _hits_sql("m_preset_tickets", "m_tix", "ticket_id", 5, "lower(d.customer_email) = lower(q.email)"),
    "m_preset_named": "SELECT preset AS query_id, query_vector, exclude_id, intent FROM m_presets",
    "m_preset_goods": _hits_sql("m_preset_named", "m_prods", "product_id", 5),
    "m_preset_found": f"SELECT f.* FROM ({_ticket_columns('m_preset_owned')}) f JOIN m_preset_asked a USING (query_id) WHERE f.rank <= {_TICKET_COUNT} UNION ALL SELECT a.query_id, f.* EXCLUDE (query_id) FROM ({_product_columns('m_preset_goods')}) f JOIN m_preset_asked a ON a.preset = f.query_id WHERE f.rank <= {_PRODUCT_COUNT}",
    "m_preset_sources": _numbered("m_preset_found", 0.15),
    "m_preset_blocks": _blocks("m_preset_sources"),
    "m_pairs": f"""SELECT l.customer_id AS query_id, l.customer_id AS left_id, r.customer_id AS right_id, l.email AS customer_email, 'churn_analysis' AS intent, embedding AS query_vector, -1 AS exclude_id,
  {_text(COMPARE_QUESTION)} || chr(10) || 'Customer 1: Customer ' || l.last_name || ' (' || l.email || ')' || chr(10) || 'Customer 2: Customer ' || r.last_name || ' (' || r.email || ')' AS query_text
  FROM m_customers l JOIN m_customers r ON r.customer_id = l.customer_id + 1 CROSS JOIN (SELECT count(*) AS vectors FROM embeddings) v LEFT JOIN embeddings ON vec_id = l.customer_id % vectors""",
    "m_pair_owned": _hits_sql("m_pairs", "m_tix", "ticket_id", 3, "lower(d.customer_email) = lower(q.customer_email)"),
    "m_pair_found": _ticket_columns("m_pair_owned"),
    "m_pair_sources": _numbered("m_pair_found", 0.0),
    "m_pair_blocks": _blocks("m_pair_sources"),
    "m_profile_blocks": f"SELECT customer_id, {_profile_block()} AS block FROM m_profile",
    "m_vectors": "SELECT vec_id AS query_id, vec_id AS exclude_id, embedding AS query_vector FROM embeddings",
    "m_slots": "SELECT ticket_id, ('0x' || left(md5(word), 8))::BIGINT % 64 AS slot, sum(CASE WHEN ('0x' || substr(md5(word), 9, 2))::BIGINT < 128 THEN 1 ELSE -1 END) AS weight FROM (SELECT ticket_id, unnest(regexp_split_to_array(lower(full_text), '[ \\t\\r\\n]+')) AS word FROM m_tix) w WHERE word <> '' GROUP BY 1, 2",
    "m_hashed": "SELECT ticket_id, count(*) FILTER (WHERE weight <> 0)::INTEGER AS slots, round(sum(abs(weight)) / sqrt(sum(weight * weight)), 6) AS absolute_sum, round(sum(weight) / sqrt(sum(weight * weight)), 6) AS signed_sum FROM m_slots GROUP BY 1",
    "m_spoiled": "SELECT order_id, CASE WHEN order_id % 11 <> 0 THEN customer_id END AS customer_id, CASE WHEN order_id % 7 = 0 THEN -1 - total_amount ELSE total_amount END AS total_amount, order_date FROM m_orders",
    "m_watermark": "SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS passed FROM events",
    "m_centres": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS list_id, embedding::DOUBLE[] AS centre FROM (SELECT * FROM embeddings WHERE vec_id % greatest(1, (SELECT count(*) // 100 FROM embeddings)) = 0 ORDER BY vec_id LIMIT 100) c",
    "m_assigned": "SELECT ticket_id, list_id FROM (SELECT ticket_id, list_id, row_number() OVER (PARTITION BY ticket_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], centre), 12) DESC, list_id) AS n FROM m_tix JOIN m_centres ON TRUE WHERE embedding IS NOT NULL) r WHERE n = 1",
    "m_probed": "SELECT query_id, list_id FROM (SELECT query_id, list_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(query_vector::DOUBLE[], centre), 12) DESC, list_id) AS n FROM m_queries JOIN m_centres ON TRUE) r WHERE n <= 75",
    "m_near": _hits_sql("(SELECT * FROM m_queries JOIN m_probed USING (query_id))", "(SELECT * FROM m_tix JOIN m_assigned USING (ticket_id))", "ticket_id", 5, "d.list_id = q.list_id"),
    "m_any": _hits_sql("m_queries", "m_tix", "ticket_id", 5),
    "m_closed": "SELECT * FROM m_events WHERE event_timestamp::DATE + INTERVAL 1 DAY <= (SELECT passed FROM m_watermark)",
}

_CHUNK_END = """CASE WHEN {s} + 1024 >= n THEN {s} + 1024 ELSE {s} + 1024 - (CASE
  WHEN greatest({s}, {s} + 824) + length(substr(text, ({s} + 824 + 1)::BIGINT, 200)) - 1 - length(regexp_extract(substr(text, ({s} + 824 + 1)::BIGINT, 200), '[^.?!]*$')) > {s}
   AND length(regexp_extract(substr(text, ({s} + 824 + 1)::BIGINT, 200), '[^.?!]*$')) < length(substr(text, ({s} + 824 + 1)::BIGINT, 200))
  THEN length(regexp_extract(substr(text, ({s} + 824 + 1)::BIGINT, 200), '[^.?!]*$')) ELSE 0 END) END"""

BODIES: dict[str, str] = {
    "customer_360": "SELECT * FROM m_profile",
    "customer_360_rfm": "SELECT * FROM m_profile_and",
    "customer_360_rfm_or": "SELECT * FROM m_profile_or",
    "purchase_metrics": "SELECT * FROM m_purchase",
    "purchase_metrics_incremental": "SELECT * FROM m_purchase",
    "support_metrics": "SELECT * FROM m_support",
    "web_metrics": "SELECT * FROM m_web JOIN m_pages USING (user_id)",
    "ticket_status_counts": "SELECT customer_email, count(*) AS total_tickets, sum(CASE WHEN status IN ('open', 'pending') THEN 1 ELSE 0 END)::BIGINT AS open_tickets, sum(CASE WHEN status = 'solved' THEN 1 ELSE 0 END)::BIGINT AS solved_tickets FROM m_tickets GROUP BY 1",
    "resolution_hours": "SELECT customer_email, avg(date_sub('hour', created_at, resolved_at)) AS avg_resolution_hours, count(resolved_at) AS resolved_tickets FROM m_tickets GROUP BY 1",
    "ticket_tag_counts": "SELECT tag, count(*) AS tickets FROM (SELECT unnest(string_split(tags, '|')) AS tag FROM m_tickets) u WHERE tag <> '' GROUP BY 1",
    "recent_pages": "SELECT * FROM m_pages_recent",
    "preferred_payment_methods": "SELECT * FROM m_payments",
    "acquisition_sources": "SELECT * FROM m_traffic",
    "orders_left_grouped": "SELECT c.customer_id, c.email, count(DISTINCT o.order_id) AS total_orders, coalesce(sum(o.total_amount)::DOUBLE, 0) AS lifetime_value, coalesce(sum(o.total_amount)::DOUBLE / nullif(count(o.total_amount), 0), 0) AS avg_order_value, max(o.order_date) AS last_purchase_date FROM m_customers c LEFT JOIN m_orders o ON o.customer_id = c.customer_id GROUP BY 1, 2",
    "recent_orders": "SELECT customer_id, rank::INTEGER AS rank, order_id, order_date, total_amount::DOUBLE AS total_amount, status, coalesce(num_items, 0) AS num_items FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id) AS rank FROM m_orders) r LEFT JOIN m_items USING (order_id) WHERE rank <= 3",
    "recent_tickets": "SELECT customer_id, rank::INTEGER AS rank, ticket_id, created_at, subject, status, priority, satisfaction_rating FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, ticket_id) AS rank FROM m_tickets) r WHERE rank <= 3",
    "churn_risk_summary": "SELECT churn_risk, count(*) AS customer_count, sum(lifetime_value::DECIMAL(28,6))::DOUBLE / count(*) AS avg_ltv, avg(days_since_last_purchase) AS avg_days_inactive FROM m_profile GROUP BY 1",
    "customer_segments": "SELECT customer_segment, count(*) AS customer_count, sum(lifetime_value::DECIMAL(28,6))::DOUBLE / count(*) AS avg_ltv, avg(total_orders) AS avg_orders FROM m_profile GROUP BY 1",
    "view_health_check": "SELECT count(*) AS customer_count, count(DISTINCT customer_segment) AS segments, count(DISTINCT churn_risk) AS risk_levels FROM m_profile",
    "dataset_summary": """SELECT 'rows_customers' AS metric, count(*)::DOUBLE AS value FROM m_customers UNION ALL SELECT 'rows_products', count(*)::DOUBLE FROM m_products
  UNION ALL SELECT 'rows_orders', count(*)::DOUBLE FROM m_orders UNION ALL SELECT 'rows_tickets', count(*)::DOUBLE FROM m_tickets UNION ALL SELECT 'rows_events', count(*)::DOUBLE FROM m_events
  UNION ALL SELECT 'revenue', sum(total_amount)::DOUBLE FROM m_orders UNION ALL SELECT 'avg_order_value', sum(total_amount)::DOUBLE / count(total_amount) FROM m_orders
  UNION ALL SELECT 'open_tickets', count(*)::DOUBLE FROM m_tickets WHERE status = 'open' UNION ALL SELECT 'avg_satisfaction', avg(satisfaction_rating) FROM m_tickets""",
    "kpi_tiles": f"SELECT count(*) AS total_customers, sum(lifetime_value::DECIMAL(28,6))::DOUBLE / count(*) AS avg_ltv, count(*) FILTER (WHERE churn_risk = 'High Risk') / count(*) AS churn_rate, count(*) FILTER (WHERE churn_risk = 'High Risk') AS high_risk_customers, sum(avg_satisfaction_score::DECIMAL(28,9))::DOUBLE / count(avg_satisfaction_score) AS avg_satisfaction, avg({HEALTH_MEAN}) AS avg_health_score FROM m_profile",
    "daily_trends": f"""SELECT d.day, coalesce(n.c, 0) AS new_customers, coalesce(l.churned, 0) AS churned_customers, l.ltv AS avg_ltv
FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', {AS_OF}::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day) d
LEFT JOIN (SELECT customer_since::DATE AS day, count(*) AS c FROM m_profile GROUP BY 1) n USING (day)
LEFT JOIN (SELECT last_purchase_date::DATE AS day, count(*) FILTER (WHERE churn_risk = 'High Risk') AS churned, sum(lifetime_value::DECIMAL(28,6))::DOUBLE / count(lifetime_value) AS ltv FROM m_profile GROUP BY 1) l USING (day)""",
    "customer_timeline": """SELECT c.customer_id, d.day, coalesce(o.n, 0) AS purchases, coalesce(t.n, 0) AS tickets FROM m_customers c
CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2001-06-21', TIMESTAMP '2001-07-20', INTERVAL 1 DAY))::DATE AS day) d
LEFT JOIN (SELECT customer_id, order_date::DATE AS day, count(*) AS n FROM m_orders GROUP BY 1, 2) o ON o.customer_id = c.customer_id AND o.day = d.day
LEFT JOIN (SELECT customer_id, created_at::DATE AS day, count(*) AS n FROM m_tickets GROUP BY 1, 2) t ON t.customer_id = c.customer_id AND t.day = d.day""",
    "embedding_stats": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS total_rows, count(embedding) AS rows_with_embeddings, count(*) - count(embedding) AS rows_without_embeddings, round(count(embedding)::DOUBLE / count(*) * 100, 2) AS completion_percentage FROM {table}"
        for name, table in (("support_tickets", "m_tix"), ("product_catalog", "m_prods"))
    ),
    "embedding_dim_audit": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, len(embedding)::INTEGER AS dimension, count(*) AS count, len(embedding) = 64 AS as_expected FROM {table} WHERE embedding IS NOT NULL GROUP BY len(embedding)"
        for name, table in (("support_tickets", "m_tix"), ("product_catalog", "m_prods"))
    ),
    "segments_rfm": "SELECT customer_id, total_orders, lifetime_value, customer_segment FROM m_profile_and",
    "churn_policies": "SELECT customer_id, days_since_last_purchase, open_tickets, "
    + ", ".join(f"{_risk(policy, 'days_since_last_purchase', 'open_tickets')} AS {policy}" for policy in ("simple", "rfm_and", "rfm_or"))
    + " FROM m_profile",
    "health_score_mean": f"SELECT customer_id, {HEALTH_MEAN} AS health_score FROM m_profile",
    "health_score_detailed": """SELECT customer_id, recency_score, frequency_score, monetary_score, satisfaction_score, support_health_score, overall_score,
  CASE WHEN overall_score >= 80 THEN 'improving' WHEN overall_score < 60 THEN 'declining' ELSE 'stable' END AS trend,
  concat_ws(', ', CASE WHEN days_since_last_purchase > 90 THEN 'No purchases in 90+ days' END, CASE WHEN open_tickets > 2 THEN 'Multiple open support tickets' END,
    CASE WHEN avg_satisfaction_score <> 0 AND avg_satisfaction_score < 3.5 THEN 'Low satisfaction score' END, CASE WHEN churn_risk = 'High Risk' THEN 'High churn risk identified' END) AS risk_factors,
  concat_ws(', ', CASE WHEN lifetime_value > 10000 THEN 'High lifetime value' END, CASE WHEN total_orders > 20 THEN 'Frequent purchaser' END,
    CASE WHEN avg_satisfaction_score >= 4.5 THEN 'Highly satisfied customer' END, CASE WHEN customer_segment = 'VIP' THEN 'VIP customer segment' END) AS positive_factors FROM m_detailed""",
    "health_score_deduction": f"SELECT customer_id, {HEALTH_DEDUCTION} AS health_score FROM m_profile",
    "churn_probability": f"SELECT customer_id, {CHURN_PROBABILITY} AS churn_probability FROM m_profile",
    "customer_lookup": f"SELECT q.query_id, upper(q.customer_email) AS requested_email, p.customer_id, CASE WHEN p.customer_id IS NOT NULL THEN {_NAME} END AS name, customer_segment, churn_risk, lifetime_value, total_orders, open_tickets FROM m_queries q LEFT JOIN m_profile p ON lower(p.email) = lower(q.customer_email) WHERE q.customer_email IS NOT NULL",
    "similar_customers": """SELECT query_id, email, name, segment, distance, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, email) AS rank FROM (
  SELECT q.query_id, p.email, trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')) AS name, customer_segment AS segment, levenshtein(lower(p.email), lower(left(q.customer_email, 16) || '@example.com'))::INTEGER AS distance
  FROM m_queries q JOIN m_profile p ON contains(lower(p.email), lower(left(q.customer_email, 16))) WHERE q.customer_email IS NOT NULL) c) r WHERE rank <= 5""",
    "top_customers": "SELECT customer_id, email, trim(first_name || ' ' || last_name) AS name, customer_segment AS segment, churn_risk, lifetime_value FROM m_profile ORDER BY lifetime_value DESC, customer_id LIMIT 100",
    "high_risk_customers": f"SELECT customer_id, {_NAME} AS name, email, lifetime_value, days_since_last_purchase, open_tickets FROM m_profile WHERE churn_risk = 'High Risk'",
    "leaderboard": f"SELECT row_number() OVER (ORDER BY lifetime_value DESC, customer_id)::INTEGER AS rank, customer_id, {_NAME} AS name, email, lifetime_value, total_orders, {HEALTH_MEAN} AS health_score FROM m_profile ORDER BY lifetime_value DESC, customer_id LIMIT 10",
    "ltv_percentile": "SELECT customer_id, lifetime_value, (count(*) OVER (ORDER BY lifetime_value RANGE UNBOUNDED PRECEDING)) / (count(*) OVER ()) * 100.0::DOUBLE AS percentile FROM m_profile",
    "compare_customers": f"""SELECT l.customer_id AS left_id, r.customer_id AS right_id, l.name AS left_name, r.name AS right_name, l.customer_segment = r.customer_segment AS same_segment, l.churn_risk = r.churn_risk AS same_risk,
  l.lifetime_value - r.lifetime_value AS value_difference, l.total_orders - r.total_orders AS order_difference, l.health - r.health AS health_difference,
  CASE WHEN l.lifetime_value >= r.lifetime_value THEN l.customer_id ELSE r.customer_id END AS more_valuable_id, CASE WHEN l.probability >= r.probability THEN l.customer_id ELSE r.customer_id END AS higher_churn_id
FROM (SELECT *, {_NAME} AS name, {HEALTH_MEAN} AS health, {CHURN_PROBABILITY} AS probability FROM m_profile) l JOIN (SELECT *, {_NAME} AS name, {HEALTH_MEAN} AS health, {CHURN_PROBABILITY} AS probability FROM m_profile) r ON r.customer_id = l.customer_id + 1""",
    "normalize_segments": """SELECT customer_id,
  CASE customer_id % 4 WHEN 0 THEN customer_segment WHEN 1 THEN upper(replace(customer_segment, ' ', '_')) WHEN 2 THEN lower(split_part(customer_segment, ' ', 1)) ELSE 'unheard of' END AS raw_segment,
  CASE customer_id % 4 WHEN 0 THEN churn_risk WHEN 1 THEN upper(replace(churn_risk, ' ', '_')) WHEN 2 THEN lower(split_part(churn_risk, ' ', 1)) ELSE 'unheard of' END AS raw_risk,
  CASE WHEN customer_id % 4 IN (0, 1) THEN customer_segment WHEN customer_id % 4 = 2 AND customer_segment IN ('VIP', 'General') THEN customer_segment ELSE 'General' END AS segment,
  CASE WHEN customer_id % 4 IN (0, 2) THEN churn_risk ELSE 'Low Risk' END AS churn_risk FROM m_profile""",
    "recency_buckets": f"""SELECT CASE WHEN last_purchase_date IS NULL THEN 'Never' WHEN days > 365 THEN (days // 365) || CASE WHEN days // 365 > 1 THEN ' years ago' ELSE ' year ago' END
  WHEN days > 30 THEN (days // 30) || CASE WHEN days // 30 > 1 THEN ' months ago' ELSE ' month ago' END WHEN days > 0 THEN days || CASE WHEN days > 1 THEN ' days ago' ELSE ' day ago' END
  WHEN seconds > 3600 THEN (seconds // 3600) || CASE WHEN seconds // 3600 > 1 THEN ' hours ago' ELSE ' hour ago' END
  WHEN seconds > 60 THEN (seconds // 60) || CASE WHEN seconds // 60 > 1 THEN ' minutes ago' ELSE ' minute ago' END ELSE 'Just now' END AS last_purchase, count(*) AS customers
FROM (SELECT last_purchase_date, date_sub('second', last_purchase_date, TIMESTAMP '2001-08-02 12:00:00') // 86400 AS days, date_sub('second', last_purchase_date, TIMESTAMP '2001-08-02 12:00:00') % 86400 AS seconds FROM m_profile) a GROUP BY 1""",
    "ingest_orders_typed": "SELECT order_id::VARCHAR AS order_id, customer_id::VARCHAR AS customer_id, customer_email, order_date, status, total_amount::DOUBLE AS total_amount, coalesce(num_items, 0) AS num_items, NULL::VARCHAR AS shipping_address, payment_method FROM m_orders LEFT JOIN m_items USING (order_id)",
    "partition_pruned_tickets": "SELECT created_at::DATE AS created_date, status, count(*) AS tickets, count(embedding) AS embedded, sum(length(full_text))::BIGINT AS chars FROM m_tix WHERE created_at >= DATE '2001-02-01' AND created_at < DATE '2001-04-01' GROUP BY 1, 2",
    "clustered_ticket_lookup": "SELECT ticket_id, customer_email, status, created_at::DATE AS created_date, length(full_text)::INTEGER AS chars FROM m_tix WHERE customer_email = (SELECT customer_email FROM m_tix WHERE customer_email IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "merge_insert_new_tickets": f"SELECT ticket_id, customer_email, CASE WHEN l.doc_id IS NULL THEN status ELSE 'archived' END AS status, CASE WHEN l.doc_id IS NULL THEN 'arrived' ELSE 'known' END AS origin, length(full_text)::INTEGER AS chars FROM m_tix LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = ticket_id",
    "merge_insert_new_products": "SELECT product_id, product_name, CASE WHEN embedding IS NULL THEN category ELSE 'kept' END AS category, price, full_text FROM m_prods",
    "merge_update_embeddings": "SELECT t.ticket_id, round(coalesce(u.embedding[1], t.embedding[1])::DOUBLE, 6) AS first_component, CASE WHEN u.vec_id IS NOT NULL THEN 'second' END AS embedding_model, CASE WHEN u.vec_id IS NOT NULL THEN TIMESTAMP '2001-08-02 00:00:00' END AS embedded_at FROM m_tix t LEFT JOIN embeddings u ON u.vec_id * 2 = t.ticket_id",
    "incremental_load": "SELECT ticket_id, customer_email, status, created_at, CASE WHEN toxic = 0 THEN 'first' WHEN toxic IS NOT NULL THEN 'second' ELSE 'third' END AS landing FROM m_tickets LEFT JOIN labels ON doc_id = ticket_id",
    "embedding_backlog": "SELECT ticket_id AS doc_id, full_text AS content FROM m_tix WHERE embedding IS NULL AND full_text IS NOT NULL AND length(full_text) > 10",
    "interaction_records": f"""SELECT a.answer_id, q.asker_id AS customer_id, q.query_text AS query, coalesce({_text(INTERACTION_ERROR)} || a.error, a.answer_text) AS final_answer,
  coalesce((SELECT string_agg(c.source_no || '=' || c.doc_id, ', ' ORDER BY c.source_no) FROM m_offered c WHERE c.customer_id = q.asker_id AND a.error IS NULL AND contains(a.answer_text, '[Source ' || c.source_no || ']')), '') AS citations,
  t.trend, t.latest_avg_sentiment, (SELECT count(*) FROM m_offered c WHERE c.customer_id = q.asker_id) AS sources_used, a.response_time_ms, CASE WHEN a.error IS NULL THEN 'success' ELSE 'error' END AS status
FROM m_answers a JOIN m_queries q USING (query_id) LEFT JOIN m_trend t ON t.customer_id = q.asker_id WHERE q.asker_id IS NOT NULL""",
    "embedding_job": "SELECT number, count(*) AS total_rows, count(*) FILTER (CASE number WHEN 1 THEN embedding IS NOT NULL ELSE embedding IS NOT NULL OR length(full_text) > 10 END) AS rows_with_embeddings FROM m_tix, (SELECT unnest([1, 2, 3]) AS number) v GROUP BY 1",
    "product_table": "SELECT product_id, product_name, category, price, full_text, len(embedding)::INTEGER AS dimension FROM m_prods",
    "embedding_backfill": """SELECT ticket_id, slots, absolute_sum, signed_sum, 'hashing-words' AS embedding_model FROM m_hashed SEMI JOIN (SELECT ticket_id FROM m_tix WHERE embedding IS NULL) b USING (ticket_id)
  UNION ALL SELECT ticket_id, len(list_filter(embedding, lambda x: x <> 0))::INTEGER, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 6), round(list_sum(embedding::DOUBLE[]), 6), NULL FROM m_tix WHERE embedding IS NOT NULL""",
    "reembed_full": "SELECT *, 'hashing-words' AS embedding_model FROM m_hashed",
    "ticket_documents": "SELECT ticket_id, full_text FROM m_tix",
    "product_documents": "SELECT product_id, full_text FROM m_prods",
    "interaction_documents": "SELECT interaction_id, customer_id, content FROM m_interaction_docs",
    "sanitize_corpus": f"SELECT doc_id, trim(CASE WHEN length(t) > 100000 THEN left(t, 100000) || '...' ELSE t END) AS clean_text FROM (SELECT doc_id, replace(trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')), chr(0), '') AS t FROM documents) c",
    "document_keywords": f"""SELECT doc_id, keyword, occurrences, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY occurrences DESC, place) AS rank FROM (
  SELECT doc_id, keyword, count(*) AS occurrences, min(place) AS place FROM (SELECT doc_id, place, trim(word, {_text(WORD_PUNCTUATION)}) AS keyword FROM (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM (SELECT doc_id, regexp_split_to_array(lower(text), '{_SPACE}') AS words FROM documents) a) b) c
  WHERE length(keyword) > 3 AND keyword NOT IN ({', '.join(_text(word) for word in STOP_WORDS)}) GROUP BY 1, 2) d) e WHERE rank <= 10""",
    "token_budget": "SELECT source, count(*) AS documents, sum(length(text) // 4)::BIGINT AS estimated_tokens, count(*) FILTER (WHERE length(text) > 2048) AS over_budget, sum(CASE WHEN length(text) <= 2048 THEN length(text) ELSE 2051 END)::BIGINT AS kept_chars FROM documents GROUP BY 1",
    "email_quality": f"SELECT acquisition_channel, count(*) AS customers, count(*) FILTER (WHERE regexp_matches(email, '{EMAIL_PATTERN}')) AS valid_emails, count(*) FILTER (WHERE NOT regexp_matches(email, '{EMAIL_PATTERN}')) AS invalid_emails, count(*) FILTER (WHERE email IS NULL) AS missing_emails FROM m_customers GROUP BY 1",
    "constraint_violations": " UNION ALL ".join(
        [f"SELECT count(*) AS rows_checked, '{rule}' AS rule, count(*) FILTER (WHERE NOT coalesce({rule}, FALSE)) AS violations FROM m_profile" for rule in _RULES]
        + ["SELECT count(*), 'satisfaction in 0..5', count(*) FILTER (WHERE avg_satisfaction_score NOT BETWEEN 0 AND 5) FROM m_profile"]
        + [f"SELECT count(*), '{name} in 0..100', count(*) FILTER (WHERE NOT coalesce({name} BETWEEN 0 AND 100, FALSE)) FROM m_detailed" for name in _SCORES]
        + [f"SELECT count(*), 'similarity in 0..1', count(*) FILTER (WHERE score NOT BETWEEN 0 AND 1) FROM ({_hits_sql('m_queries', 'm_tix', 'ticket_id', 5)}) h"]
    ),
    "recent_interactions": f"SELECT * FROM m_interactions WHERE timestamp >= {EVENTS_AS_OF} - INTERVAL 30 DAY ORDER BY timestamp DESC, interaction_id LIMIT 100",
    "checked_load": "SELECT order_id, customer_id, total_amount::DOUBLE AS total_amount, concat_ws(', ', CASE WHEN NOT coalesce(total_amount >= 0, FALSE) THEN 'amount >= 0' END, CASE WHEN customer_id IS NULL THEN 'customer known' END, CASE WHEN NOT coalesce(order_date < DATE '2001-06-01', FALSE) THEN 'dated' END) AS broken_rules FROM m_spoiled",
    "checked_load_report": " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) AS rows_checked, count(*) FILTER (WHERE NOT coalesce({test}, FALSE)) AS violations FROM m_spoiled"
        for name, test in (("amount >= 0", "total_amount >= 0"), ("customer known", "customer_id IS NOT NULL"), ("dated", "order_date < DATE '2001-06-01'"))
    ),
    "daily_sentiment": "SELECT * FROM m_daily",
    "sentiment_trend": "SELECT * FROM m_trend",
    "customer_docs": "SELECT interaction_id, customer_id, content FROM m_interaction_docs SEMI JOIN (SELECT asker_id AS customer_id FROM m_queries WHERE customer_email IS NOT NULL) a USING (customer_id)",
    "customer_docs_containing": """SELECT d.interaction_id, a.wanted_id FROM m_interaction_docs d
  JOIN (SELECT DISTINCT asker_id::VARCHAR AS wanted_id FROM m_queries WHERE customer_email IS NOT NULL) a ON contains(d.content, a.wanted_id)""",
    "combined_context": "SELECT * FROM m_context",
    "context_blocks": "SELECT * FROM m_context_blocks",
    "sentiment_prompts": f"""SELECT customer_id, {_text(SENTIMENT_OPENING)} || customer_id || ':' || chr(10) || chr(10) || '[' || string_agg('{{"date": "' || date::VARCHAR || '", "avg_sentiment": ' || avg_sentiment::VARCHAR || ', "interactions": ' || interactions || '}}', ', ' ORDER BY date DESC)
  || ']' || chr(10) || chr(10) || {_text(SENTIMENT_CLOSING)} AS prompt FROM m_daily GROUP BY 1""",
    "analyst_prompts": f"""SELECT q.query_id, q.asker_id AS customer_id, {_text(ANALYST_OPENING)} || coalesce(b.context_block, '--- SOURCE 1 ---' || chr(10) || 'Customer ' || q.asker_id || ' Sentiment Analysis:' || chr(10) || 'Summary: None' || chr(10) || 'Latest Average Score: None' || chr(10) || '--- END SOURCE 1 ---' || chr(10))
  || {_text(ANALYST_QUERY)} || q.query_text || {_text(ANALYST_CLOSING)} AS prompt FROM m_queries q LEFT JOIN m_context_blocks b ON b.customer_id = q.asker_id WHERE q.asker_id IS NOT NULL""",
    "lookup_suggestions": """SELECT query_id, email, name, segment, distance, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, email) AS rank FROM (
  SELECT q.query_id, p.email, trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')) AS name, customer_segment AS segment, levenshtein(lower(p.email), lower(q.search))::INTEGER AS distance
  FROM (SELECT query_id, CASE WHEN split_part(query_id, '-', 2) = '0' THEN left(customer_email, 16) || '@example.com' ELSE customer_email END AS search FROM m_queries WHERE customer_email IS NOT NULL) q
  JOIN m_profile p ON contains(lower(p.email), lower(split_part(q.search, '@', 1))) WHERE NOT EXISTS (SELECT 1 FROM m_customers c WHERE lower(c.email) = lower(q.search))) c) r WHERE rank <= 3""",
    "sessionize": """SELECT user_id, session_no, min(event_timestamp) AS session_start, max(event_timestamp) AS session_end, count(*) AS events FROM (
  SELECT user_id, event_timestamp, sum(starts) OVER (PARTITION BY user_id ORDER BY event_timestamp, event_id)::BIGINT AS session_no FROM (
    SELECT *, CASE WHEN event_timestamp - lag(event_timestamp) OVER (PARTITION BY user_id ORDER BY event_timestamp, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM m_events) a) b GROUP BY 1, 2""",
    "ticket_search": f"SELECT query_id, rank, doc_id, source_type, round(score, 6) AS similarity_score, title, content FROM ({_ticket_columns('(' + _hits_sql('m_queries', 'm_tix', 'ticket_id', 5) + ')')}) f",
    "ticket_search_customer": f"SELECT query_id, rank, doc_id, source_type, round(score, 6) AS similarity_score, title, content FROM ({_ticket_columns('m_owned')}) f",
    "product_search": f"SELECT query_id, rank, doc_id, source_type, round(score, 6) AS similarity_score, title, content FROM ({_product_columns('m_goods')}) f",
    "batch_search": f"SELECT query_id, rank::INTEGER AS rank, ticket_id, round(score, 6) AS similarity_score FROM ({_hits_sql('m_vectors', 'm_tix', 'ticket_id', 10)}) h",
    "ann_search": "SELECT query_id, rank::INTEGER AS rank, ticket_id, round(score, 6) AS similarity_score FROM m_near",
    "ann_recall": """SELECT round((SELECT count(*) FROM m_any a JOIN m_near n USING (query_id, ticket_id)) / (SELECT count(*) FROM m_any), 6) AS recall, (SELECT count(*) FROM m_any) AS exact_hits, 100 AS lists, 75 AS probes,
  round((SELECT count(*) FROM m_probed JOIN m_assigned USING (list_id)) / ((SELECT count(*) FROM m_queries) * (SELECT count(*) FROM m_assigned)), 6) AS share_read""",
    "parsed_recommendations": """SELECT answer_id, NOT json_valid(answer) AS parse_failed, CASE WHEN json_valid(answer) THEN json_array_length(answer)::INTEGER END AS recommendations, CASE WHEN json_valid(answer) THEN answer::JSON->0->>'product_name' END AS product_name,
  CASE WHEN json_valid(answer) THEN (answer::JSON->0->>'price')::DOUBLE END AS price, CASE WHEN json_valid(answer) THEN answer::JSON->0->>'reason' END AS reason, CASE WHEN json_valid(answer) THEN answer::JSON->0->>'image_url' END AS image_url
FROM (SELECT p_partkey AS answer_id, CASE p_partkey % 3 WHEN 0 THEN to_json([r, r])::VARCHAR WHEN 1 THEN '[{"p_' ELSE 'None today.' END AS answer FROM (SELECT p_partkey, struct_pack(product_id := p_partkey::VARCHAR, product_name := p_name, price := p_retailprice, reason := 'it fits', image_url := 'part.png') AS r FROM part) i) j""",
    "ann_search_exhaustive": "SELECT query_id, rank::INTEGER AS rank, product_id, round(score, 6) AS similarity_score FROM m_goods",
    "retrieval_quality": f"SELECT q.label AS query_label, count(*) AS hits, count(*) FILTER (WHERE d.label = q.label) / count(*) AS precision_at_k FROM ({_hits_sql('m_vectors', 'embeddings', 'vec_id', 5)}) h JOIN embeddings q ON q.vec_id = h.query_id JOIN embeddings d ON d.vec_id = h.vec_id GROUP BY 1",
    "query_intent": "SELECT query_id, customer_known, intent FROM m_asked",
    "retrieve_context": "SELECT query_id, source_no, source_type, doc_id, round(score, 6) AS similarity_score, title, content FROM m_sources",
    "build_prompts": f"SELECT a.query_id, {_prompt('query_text')} AS prompt, coalesce(num_sources, 0)::INTEGER AS num_sources FROM m_asked a LEFT JOIN m_profile p ON lower(p.email) = lower(a.customer_email) LEFT JOIN m_blocks b ON b.query_id = a.query_id",
    "build_prompts_budgeted": f"""SELECT a.query_id, left(concat_ws(chr(10), {_text(BUDGETED_INSTRUCTIONS)}, {_budgeted_block()}, CASE WHEN blocks IS NOT NULL THEN chr(10) || 'Relevant Historical Data:' || chr(10) || blocks END,
  chr(10) || 'User Query: ' || query_text, {_text(BUDGETED_CLOSING)}), 32000) AS prompt FROM m_asked a LEFT JOIN m_profile p ON lower(p.email) = lower(a.customer_email) LEFT JOIN (
  SELECT query_id, string_agg(chr(10) || '[Source ' || source_no || '] (' || source_type || printf(', relevance: %.2f%%)', score * 100) || chr(10) || left(content, 500), chr(10) ORDER BY source_no) AS blocks FROM m_sources GROUP BY 1) b ON b.query_id = a.query_id""",
    "extract_citations": r"SELECT a.answer_id, s.source_no AS source_id, s.doc_id, s.source_type, coalesce(s.title, '') AS title, left(s.content, 200) AS snippet, round(s.score, 6) AS similarity_score FROM (SELECT DISTINCT answer_id, query_id, unnest(regexp_extract_all(answer_text, '\[Source (\d+)\]', 1))::INTEGER AS n FROM m_answers) a JOIN m_sources s ON s.query_id = a.query_id AND s.source_no = a.n",
    "cited_literally": "SELECT a.answer_id, s.source_no AS source_id, s.doc_id, left(s.content, 200) || '...' AS snippet FROM m_answers a JOIN m_sources s ON s.query_id = a.query_id WHERE contains(a.answer_text, '[Source ' || s.source_no || ']')",
    "response_records": f"""SELECT a.answer_id, a.query_id, q.query_text AS query, coalesce({_text(APOLOGY)} || error, a.answer_text) AS answer, model_used, response_time_ms, answered_at, error, coalesce((SELECT string_agg(s.source_no || '=' || s.doc_id, ', ' ORDER BY s.source_no) FROM m_sources s WHERE s.query_id = a.query_id AND NOT a.structured AND a.error IS NULL AND contains(a.answer_text, '[Source ' || s.source_no || ']')), '') AS citations,
  q.intent, coalesce(b.num_sources, 0) AS num_sources, p.customer_id, CASE WHEN p.customer_id IS NOT NULL THEN {_NAME} END AS name, p.customer_segment AS segment, CASE WHEN p.customer_id IS NOT NULL THEN {HEALTH_DEDUCTION} END AS health_score
FROM m_answers a JOIN m_asked q ON q.query_id = a.query_id LEFT JOIN m_profile p ON lower(p.email) = lower(q.customer_email) LEFT JOIN m_blocks b ON b.query_id = a.query_id""",
    "preset_prompts": f"SELECT a.customer_id, a.preset, a.intent, coalesce(num_sources, 0)::INTEGER AS num_sources, length({_prompt('query_text')})::INTEGER AS prompt_chars, sha256({_prompt('query_text')}) AS prompt_sha256 FROM m_preset_asked a LEFT JOIN m_preset_blocks b ON b.query_id = a.query_id",
    "compare_prompts": f"""SELECT a.left_id, a.right_id, a.intent, coalesce(num_sources, 0)::INTEGER AS num_sources, concat_ws(chr(10), {_text(PROMPT_INSTRUCTIONS)}, l.block, r.block,
  CASE WHEN blocks IS NOT NULL THEN chr(10) || 'RELEVANT HISTORICAL DATA:' || chr(10) || blocks END, chr(10) || 'USER QUERY: ' || query_text, {_text(PROMPT_CLOSING)}) AS prompt
FROM m_pairs a JOIN m_profile_blocks l ON l.customer_id = a.left_id JOIN m_profile_blocks r ON r.customer_id = a.right_id LEFT JOIN m_pair_blocks b ON b.query_id = a.query_id""",
    "recommend_products": f"""SELECT query_id AS customer_id, rank::INTEGER AS rank, product_id, product_name, description, price, category, round(score, 6) AS relevance_score FROM ({_hits_sql('(SELECT customer_id AS query_id, -1 AS exclude_id, list(mean ORDER BY place) AS query_vector FROM (SELECT customer_id, place, avg(x) AS mean FROM (SELECT customer_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS place FROM (SELECT DISTINCT o_custkey AS customer_id, l_partkey AS product_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey) b JOIN m_prods USING (product_id) WHERE embedding IS NOT NULL) u GROUP BY 1, 2) m GROUP BY 1)', 'm_prods', 'product_id', 5)}) h JOIN m_products USING (product_id)""",
    "stream_incremental_load": "SELECT * FROM events",
    "stream_user_metrics": "SELECT c.*, visited_pages FROM (SELECT user_id, count(DISTINCT session_id) AS total_sessions, count(*) AS total_page_views, max(event_timestamp) AS last_visit FROM m_closed WHERE user_id IS NOT NULL GROUP BY 1) c LEFT JOIN (SELECT user_id, string_agg(page_path, ', ' ORDER BY page_path) AS visited_pages FROM (SELECT user_id, page_path, row_number() OVER (PARTITION BY user_id ORDER BY page_path) AS n FROM (SELECT DISTINCT user_id, page_path FROM m_closed) d) r WHERE n <= 10 GROUP BY 1) p USING (user_id)",
    "stream_web_metrics": "SELECT user_id, event_timestamp::DATE AS day, count(DISTINCT session_id) AS total_sessions, count(*) AS total_page_views, max(event_timestamp) AS last_visit FROM m_events WHERE event_timestamp::DATE + INTERVAL 1 DAY <= (SELECT passed FROM m_watermark) GROUP BY 1, 2",
    "stream_daily_sentiment": f"SELECT customer_id, timestamp::DATE AS date, {_DAILY_ROUND} AS avg_sentiment, count(*) AS interactions FROM m_interactions WHERE timestamp::DATE + INTERVAL 1 DAY <= (SELECT passed FROM m_watermark) GROUP BY 1, 2",
    "stream_current_metrics": "SELECT * FROM m_web LEFT JOIN m_pages USING (user_id)",
    "stream_sentiment_trend": f"""SELECT *, CASE WHEN spread > 0.5 THEN 'volatile' WHEN slope > 0.005 THEN 'improving' WHEN slope < -0.005 THEN 'declining' ELSE 'stable' END AS trend FROM (
  SELECT customer_id, arg_max(avg_sentiment, date) AS latest_avg_sentiment, round(CASE WHEN count(*) > 1 THEN regr_slope(avg_sentiment, (date - DATE '2024-01-31')::DOUBLE) END, 6) AS slope, round(stddev_pop(avg_sentiment), 6) AS spread, count(*) AS days, sum(interactions)::BIGINT AS interactions FROM (
    SELECT customer_id, timestamp::DATE AS date, {_DAILY_ROUND} AS avg_sentiment, count(*) AS interactions FROM m_interactions WHERE timestamp::DATE + INTERVAL 1 DAY <= (SELECT passed FROM m_watermark) AND customer_id IS NOT NULL GROUP BY 1, 2) d GROUP BY 1) s""",
    "stream_sessions": """SELECT * EXCLUDE (session_no) FROM (SELECT user_id, session_no, min(event_timestamp) AS session_start, max(event_timestamp) AS session_end, count(*) AS events FROM (
  SELECT user_id, event_timestamp, sum(starts) OVER (PARTITION BY user_id ORDER BY event_timestamp, event_id)::BIGINT AS session_no FROM (
    SELECT *, CASE WHEN event_timestamp - lag(event_timestamp) OVER (PARTITION BY user_id ORDER BY event_timestamp, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM m_events) a) b GROUP BY 1, 2) c WHERE session_end + INTERVAL 30 MINUTE <= (SELECT passed FROM m_watermark)""",
}

RECURSIVE: dict[str, str] = {
    "chunk_documents": f"""WITH RECURSIVE docs AS (SELECT doc_id, text, length(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL),
steps AS (
  SELECT doc_id, text, n, 0 AS chunk_no, 0::BIGINT AS start, CASE WHEN n <= 1024 THEN n ELSE {_CHUNK_END.format(s='0')} END AS stop, n <= 1024 AS done FROM docs
  UNION ALL
  SELECT doc_id, text, n, chunk_no + 1, stop - 128, {_CHUNK_END.format(s='(stop - 128)')}, FALSE FROM steps WHERE NOT done AND stop - 128 < n)
SELECT doc_id, chunk_no, start, substr(text, start + 1, least(stop, n) - start) AS chunk FROM steps""",
}


def _needed(body: str) -> list[str]:
    wanted: set[str] = set()
    waiting = [body]
    while waiting:
        for name in set(re.findall(r"\bm_\w+\b", waiting.pop())) & SHARED.keys() - wanted:
            wanted.add(name)
            waiting.append(SHARED[name])
    return [name for name in SHARED if name in wanted]


def _statement(body: str) -> str:
    parts = [f"{name} AS ({SHARED[name]})" for name in _needed(body)]
    return f"WITH {', '.join(parts)} {body}" if parts else body


ORACLES: dict[str, str] = {name: _statement(body) for name, body in BODIES.items()} | RECURSIVE
