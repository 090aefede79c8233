"""Families N and O: logs, listings and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.operators import logs as lg
from evidex.operators import web as w
from evidex.plans.common import EVENTS_CTE, collapse, lit, strip, with_ctes
from evidex.plans.hits import case
from evidex.plans.packing import _IN, _MODEL, _OUT, USAGE
from evidex.sources import tables as t

PATHS = ["/api/v1/auth/login", "/api/v1/chat/stream", "/health", "/api/v1/documents/7", "/api/v1/matters/3/upload", "/api/v1/logs", "/docs", "/api/v1/contracts/review"]
AGENTS = [
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605 Version/17.0 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Windows NT 10.0; Win64) Chrome/124.0 Safari/537.36 Edg/124.0", "Mozilla/5.0 (X11; Linux x86_64; rv:125.0) Firefox/125.0",
    "curl/8.4.0", "", "Mozilla/5.0 (Linux; Android 14; Pixel) Chrome/124.0 Mobile Safari/537.36", "Mozilla/5.0 (iPad; CPU OS 17_0) Safari/604.1",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14) Chrome/124 Safari/537 OPR/110", "MyClient/2.1 (tablet)",
]
REQUESTS = {
    "id": "event_id",
    "request_id": "concat('r', event_id)",
    "user_id": "concat('u', user_id)",
    "path": case("event_id % 8", PATHS),
    "response_status": "CASE WHEN event_id % 17 = 0 THEN 500 WHEN event_id % 13 = 0 THEN 404 WHEN event_id % 11 = 0 THEN 422 ELSE 200 END",
    "error_type": "CASE WHEN event_id % 4 = 0 THEN 'HTTPException' ELSE concat(event_type, 'Error') END",
    "action": "event_type",
    "duration_ms": "CAST(value * 10 AS BIGINT)",
    "request_body": "props",
    "created_at": "ts",
    "user_agent": case("event_id % 9", AGENTS),
    "forwarded_for": "CASE WHEN event_id % 3 = 0 THEN concat(' 10.0.0.', event_id % 250, ' , 1.1.1.1') WHEN event_id % 7 = 1 THEN '' END",
    "real_ip": "CASE WHEN event_id % 2 = 0 THEN concat('10.1.0.', event_id % 250) END",
    "peer": "concat('10.2.0.', event_id % 250)",
}
REQUESTS_CTE = f"requests AS ({t.select_sql(REQUESTS, 'events')})"


def requests(spark, d):
    return t.project(t.load(spark, d, "events"), REQUESTS)


SINCE, UNTIL = "2024-01-05 00:00:00", "2024-01-20 12:30:00"


def request_page(spark, d):
    rows = lg.filter_log(requests(spark, d), SINCE, UNTIL, "/api/v1/", response_status=200)
    return lg.page(rows, 50, 100).select("id", "request_id", "user_id", "path", "created_at")


def request_count(spark, d):
    return lg.count_log(lg.filter_log(requests(spark, d), SINCE, UNTIL, "/api/v1/", response_status=200))


def error_page(spark, d):
    return lg.page(lg.filter_log(requests(spark, d), since=SINCE, error_type="HTTPException"), 30).select("id", "error_type", "created_at")


def error_counts(spark, d):
    return lg.count_log(lg.filter_log(requests(spark, d), until=UNTIL, error_type="HTTPException"))


def activity_page(spark, d):
    return lg.page(lg.filter_log(requests(spark, d), until=UNTIL, action="click"), 40, 5).select("id", "action", "created_at")


def activity_count(spark, d):
    return lg.count_log(lg.filter_log(requests(spark, d), action="click", user_id="u8"))


def lookup(spark, d):
    rows = requests(spark, d)
    return lg.find(rows, "id", 77).unionByName(lg.find(rows, "request_id", "r78")).select("id", "request_id", "path")


def failures(spark, d):
    rows = requests(spark, d).withColumn("is_http", F.col("error_type") == "HTTPException")
    return rows.select("id", lg.is_logged_failure(F.col("is_http"), F.col("response_status")).alias("logged"))


def devices(spark, d):
    return requests(spark, d).select("id", *[c.alias(n) for n, c in lg.device_columns("user_agent").items()])


def addresses(spark, d):
    return requests(spark, d).select("id", lg.client_ip("forwarded_for", "real_ip", "peer").alias("ip_address"))


def buckets(spark, d):
    rows = requests(spark, d).select("id", lg.rate_bucket("path").alias("bucket"))
    return rows.withColumn("per_minute", lg.rate_limit("bucket"))


def loggables(spark, d):
    return lg.loggable(requests(spark, d)).select("id", "path", "request_body")


CONVERSATIONS = {
    "conversation_id": "o_orderkey", "user_id": "concat('u', o_custkey)",
    "matter_id": "CASE WHEN o_orderstatus = 'O' THEN concat('m', o_custkey % 40) END",
    "last_message_at": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END", "updated_at": "o_orderdate",
}
MATTERS = {
    "matter_id": "o_orderkey", "owner_id": "concat('u', o_custkey)", "title": "concat(o_orderpriority, ' ', o_orderstatus)",
    "updated_at": "o_orderdate",
}
SESSIONS = {
    "session_id": "o_orderkey", "user_id": "concat('u', o_custkey)", "expires_at": "o_orderdate",
    "revoked_at": "CASE WHEN o_orderstatus = 'F' THEN o_orderdate END",
}
MESSAGES = {"conv_id": "conv_id", "turn": "turn", "role": "role", "created_at": "conv_id * 1000 + (turn * 7) % 5"}


def conversations(spark, d):
    return t.project(t.load(spark, d, "orders"), CONVERSATIONS)


def user_conversations(spark, d):
    return lg.conversations_of_users(conversations(spark, d)).select("user_id", "conversation_id", "position")


def matter_conversations(spark, d):
    return lg.conversations_of_matters(conversations(spark, d)).select("matter_id", "conversation_id", "position")


def messages(spark, d):
    return t.project(t.load(spark, d, "conversations"), MESSAGES)


def ordered_messages(spark, d):
    return lg.messages_in_order(messages(spark, d)).select("conv_id", "turn", "position")


def last_messages(spark, d):
    return lg.latest_messages(messages(spark, d))


def matters(spark, d):
    return t.project(t.load(spark, d, "orders"), MATTERS)


def user_matters(spark, d):
    return lg.matters_of_users(matters(spark, d)).select("owner_id", "matter_id", "position")


def taken(spark, d):
    asked = t.load(spark, d, "customer").selectExpr("concat('u', c_custkey) AS owner_id", "'1-URGENT O' AS title")
    return lg.titles_taken(asked, matters(spark, d))


def repeated_titles(spark, d):
    return lg.duplicates(matters(spark, d), "owner_id", "title")


def sessions(spark, d):
    return t.project(t.load(spark, d, "orders"), SESSIONS)


AS_OF = "1998-06-01 00:00:00"


def states(spark, d):
    return lg.session_state(sessions(spark, d), F.lit(AS_OF).cast("timestamp_ntz")).select("session_id", "state")


def revoked(spark, d):
    users = t.load(spark, d, "customer").filter("c_acctbal < 0").selectExpr("concat('u', c_custkey) AS user_id")
    return lg.revoke_all(sessions(spark, d), users, F.lit(AS_OF).cast("timestamp_ntz")).select("session_id", "revoked_at")


def user_lookup(spark, d):
    users = t.load(spark, d, "customer").selectExpr("c_custkey AS user_id", "concat(lower(c_mktsegment), c_custkey % 200, '@example.org') AS email", "c_name AS username")
    return users.filter((F.col("username") == "Customer#000000007") | (F.col("email") == "building9@example.org"))


def repeated_emails(spark, d):
    users = t.load(spark, d, "customer").selectExpr("concat(lower(c_mktsegment), c_custkey % 200, '@example.org') AS email")
    return lg.duplicates(users, "email")


def usage_totals(spark, d):
    rows = t.project(t.load(spark, d, "conversations"), {**USAGE, "user_id": "concat('u', conv_id % 37)"})
    rows = rows.select("conv_id", "user_id", "model", "prompt_tokens", "completion_tokens", F.col("reported_total").alias("total_tokens"))
    return lg.token_totals(rows, "user_id", "conv_id").withColumn("cost", F.round("cost", 10))


def touched(spark, d):
    base = t.load(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id")).distinct().selectExpr(
        "conversation_id", "CASE WHEN conversation_id % 3 = 0 THEN conversation_id * 1000 + 2 WHEN conversation_id % 3 = 1 THEN conversation_id * 2000 + 9 END AS last_message_at"
    )
    return lg.touch_conversations(base, messages(spark, d))


# --- O -------------------------------------------------------------------------------

def links(spark, d):
    found = w.extract_links(t.load(spark, d, "pages"), w.PAGE_LINK, w.PAGE_SNIPPET)
    return found.select("page_id", "position", "url", "title", F.md5("snippet").alias("snippet_md5"), F.round("score", 6).alias("score"), "official")


RESULTS = (
    "concat('<div><a rel=\"n\" class=\"result__a\" href=\"//duck.example/l/?uddg=https%3A%2F%2Fwww.supremecourt.gov.pk%2Fcase%2F', page_id, '&rut=1\">Case <b>', page_id, "
    "'</b> &amp; more</a><a class=\"result__snippet\" href=\"#\">On  bail &lt;', page_id, '&gt;</a><a class=\"result__a\" href=\"', url, '\">', url, '</a>"
    "<td class=\"result-snippet\">second</td><a class=\"result__a\" href=\"', url, '\">again</a>', html, '</div>')"
)


def result_links(spark, d):
    pages = t.load(spark, d, "pages").select("page_id", F.expr(RESULTS).alias("html"))
    return w.extract_links(pages, limit=8).select("page_id", "position", "url", "title", "snippet", F.round("score", 6).alias("score"), "official")


HREF = (
    "CASE WHEN page_id % 4 = 0 THEN concat('//r.example/l/?uddg=', replace(replace(url, ':', '%3A'), '/', '%2F'), '&x=1') WHEN page_id % 4 = 1 THEN '//lhc.gov.pk/a' "
    "WHEN page_id % 4 = 2 THEN replace(url, 'example.com', 'www.senate.gov.pk') ELSE url END"
)


def unwrapped(spark, d):
    rows = t.load(spark, d, "pages").select("page_id", w.unwrap_redirect(F.expr(HREF)).alias("url"))
    return rows.withColumn("official", w.is_official("url"))


def localized(spark, d):
    rows = t.load(spark, d, "benchmark").selectExpr("item_id", "CASE WHEN item_id % 3 = 0 THEN concat('PAKISTANI rules ', text) ELSE text END AS q")
    return rows.select("item_id", w.localize_query("q").alias("query"))


QUERIES = {
    "request_log_page": request_page,
    "request_log_count": request_count,
    "error_log_page": error_page,
    "error_log_count": error_counts,
    "activity_log_page": activity_page,
    "activity_log_count": activity_count,
    "log_lookup": lookup,
    "logged_failures": failures,
    "device_info": devices,
    "client_addresses": addresses,
    "rate_buckets": buckets,
    "loggable_requests": loggables,
    "user_conversations": user_conversations,
    "matter_conversations": matter_conversations,
    "messages_in_order": ordered_messages,
    "latest_messages": last_messages,
    "user_matters": user_matters,
    "titles_taken": taken,
    "duplicate_titles": repeated_titles,
    "session_states": states,
    "revoke_sessions": revoked,
    "user_lookup": user_lookup,
    "duplicate_emails": repeated_emails,
    "token_totals": usage_totals,
    "touch_conversations": touched,
    "page_links": links,
    "result_links": result_links,
    "unwrap_redirects": unwrapped,
    "localize_queries": localized,
}

_R = with_ctes(REQUESTS_CTE)
_F = f"created_at >= TIMESTAMP '{SINCE}' AND created_at <= TIMESTAMP '{UNTIL}' AND starts_with(path, '/api/v1/') AND response_status = 200"
_SEL = "SELECT {} FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n FROM requests WHERE {}) WHERE n > {} AND n <= {}"
_UA = "lower(user_agent)"


def _has(words) -> str:
    return "(" + " OR ".join(f"contains({_UA}, {lit(x)})" for x in words) + ")"


DEVICE = f"""CASE WHEN user_agent = '' THEN 'unknown' WHEN {_has(lg.BOT_WORDS)} THEN 'bot' WHEN {_has(lg.MOBILE_WORDS)} THEN 'mobile'
  WHEN {_has(lg.TABLET_WORDS)} THEN 'tablet' ELSE 'desktop' END"""
_HOSTS = "|".join(h.replace(".", r"\.") for h in w.OFFICIAL_HOSTS)
_OFFICIAL = f"regexp_matches(regexp_replace(lower(regexp_extract({{}}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)), '^www\\.', ''), '^(?:.*\\.)?(?:{_HOSTS})$')"


def official(x: str) -> str:
    return _OFFICIAL.replace("{}", x)


def _entities(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


ORACLE = {
    "request_log_page": _R + _SEL.format("id, request_id, user_id, path, created_at", _F, 100, 150),
    "request_log_count": _R + f"SELECT count(*) AS total FROM requests WHERE {_F}",
    "error_log_page": _R + _SEL.format("id, error_type, created_at", f"created_at >= TIMESTAMP '{SINCE}' AND error_type = 'HTTPException'", 0, 30),
    "error_log_count": _R + f"SELECT count(*) AS total FROM requests WHERE created_at <= TIMESTAMP '{UNTIL}' AND error_type = 'HTTPException'",
    "activity_log_page": _R + _SEL.format("id, action, created_at", f"created_at <= TIMESTAMP '{UNTIL}' AND action = 'click'", 5, 45),
    "activity_log_count": _R + "SELECT count(*) AS total FROM requests WHERE action = 'click' AND user_id = 'u8'",
    "log_lookup": _R + "SELECT id, request_id, path FROM requests WHERE id = 77 OR request_id = 'r78'",
    "logged_failures": _R + "SELECT id, error_type <> 'HTTPException' OR response_status >= 500 OR response_status IN (401, 403, 409, 422) AS logged FROM requests",
    "device_info": _R + f"""SELECT id, {DEVICE} AS device_type,
  CASE {' '.join(f"WHEN {_has(ws)} THEN {lit(n)}" for ws, n in lg.OS_WORDS)} END AS device_os,
  CASE {' '.join(f"WHEN contains({_UA}, {lit(m)}) THEN {lit(n)}" for m, n in lg.BROWSERS)} ELSE nullif(regexp_extract(user_agent, '([a-zA-Z]+)/[0-9.]+', 1), '') END AS device_browser FROM requests""",
    "client_addresses": _R + "SELECT id, coalesce(trim(string_split(nullif(forwarded_for, ''), ',')[1]), real_ip, peer) AS ip_address FROM requests",
    "rate_buckets": _R + """SELECT id, b AS bucket, CAST(CASE b WHEN 'auth' THEN 30 WHEN 'chat' THEN 20 WHEN 'upload' THEN 10 ELSE 60 END AS BIGINT) AS per_minute FROM (
  SELECT id, CASE WHEN path LIKE '/api/v1/auth%' THEN 'auth' WHEN path LIKE '/api/v1/chat%' OR path LIKE '/api/v1/contracts%' THEN 'chat'
  WHEN path LIKE '%/upload%' OR path LIKE '/api/v1/documents%' THEN 'upload' ELSE 'default' END AS b FROM requests)""",
    "loggable_requests": _R + """SELECT id, path, CASE WHEN path LIKE '%/chat%' THEN '{"_omitted": "chat_body"}' ELSE request_body END AS request_body
  FROM requests WHERE path NOT IN ('/docs', '/openapi.json', '/redoc', '/health', '/ready')""",
    "user_conversations": f"""WITH c AS ({t.select_sql(CONVERSATIONS, 'orders')}) SELECT user_id, conversation_id,
  row_number() OVER (PARTITION BY user_id ORDER BY last_message_at DESC NULLS LAST, updated_at DESC, conversation_id) AS position FROM c""",
    "matter_conversations": f"""WITH c AS ({t.select_sql(CONVERSATIONS, 'orders')}) SELECT matter_id, conversation_id,
  row_number() OVER (PARTITION BY matter_id ORDER BY updated_at DESC, conversation_id) AS position FROM c WHERE matter_id IS NOT NULL""",
    "messages_in_order": f"""WITH m AS ({t.select_sql(MESSAGES, 'conversations')}) SELECT conv_id, turn,
  row_number() OVER (PARTITION BY conv_id ORDER BY created_at, turn) AS position FROM m""",
    "latest_messages": f"""WITH m AS ({t.select_sql(MESSAGES, 'conversations')}) SELECT conv_id, turn, role, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY created_at DESC, turn DESC) AS n FROM m) WHERE n = 1""",
    "user_matters": f"""WITH m AS ({t.select_sql(MATTERS, 'orders')}) SELECT owner_id, matter_id,
  row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, matter_id) AS position FROM m""",
    "titles_taken": f"""WITH m AS ({t.select_sql(MATTERS, 'orders')}) SELECT 'u' || c_custkey AS owner_id, '1-URGENT O' AS title FROM customer
  WHERE EXISTS (SELECT 1 FROM m WHERE m.owner_id = 'u' || c_custkey AND m.title = '1-URGENT O')""",
    "duplicate_titles": f"""WITH m AS ({t.select_sql(MATTERS, 'orders')}) SELECT owner_id, title, count(*) AS copies FROM m GROUP BY 1, 2 HAVING count(*) > 1""",
    "session_states": f"""WITH s AS ({t.select_sql(SESSIONS, 'orders')}) SELECT session_id, CASE WHEN revoked_at IS NOT NULL THEN 'revoked'
  WHEN expires_at < TIMESTAMP '{AS_OF}' THEN 'expired' ELSE 'active' END AS state FROM s""",
    "revoke_sessions": f"""WITH s AS ({t.select_sql(SESSIONS, 'orders')}) SELECT session_id, CASE WHEN revoked_at IS NULL AND user_id IN
  (SELECT 'u' || c_custkey FROM customer WHERE c_acctbal < 0) THEN TIMESTAMP '{AS_OF}' ELSE revoked_at END AS revoked_at FROM s""",
    "user_lookup": """SELECT c_custkey AS user_id, lower(c_mktsegment) || (c_custkey % 200) || '@example.org' AS email, c_name AS username FROM customer
  WHERE c_name = 'Customer#000000007' OR lower(c_mktsegment) || (c_custkey % 200) || '@example.org' = 'building9@example.org'""",
    "duplicate_emails": """SELECT lower(c_mktsegment) || (c_custkey % 200) || '@example.org' AS email, count(*) AS copies FROM customer GROUP BY 1 HAVING count(*) > 1""",
    "token_totals": f"""WITH u AS (SELECT *, 'u' || (conv_id % 37) AS user_id FROM ({t.select_sql(USAGE, 'conversations')})), v AS (SELECT *, {_MODEL} AS m FROM u)
SELECT user_id, conv_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(reported_total) AS BIGINT) AS total_tokens, round(sum(prompt_tokens / 1e6 * {_IN} + completion_tokens / 1e6 * {_OUT}), 10) AS cost, count(*) AS messages FROM v GROUP BY 1, 2""",
    "touch_conversations": f"""WITH m AS ({t.select_sql(MESSAGES, 'conversations')}),
b AS (SELECT DISTINCT conv_id AS conversation_id, CASE WHEN conv_id % 3 = 0 THEN conv_id * 1000 + 2 WHEN conv_id % 3 = 1 THEN conv_id * 2000 + 9 END AS l FROM conversations)
SELECT conversation_id, greatest(l, (SELECT max(created_at) FROM m WHERE conv_id = conversation_id)) AS last_message_at FROM b""",
    "page_links": f"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '{w.PAGE_LINK}', 1) AS hs, regexp_extract_all(html, '{w.PAGE_LINK}', 2) AS ts,
   regexp_extract_all(html, '{w.PAGE_SNIPPET}', 1) AS s1, regexp_extract_all(html, '{w.PAGE_SNIPPET}', 2) AS s2 FROM pages),
u AS (SELECT page_id, generate_subscripts(hs, 1) AS i, unnest(hs) AS h, unnest(ts) AS ti, s1, s2 FROM l),
f AS (SELECT page_id, i - 1 AS position, {_entities('h')} AS url, {collapse(_entities("regexp_replace(ti, '<[^>]+>', ' ', 'g')"))} AS title,
   {collapse(_entities("regexp_replace(coalesce(nullif(s1[i], ''), s2[i], ''), '<[^>]+>', ' ', 'g')"))} AS sn FROM u),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY position) AS k FROM f WHERE url <> '') WHERE k = 1)
SELECT page_id, position, url, CASE WHEN title <> '' THEN title ELSE url END AS title, md5(substring(sn, 1, 2000)) AS snippet_md5,
  round(greatest(0.2, 0.85 - CAST(position AS DOUBLE) * 0.07), 6) AS score, {official('url')} AS official FROM d""",
    "unwrap_redirects": f"""
WITH h AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1 THEN 'https://lhc.gov.pk/a'
  WHEN page_id % 4 = 2 THEN replace(url, 'example.com', 'www.senate.gov.pk') ELSE url END AS u FROM pages),
c AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN regexp_extract(u, '^[^&#]*') ELSE u END AS url FROM h)
SELECT page_id, url, {official('url')} AS official FROM c""",
    "localize_queries": """
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'PAKISTANI rules ' || text WHEN contains(lower(text), 'pakistan') THEN text ELSE text || ' Pakistan law' END AS query FROM benchmark""",
}
