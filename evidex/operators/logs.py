"""Operational logs and entity queries (family N)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import text as tx
from evidex.functions.slices import positions
from evidex.functions.text import contains_any

# Paths that are not logged, and requests per minute by kind of path.
SKIP_PATHS = ("/docs", "/openapi.json", "/redoc", "/health", "/ready")
RATE_LIMITS = {"auth": 30, "chat": 20, "upload": 10, "default": 60}
LOGGED_STATUSES = (401, 403, 409, 422)
# Markers in lower-case user agents; the first that applies counts.
BOT_WORDS, MOBILE_WORDS, TABLET_WORDS = ("bot", "crawler", "spider", "curl", "postman"), ("iphone", "android", "mobile"), ("ipad", "tablet")
OS_WORDS = (("windows",), "Windows"), (("mac os", "macintosh"), "macOS"), (("android",), "Android"), (("iphone", "ios"), "iOS"), (("linux",), "Linux")
BROWSERS = ("edg/", "Edge"), ("chrome/", "Chrome"), ("firefox/", "Firefox"), ("safari/", "Safari"), ("opr/", "Opera")


def filter_log(log: DataFrame, since: datetime | str | None = None, until: datetime | str | None = None,
               path_prefix: str | None = None, **equals) -> DataFrame:
    """Rows matching every given test; time bounds are inclusive.

    Plain comparisons on stored columns, so they reach the scan as pushed filters.
    """
    for column, value in equals.items():
        if value is not None:
            log = log.filter(F.col(column) == value)
    if path_prefix is not None:
        log = log.filter(F.startswith("path", F.lit(path_prefix)))
    if since is not None:
        log = log.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        log = log.filter(F.col("created_at") <= F.lit(until).cast("timestamp_ntz"))
    return log


def page(log: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, equal times by id; a top-n, not a full sort."""
    return log.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def count_log(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"))


def find(log: DataFrame, column: str, value) -> DataFrame:
    """Point lookup by id or request id."""
    return log.filter(F.col(column) == value)


def is_logged_failure(is_http: Column, status: Column) -> Column:
    return ~is_http | F.coalesce((status >= 500) | status.isin(*LOGGED_STATUSES), F.lit(False))


def device_columns(user_agent: Column | str) -> dict[str, Column]:
    agent = F.coalesce(tx.as_col(user_agent), F.lit(""))
    ua = F.lower(agent)
    kind = (
        F.when(agent == "", "unknown").when(contains_any(ua, BOT_WORDS), "bot").when(contains_any(ua, MOBILE_WORDS), "mobile")
        .when(contains_any(ua, TABLET_WORDS), "tablet").otherwise("desktop")
    )
    system = F.lit(None).cast("string")
    for words, name in reversed(OS_WORDS):
        system = F.when(contains_any(ua, words), name).otherwise(system)
    browser = F.nullif(F.regexp_extract(agent, r"([a-zA-Z]+)/[\d.]+", 1), F.lit(""))
    for marker, name in reversed(BROWSERS):
        browser = F.when(F.contains(ua, F.lit(marker)), name).otherwise(browser)
    return {"device_type": kind, "device_os": system, "device_browser": browser}


def client_ip(forwarded_for: Column | str, real_ip: Column | str, peer: Column | str) -> Column:
    first = tx.strip(F.get(F.split(F.nullif(tx.as_col(forwarded_for), F.lit("")), ","), F.lit(0)))
    return F.coalesce(first, tx.strip(F.nullif(tx.as_col(real_ip), F.lit(""))), tx.as_col(peer))


def rate_bucket(path: Column | str) -> Column:
    p = tx.as_col(path)
    return (
        F.when(F.startswith(p, F.lit("/api/v1/auth")), "auth")
        .when(F.startswith(p, F.lit("/api/v1/chat")) | F.startswith(p, F.lit("/api/v1/contracts")), "chat")
        .when(F.contains(p, F.lit("/upload")) | F.startswith(p, F.lit("/api/v1/documents")), "upload")
        .otherwise("default")
    )


def rate_limit(bucket: Column | str) -> Column:
    return F.element_at(tx.const_map(RATE_LIMITS, "bigint"), tx.as_col(bucket))


def loggable(requests: DataFrame) -> DataFrame:
    """Requests worth logging; bodies of chat requests are replaced by a marker."""
    chat = F.contains("path", F.lit("/chat"))
    return requests.filter(~F.col("path").isin(*SKIP_PATHS)).withColumn(
        "request_body", F.when(chat, F.lit('{"_omitted": "chat_body"}')).otherwise(F.col("request_body"))
    )


# --- entity listings ------------------------------------------------------------------

def conversations_of_users(conversations: DataFrame) -> DataFrame:
    """Position of every conversation in its owner's list: latest message first, silent ones last."""
    order = [F.desc_nulls_last("last_message_at"), F.desc("updated_at"), F.asc("conversation_id")]
    return positions(conversations, ["user_id"], F.date_trunc("month", "last_message_at"), order)


def conversations_of_matters(conversations: DataFrame) -> DataFrame:
    rows = conversations.filter(F.col("matter_id").isNotNull())
    return positions(rows, ["matter_id"], F.date_trunc("month", "updated_at"), [F.desc("updated_at"), F.asc("conversation_id")])


MESSAGE_BUCKET = 86_400


def messages_in_order(messages: DataFrame) -> DataFrame:
    """``created_at`` in seconds."""
    bucket = F.floor(F.col("created_at") / MESSAGE_BUCKET)
    return positions(messages, ["conv_id"], bucket, [F.asc("created_at"), F.asc("turn")], newest_first=False)


def latest_messages(messages: DataFrame) -> DataFrame:
    """The last message per conversation, as a combinable aggregate."""
    others = [c for c in messages.columns if c != "conv_id"]
    last = F.max_by(F.struct(*others), F.struct("created_at", "turn"))
    return messages.groupBy("conv_id").agg(last.alias("m")).select("conv_id", "m.*")


def matters_of_users(matters: DataFrame) -> DataFrame:
    return positions(matters, ["owner_id"], F.date_trunc("month", "updated_at"), [F.desc("updated_at"), F.asc("matter_id")])


def titles_taken(requested: DataFrame, matters: DataFrame) -> DataFrame:
    """Requested ``(owner_id, title)`` pairs the owner already uses."""
    return requested.join(matters, ["owner_id", "title"], "left_semi")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Uniqueness audit: keys stored more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def session_state(sessions: DataFrame, as_of: Column) -> DataFrame:
    state = F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") < as_of, "expired").otherwise("active")
    return sessions.withColumn("state", state)


def revoke_all(sessions: DataFrame, users: DataFrame, at: Column) -> DataFrame:
    """Sessions with every open one of the given users revoked; closed ones keep their time."""
    hit = users.select("user_id").distinct().withColumn("_hit", F.lit(True))
    revoked = F.when(F.col("_hit") & F.col("revoked_at").isNull(), at).otherwise(F.col("revoked_at"))
    return sessions.join(hit, "user_id", "left").withColumn("revoked_at", revoked).select(*sessions.columns)


def token_totals(messages: DataFrame, *by: str) -> DataFrame:
    """Tokens and cost summed from message rows; the price is applied per row, before the sum."""
    from evidex.operators.pack import cost

    priced = cost(messages.withColumnsRenamed({"prompt_tokens": "input_tokens", "completion_tokens": "output_tokens"}))
    return priced.groupBy(*by).agg(
        F.sum("input_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"), F.sum("estimated_cost").alias("cost"), F.count("*").alias("messages"),
    )


def touch_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with ``last_message_at`` brought up to their newest message."""
    newest = messages.groupBy(F.col("conv_id").alias("conversation_id")).agg(F.max("created_at").alias("_newest"))
    return (
        conversations.join(newest, "conversation_id", "left")
        .withColumn("last_message_at", F.greatest("last_message_at", "_newest")).select(*conversations.columns)
    )
