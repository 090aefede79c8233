"""Append-only request log with redaction (P4): a stateless projection, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.operators.logs import client_ip, device_columns, loggable, rate_bucket
from evidex.operators.safety import redact_json, truncate_payload

BODY_BYTES = 4096


def log_rows(requests: DataFrame, body_bytes: int = BODY_BYTES) -> DataFrame:
    """Requests as log rows: skipped paths removed, bodies redacted and cut, agent and address resolved."""
    body = truncate_payload(redact_json("request_body"), body_bytes)
    return loggable(requests).select(
        "id", "request_id", "user_id", "path", rate_bucket("path").alias("bucket"), "response_status",
        body.alias("request_body"), client_ip("forwarded_for", "real_ip", "peer").alias("ip_address"),
        *[c.alias(n) for n, c in device_columns("user_agent").items()], "duration_ms", F.col("created_at"),
    )
