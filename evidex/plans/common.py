"""SQL fragments shared by the oracle queries."""

from __future__ import annotations

from evidex.functions.text import SPACE, SPACE_CHARS
from evidex.sources import tables as t

QUOTED_SPACE = "'" + SPACE_CHARS + "'"
DOCS_CTE = f"docs AS ({t.select_sql(t.DOCS, 'documents')})"
MESSAGES_CTE = f"messages AS ({t.select_sql(t.MESSAGES, 'conversations')})"
EVENTS_CTE = f"evts AS ({t.select_sql(t.EVENTS, 'events')})"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {QUOTED_SPACE})"


def collapse(x: str) -> str:
    return f"regexp_replace({strip(x)}, '[{SPACE}]+', ' ', 'g')"


CHUNKS_CTE = f"""
{DOCS_CTE},
starts AS (SELECT document_id, user_id, scope, matter_id, conversation_id, lang, source, doc_id, text AS doc_text,
                  unnest(range(0, CAST(length(text) AS BIGINT), 1000)) AS s FROM docs WHERE text <> ''),
windows AS (SELECT *, substring(doc_text, s + 1, 1200) AS raw FROM starts),
chunks AS (
  SELECT document_id, user_id, scope, matter_id, conversation_id, lang, source, doc_id,
         CAST(row_number() OVER (PARTITION BY document_id ORDER BY s) - 1 AS BIGINT) AS chunk_index,
         {strip('raw')} AS text,
         CAST(s + length(raw) - length(ltrim(raw, {QUOTED_SPACE})) AS BIGINT) AS start_offset
  FROM windows WHERE {strip('raw')} <> '')
"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
