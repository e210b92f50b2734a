"""Explicit schemas of stored records, as DDL."""

_RUN_SOURCES = "ARRAY<STRUCT<source_id: STRING, status: STRING, candidates: INT, `new`: INT, changed: INT, unchanged: INT, date_unknown: INT, fetch_failed: INT, warnings: ARRAY<STRING>, error: STRING>>"
_BASIS = "STRUCT<method: STRING, evidence: STRING>"
_ATTACHMENTS = "ARRAY<STRUCT<url: STRING, title: STRING, status: STRING, error: STRING, text_length: INT, pages: INT, pages_read: INT>>"

ARTICLE = (
    "STRUCT<article_id: STRING, source_id: STRING, canonical_url: STRING, title: STRING, published_at: STRING, updated_at: STRING, "
    f"date_basis: STRUCT<published: {_BASIS}, updated: {_BASIS}>, date_precision: STRUCT<published: STRING, updated: STRING>, "
    "first_seen_at: STRING, last_seen_at: STRING, latest_version: INT, status: STRING>"
)
VERSION = (
    "STRUCT<article_id: STRING, version: INT, content_hash: STRING, fetched_at: STRING, content_type: STRING, text_length: INT, "
    "extraction_status: STRING, extraction_error: STRING, change_type: STRING, extraction_profile: STRING, export_hash: STRING, "
    f"export_hash_status: STRING, export_hash_scope: STRING, attachments: {_ATTACHMENTS}>"
)
SUMMARY = (
    "STRUCT<article_id: STRING, article_version: INT, analysis_status: STRING, error: STRING, summary: STRING, key_points: ARRAY<STRING>, "
    "targets: ARRAY<STRING>, dates: ARRAY<STRUCT<label: STRING, value: STRING, evidence: STRING>>, "
    "ai_tags: ARRAY<STRUCT<tag_id: STRING, reason: STRING>>, uncertainties: ARRAY<STRING>, provider: STRING, model: STRING, "
    "prompt_version: STRING, tags_version: STRING, usage: STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, retries: INT, "
    "estimated_cost_usd: DOUBLE>, processed_at: STRING, content_hash: STRING, input_truncated: BOOLEAN>"
)
STATE = (
    "STRUCT<source_id: STRING, last_success_at: STRING, last_attempt_at: STRING, last_attempt_status: STRING, "
    "explored_range: STRUCT<oldest: STRING, newest: STRING, pages: INT>, retry_queue: ARRAY<STRUCT<url: STRING, article_id: STRING, "
    "stage: STRING, reason: STRING, first_failed_at: STRING, attempts: INT>>, consecutive_failures: INT>"
)

SCHEMAS = {
    "article": f"schema_version INT, article {ARTICLE}, versions ARRAY<{VERSION}>",
    "summary": f"schema_version INT, article_id STRING, summaries ARRAY<{SUMMARY}>",
    "run": (
        "schema_version INT, run STRUCT<run_id: STRING, started_at: STRING, finished_at: STRING, status: STRING, trigger: STRING, kind: STRING, "
        f"period: STRUCT<start: STRING, `end`: STRING>, sources: {_RUN_SOURCES}, totals: STRUCT<`new`: INT, changed: INT, unchanged: INT, "
        "date_unknown: INT, fetch_failed: INT, summarized: INT, summarize_failed: INT>, failures: ARRAY<STRUCT<source_id: STRING, url: STRING, "
        "article_id: STRING, stage: STRING, reason: STRING>>, api_usage: STRUCT<requests: INT, input_tokens: BIGINT, output_tokens: BIGINT, "
        "estimated_cost_usd: DOUBLE>>"
    ),
    "state": f"schema_version INT, sources MAP<STRING, {STATE}>",
    "rule_tags": "schema_version INT, articles MAP<STRING, STRUCT<article_version: INT, scope: STRING, rules_version: STRING, tags: ARRAY<STRUCT<tag_id: STRING, label: STRING, matched: STRING, `in`: STRING>>>>",
    "tag_candidates": "schema_version INT, candidates ARRAY<STRUCT<name: STRING, reason: STRING, article_id: STRING, first_seen_at: STRING>>",
}
