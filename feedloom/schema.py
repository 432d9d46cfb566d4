"""Record, health, source and landing schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
_I = T.IntegerType()
_B = T.BooleanType()
_A = T.ArrayType(_S)

# Field names, order and defaults of one record.
RECORD_FIELDS: list[tuple[str, T.DataType, object]] = [
    ("job_id", _S, ""),
    ("source_job_id", _S, ""),
    ("company", _S, ""),
    ("title", _S, ""),
    ("location", _S, ""),
    ("country", _S, ""),
    ("workplace_type", _S, ""),
    ("department", _S, ""),
    ("employment_type", _S, ""),
    ("description", _S, ""),
    ("requirements", _S, ""),
    ("application_url", _S, ""),
    ("source_url", _S, ""),
    ("source_type", _S, ""),
    ("date_posted", _S, ""),
    ("first_seen", _S, ""),
    ("last_seen", _S, ""),
    ("status", _S, "active"),
    ("graduation_match", _S, ""),
    ("role_match_score", _I, 0),
    ("sponsorship_classification", _S, "unclear"),
    ("sponsorship_evidence", _S, ""),
    ("international_student_risk_flags", _A, []),
    ("overall_score", _I, 0),
    ("matched_keywords", _A, []),
    ("excluded_keywords", _A, []),
    ("score_explanation", _S, ""),
    ("disqualified", _B, False),
    ("disqualify_reason", _S, ""),
    ("consecutive_missing", _I, 0),
    ("announced", _B, False),
]
# One row of source health.
HEALTH_FIELDS: list[tuple[str, T.DataType, object]] = [
    ("company", _S, ""),
    ("source_type", _S, ""),
    ("last_attempt", _S, ""),
    ("last_success", _S, ""),
    ("status", _S, "unknown"),
    ("jobs_fetched", T.LongType(), 0),
    ("error_category", _S, ""),
    ("error_message", _S, ""),
    ("consecutive_failures", _I, 0),
]
# Allowed source types and error categories.
SOURCE_TYPES = [
    "eightfold", "greenhouse", "lever", "ashby", "workday",
    "json", "jsonld", "html", "playwright", "unresolved",
]
ERROR_CATEGORIES = [
    "ok", "ok_empty", "network_error", "parse_error", "blocked",
    "invalid_config", "structure_changed", "unsupported",
]

RECORD_SCHEMA = T.StructType([T.StructField(n, t) for n, t, _ in RECORD_FIELDS])
HEALTH_SCHEMA = T.StructType([T.StructField(n, t) for n, t, _ in HEALTH_FIELDS])
RECORD_COLUMNS = [n for n, _, _ in RECORD_FIELDS]
HEALTH_COLUMNS = [n for n, _, _ in HEALTH_FIELDS]

# DDL texts: they can be read before any session exists.
SOURCE_SCHEMA = (
    "source_no INT, name STRING, enabled BOOLEAN, priority INT, careers_url STRING, "
    "source_type STRING, source_identifier STRING, locations ARRAY<STRING>, notes STRING"
)
LANDING_SCHEMA = (
    "company STRING, source_type STRING, preset STRING, query_no INT, page_no BIGINT, "
    "fetched_at TIMESTAMP, url STRING, body STRING, context_json STRING"
)
# Landed detail answers: `detail_key` is the listing's key for the posting.
DETAIL_SCHEMA = "company STRING, detail_key STRING, body STRING"


def _default(value: object, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        return F.array().cast(dtype)
    return F.lit(value).cast(dtype)


def _conform(df: DataFrame, fields, extra: tuple[str, ...]) -> DataFrame:
    present = set(df.columns)
    columns = [
        (
            F.coalesce(F.col(name).cast(dtype), _default(value, dtype))
            if name in present
            else _default(value, dtype)
        ).alias(name)
        for name, dtype, value in fields
    ]
    return df.select(*columns, *extra)


def conform_records(df: DataFrame, *extra: str) -> DataFrame:
    """Drop unknown fields, fill missing ones with their default (schema projection)."""
    return _conform(df, RECORD_FIELDS, extra)


def conform_health(df: DataFrame, *extra: str) -> DataFrame:
    return _conform(df, HEALTH_FIELDS, extra)
