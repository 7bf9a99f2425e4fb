"""Fixed schemas of the stored tables and of the inbound payloads."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<float>": T.ArrayType(T.FloatType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def columns(*named: str) -> list[T.StructField]:
    """Fields from ``name type`` entries; unlike ``fromDDL`` this needs no running session."""
    return [T.StructField(n, TYPES[t]) for n, t in (e.split(" ") for e in named)]


def _struct(text: str) -> T.StructType:
    return T.StructType(columns(*text.split(", ")))


ALERT_PAYLOAD = _struct(
    "external_id string, server_ip string, host string, service string, severity string, raw_log string"
)

ALERTS = _struct(
    "id bigint, external_id string, server_ip string, host string, service string, severity string, "
    "raw_log string, error_message string, stack_trace string, matched_knowledge_id bigint, "
    "similarity_score double, match_status string, status string, ai_summary string, "
    "cluster_key string, resolved_at timestamp, created_at timestamp, updated_at timestamp"
)

KNOWLEDGE_PAYLOAD = _struct(
    "error_type string, title string, raw_log_sample string, root_cause string, user_guide string, "
    "engineer_guide string, tags array<string>, source string"
)

KNOWLEDGE_TABLE = _struct(
    "id bigint, error_type string, title string, raw_log_sample string, root_cause string, "
    "user_guide string, engineer_guide string, occurrence_count int, source string, "
    "tags string, confidence double, is_active boolean, "
    "created_at timestamp, updated_at timestamp"
)

RESOLUTION = _struct(
    "alert_id bigint, error_type string, root_cause string, resolution string, engineer string, "
    "tags array<string>"
)

ACTION_REQUEST = _struct(
    "action_name string, target string, params map<string,string>, triggered_by string, "
    "alert_id bigint, knowledge_id bigint"
)

INVOCATIONS = _struct(
    "action_name string, alert_id bigint, knowledge_id bigint, target string, triggered_by string, "
    "status string, result string"
)

ACTION_CATALOG = _struct("name string, label string, description string, risk_level string")

VECTORS = _struct("namespace string, id bigint, text string, embedding array<float>")

ALERT_VIEW = [
    "id", "external_id", "server_ip", "host", "service", "severity", "raw_log", "error_message",
    "matched_knowledge_id", "similarity_score", "match_status", "status", "ai_summary",
    "cluster_key", "created_at",
]

KNOWLEDGE_VIEW = [
    "id", "error_type", "title", "raw_log_sample", "root_cause", "user_guide", "engineer_guide",
    "occurrence_count", "source", "tags", "confidence", "is_active", "created_at",
]
