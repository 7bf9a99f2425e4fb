"""Jobs that maintain the knowledge table and its vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.explain import (
    parse_resolution,
    resolution_fallbacks,
    resolution_prompts,
    rule_resolution,
)
from emberwatch.functions.logs import parse_logs
from emberwatch.operators.embed import embed
from emberwatch.operators.skew import join_lookup
from emberwatch.operators.tables import split_resolutions
from emberwatch.operators.vectors import delete_vectors, upsert_vectors
from emberwatch.settings import DEFAULTS, KNOWLEDGE


@dataclass(frozen=True)
class KnowledgeChange:
    kb: DataFrame
    vectors: DataFrame
    rejected: DataFrame
    """Requests that named an unknown row."""
    alerts: DataFrame | None = None
    added: DataFrame | None = None


def vectors_of(kb: DataFrame, dim: int = DEFAULTS.dim) -> DataFrame:
    """Vector rows of knowledge rows: the canonical text of each sample log."""
    logs = parse_logs(kb.select("id", F.col("raw_log_sample").alias("text")), "text")
    return embed(logs.select("id", "text", "canonical_text"), "canonical_text", dim).select(
        F.lit(KNOWLEDGE).alias("namespace"), "id", "text", "embedding"
    )


def last_id(kb: DataFrame) -> int:
    """Largest id in use (0 for an empty table)."""
    return kb.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def add_knowledge(
    kb: DataFrame, vectors: DataFrame, rows: DataFrame, dim: int = DEFAULTS.dim
) -> KnowledgeChange:
    """Append knowledge rows (with ``id``) and store the vector of each sample log."""
    changed = kb.unionByName(rows.select(*kb.columns))
    return KnowledgeChange(
        kb=changed,
        vectors=upsert_vectors(vectors, vectors_of(rows, dim)),
        rejected=rows.limit(0),
        added=rows,
    )


def structured_resolutions(requests: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with the fields of their knowledge row, requests for an unknown alert)."""
    ok, missing = split_resolutions(requests, alerts)
    return resolution_fallbacks(parse_resolution(rule_resolution(resolution_prompts(ok)))), missing


def resolution_rows(structured: DataFrame, after_id: int, now) -> DataFrame:
    """Knowledge rows for structured resolutions.

    Ids follow the request order: ``after_id + 1 + request_no``. Rejected requests leave gaps, so
    no global numbering (and no single task) is needed."""
    return structured.select(
        (F.lit(after_id + 1) + F.col("request_no")).cast("bigint").alias("id"),
        F.col("kb_error_type").alias("error_type"), F.col("kb_title").alias("title"),
        F.col("raw_log").alias("raw_log_sample"), F.col("kb_root_cause").alias("root_cause"),
        F.col("kb_user_guide").alias("user_guide"),
        F.col("kb_engineer_guide").alias("engineer_guide"),
        F.lit(1).alias("occurrence_count"),
        F.concat(F.lit("engineer:"), "engineer").alias("source"),
        F.when(F.size("tags") > 0, F.array_join("tags", ",")).alias("tags"),
        F.lit(1.0).alias("confidence"), F.lit(True).alias("is_active"),
        now.alias("created_at"), now.alias("updated_at"), "alert_id", "request_no",
    )


def deposit(
    alerts: DataFrame,
    kb: DataFrame,
    vectors: DataFrame,
    requests: DataFrame,
    now=None,
    dim: int = DEFAULTS.dim,
) -> KnowledgeChange:
    """Turn resolution requests (``request_no`` gives their order) into knowledge rows.

    Each alert becomes ``deposited`` and ``resolved`` and points to the row of its last request."""
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    structured, missing = structured_resolutions(requests, alerts)
    added = resolution_rows(structured, last_id(kb), now)
    link = added.groupBy(F.col("alert_id").alias("id")).agg(F.max("id").alias("_kb"))
    done = F.col("_kb").isNotNull()
    updated = (
        join_lookup(alerts, link, "id", "left")
        .withColumns(
            {
                "matched_knowledge_id": F.coalesce("_kb", "matched_knowledge_id"),
                "match_status": F.when(done, "deposited").otherwise(F.col("match_status")),
                "status": F.when(done, "resolved").otherwise(F.col("status")),
                "resolved_at": F.when(done, now).otherwise(F.col("resolved_at")),
                "updated_at": F.when(done, now).otherwise(F.col("updated_at")),
            }
        )
        .select(*alerts.columns)
    )
    rows = added.select(*kb.columns)
    return KnowledgeChange(
        kb=kb.unionByName(rows),
        vectors=upsert_vectors(vectors, vectors_of(rows, dim)),
        rejected=missing,
        alerts=updated,
        added=added,
    )


def deactivate(kb: DataFrame, vectors: DataFrame, ids: DataFrame) -> KnowledgeChange:
    """Soft-delete knowledge rows and remove their vectors; unknown ids are reported."""
    wanted = ids.select("id").distinct()
    flagged = wanted.withColumn("_off", F.lit(True))
    changed = (
        join_lookup(kb, flagged, "id", "left")
        .withColumn("is_active", F.when(F.col("_off"), False).otherwise(F.col("is_active")))
        .select(*kb.columns)
    )
    known = join_lookup(kb.select("id"), wanted, "id", "left_semi")
    return KnowledgeChange(
        kb=changed,
        vectors=delete_vectors(vectors, known.select(F.lit(KNOWLEDGE).alias("namespace"), "id")),
        rejected=wanted.join(known, "id", "left_anti"),
    )
