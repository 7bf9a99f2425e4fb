"""Joins between the stored tables, counts, and versioned updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.logs import none_if_empty
from emberwatch.operators.skew import join_lookup
from emberwatch.operators.vectors import count_vectors
from emberwatch.settings import DEFAULTS, KNOWLEDGE, Settings


# --- joins -------------------------------------------------------------------------------------
def alert_detail(alerts: DataFrame, kb: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Alerts with a ``report`` struct, null while ``ai_summary`` is empty."""
    guide = kb.select(
        F.col("id").alias("matched_knowledge_id"), F.col("engineer_guide").alias("_guide")
    )
    report = F.struct(
        (F.col("match_status") == "matched").alias("matched"),
        F.coalesce("similarity_score", F.lit(0.0)).alias("best_similarity"),
        F.col("ai_summary").alias("plain_language"),
        F.lit("").alias("user_actions"),
        F.coalesce("_guide", F.lit("")).alias("engineer_guide"),
    )
    return (
        join_lookup(alerts, guide, "matched_knowledge_id", "left", conf)
        .withColumn("report", F.when(none_if_empty(F.col("ai_summary")).isNotNull(), report))
        .drop("_guide")
    )


def alerts_by_knowledge(kb: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every knowledge row with each of its alerts: one row per alert, one row with nulls for a
    knowledge row without alerts. Kept flat, because one knowledge row may own most alerts."""
    own = alerts.where(F.col("matched_knowledge_id").isNotNull()).select(
        F.col("matched_knowledge_id").alias("knowledge_id"), F.col("id").alias("alert_id"),
        "created_at", "status", "similarity_score",
    )
    titles = kb.select(F.col("id").alias("knowledge_id"), "title")
    matched = join_lookup(own, titles, "knowledge_id", "inner")
    unused = titles.join(own.select("knowledge_id").distinct(), "knowledge_id", "left_anti")
    return matched.unionByName(unused, allowMissingColumns=True)


def split_resolutions(requests: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with the ``raw_log`` of their alert, requests for an unknown alert).

    The alert table is reduced to the requested ids while it is read."""
    ids = requests.select(F.col("alert_id").alias("id")).distinct()
    logs = join_lookup(alerts.select("id", "raw_log"), ids, "id", "left_semi").select(
        F.col("id").alias("alert_id"), "raw_log"
    )
    return (
        requests.join(logs, "alert_id", "inner"),
        requests.join(logs.select("alert_id"), "alert_id", "left_anti"),
    )


def null_dangling_refs(df: DataFrame, kb: DataFrame, ref: str = "matched_knowledge_id") -> DataFrame:
    """References to rows that no longer exist become null."""
    present = kb.select(F.col("id").alias(ref), F.lit(True).alias("_present"))
    joined = join_lookup(df, present, ref, "left")
    return joined.withColumn(ref, F.when(F.col("_present"), F.col(ref))).drop("_present")


# --- counts --------------------------------------------------------------------------------------
def stats(alerts: DataFrame, kb: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of dashboard counts; each table is read once and reduced to one row."""

    def count_if(c):
        return F.count(F.when(c, 1))

    a = alerts.agg(
        F.count("id").alias("alerts_total"),
        count_if(F.col("status") == "open").alias("alerts_open"),
        count_if(F.col("status") == "resolved").alias("alerts_resolved"),
        count_if(F.col("match_status") == "matched").alias("alerts_matched"),
        count_if(F.col("match_status") == "new_incident").alias("alerts_new_incident"),
    )
    b = kb.agg(
        F.count("id").alias("knowledge_total"),
        count_if(F.col("is_active")).alias("knowledge_active"),
    )
    c = readiness(vectors).withColumnRenamed("vectors", "knowledge_vectors")
    one = F.lit(1).alias("_one")
    return (
        a.select("*", one).join(b.select("*", one), "_one").join(c.select("*", one), "_one").drop("_one")
    )


def readiness(vectors: DataFrame, namespace: str = KNOWLEDGE) -> DataFrame:
    return count_vectors(vectors, [namespace]).select("vectors")


def bump_occurrences(kb: DataFrame, triaged: DataFrame) -> DataFrame:
    """Add the number of matched alerts to ``occurrence_count``; other rows are unchanged."""
    hits = (
        triaged.where(F.col("match_status") == "matched")
        .groupBy(F.col("matched_knowledge_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("_hits"))
    )
    base = F.coalesce(F.nullif("occurrence_count", F.lit(0)), F.lit(1))
    bumped = F.when(F.col("_hits").isNull(), F.col("occurrence_count")).otherwise(base + F.col("_hits"))
    # one row per id on both sides: no key can be hot
    return (
        kb.join(hits, "id", "left")
        .withColumn("occurrence_count", bumped.cast("int"))
        .select(*kb.columns)
    )


# --- versioned tables --------------------------------------------------------------------------------
def latest_snapshot(log: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Latest row per key of an append-only log. Of equal versions the row that is larger, column by column.

    ``max_by`` keeps one row per key and task before the shuffle, so a key with very many versions
    is not gathered anywhere."""
    row = F.struct(*[F.col(c) for c in log.columns if c not in keys])
    tie = F.to_json(row, {"ignoreNullFields": "false"})
    best = log.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(version), tie)).alias("_row"))
    return best.select(*keys, "_row.*").select(*log.columns)
