"""A whole history in one batch, with the answers of handling it one event at a time.

Knowledge made from a resolution depends only on the log and the request, never on retrieval. So
all knowledge is computed first, each row with the time during which it was visible, and every
alert is triaged against the knowledge of its own time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.cluster_io import cut
from emberwatch.operators.skew import join_lookup
from emberwatch.operators.tables import bump_occurrences
from emberwatch.plans.knowledge import (
    last_id,
    resolution_rows,
    structured_resolutions,
    vectors_of,
)
from emberwatch.plans.triage import Triage, triage_asof
from emberwatch.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Replay:
    alerts: DataFrame
    kb: DataFrame
    triage: Triage
    missing: DataFrame
    """Requests whose alert was not there at their time."""


def replay(
    alerts: DataFrame,
    kb: DataFrame,
    requests: DataFrame,
    deletes: DataFrame,
    conf: Settings = DEFAULTS,
) -> Replay:
    """``requests`` carry ``request_no`` and ``requested_at``, ``deletes`` are ``(id, deleted_at)``;
    ``kb`` is the table before the first alert."""
    in_time, unknown = structured_resolutions(requests, alerts)
    arrived = join_lookup(
        alerts.select(F.col("id").alias("alert_id"), F.col("created_at").alias("_arrived")),
        requests.select("alert_id").distinct(), "alert_id", "left_semi", conf,
    )
    dated = join_lookup(in_time, arrived, "alert_id", "inner", conf)
    early = F.col("_arrived") > F.col("requested_at")
    # the knowledge of all times is small beside the alerts and used throughout: made once
    added = cut(resolution_rows(dated.where(~early), last_id(kb), F.col("requested_at")))
    missing = unknown.unionByName(dated.where(early).select(*unknown.columns))

    history = kb.unionByName(added.select(*kb.columns))
    # a delete counts only while its row exists; the first one ends the row
    ended = (
        join_lookup(deletes, history.select("id", "created_at"), "id", "inner", conf)
        .where(F.col("deleted_at") >= F.col("created_at"))
        .groupBy("id")
        .agg(F.min("deleted_at").alias("valid_to"))
    )
    dated_kb = cut(join_lookup(history, ended, "id", "left", conf))
    spans = dated_kb.select("id", F.col("created_at").alias("valid_from"), "valid_to")
    vectors = cut(vectors_of(history, conf.dim).join(spans, "id"))
    # inside its span a row that was deleted later was still active
    shown = dated_kb.withColumn("is_active", F.col("is_active") | F.col("valid_to").isNotNull())
    result = triage_asof(alerts, shown.drop("valid_to"), vectors, conf)

    final_kb = bump_occurrences(
        dated_kb.withColumn("is_active", F.col("is_active") & F.col("valid_to").isNull()).drop("valid_to"),
        result.diagnosed,
    )
    link = added.groupBy(F.col("alert_id").alias("id")).agg(
        F.max("id").alias("_kb"), F.max("created_at").alias("_at")
    )
    done = F.col("_kb").isNotNull()
    triaged = result.alerts
    final_alerts = (
        join_lookup(triaged, link, "id", "left", conf)
        .withColumns(
            {
                "matched_knowledge_id": F.coalesce("_kb", "matched_knowledge_id"),
                "match_status": F.when(done, "deposited").otherwise(F.col("match_status")),
                "status": F.when(done, "resolved").otherwise(F.col("status")),
                "resolved_at": F.coalesce("_at", "resolved_at"),
                "updated_at": F.coalesce("_at", "updated_at"),
            }
        )
        .select(*triaged.columns)
    )
    return Replay(final_alerts, final_kb, result, missing)
