"""Raw alerts to triaged alerts, reports and notifications."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch import schemas
from emberwatch.cluster_io import cut
from emberwatch.functions.explain import (
    parse_triage,
    render_notifications,
    rule_report,
    triage_prompts,
)
from emberwatch.functions.logs import parse_logs
from emberwatch.operators.decide import decide, suggest_actions
from emberwatch.operators.listing import merge_payload, notify_gate
from emberwatch.operators.knn import knn_fast
from emberwatch.operators.retrieve import Search, hit_bytes, hit_columns, no_hits, retrieve_asof, text_hits
from emberwatch.operators.skew import join_per_text, measured, shared_texts
from emberwatch.operators.tables import bump_occurrences
from emberwatch.settings import DEFAULTS, Settings

Model = Callable[[list[str], list[str]], list[str]]


@dataclass(frozen=True)
class Triage:
    diagnosed: DataFrame
    """Everything known about each alert, one row per alert."""
    kb: DataFrame

    @property
    def alerts(self) -> DataFrame:
        """Rows of the alert table."""
        return self.diagnosed.select(
            "id", "external_id", "server_ip", "host", "service", "severity", "raw_log",
            "error_message", "stack_trace", "matched_knowledge_id", "similarity_score",
            "match_status", F.lit("open").alias("status"), F.col("plain_language").alias("ai_summary"),
            F.lit(None).cast("string").alias("cluster_key"),
            F.lit(None).cast("timestamp").alias("resolved_at"),
            "created_at", F.col("created_at").alias("updated_at"),
        )

    @property
    def reports(self) -> DataFrame:
        """The diagnostic report of each alert."""
        hits = F.transform(
            "hits",
            lambda h: F.struct(
                h["knowledge_id"].alias("knowledge_id"), h["title"].alias("title"),
                h["similarity"].alias("similarity"), h["error_type"].alias("error_type"),
                h["user_guide"].alias("user_guide"), h["engineer_guide"].alias("engineer_guide"),
            ),
        )
        d = self.diagnosed
        summary = F.col("cluster_summary") if "cluster_summary" in d.columns else F.lit(None)
        return d.select(
            F.col("id").alias("alert_id"),
            (F.col("match_status") == "matched").alias("matched"),
            F.col("similarity_score").alias("best_similarity"),
            "plain_language", "user_actions", "engineer_guide", "suggested_actions",
            hits.alias("retrieval"), summary.cast("string").alias("cluster_summary"),
        )

    def notifications(self, notify: bool = True, notify_on_new: bool = True) -> DataFrame:
        return render_notifications(notify_gate(self.diagnosed, notify, notify_on_new))

    @property
    def knowledge(self) -> DataFrame:
        """The knowledge table with the new occurrence counts."""
        return bump_occurrences(self.kb, self.diagnosed)


def complete_batch(
    df: DataFrame,
    make_model: Callable[[], Model],
    system: str = "",
    prompt: str = "prompt",
    out: str = "answer",
) -> DataFrame:
    """Add ``answer`` from a user's text model, called once per Arrow batch.

    ``make_model`` runs once per partition; the model maps (system texts, prompts) to answers."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            prompts = pdf[prompt].tolist()
            answers = model([system] * len(prompts), prompts) if prompts else []
            yield pdf.assign(**{out: pd.Series(answers, index=pdf.index, dtype="object")})

    return df.mapInPandas(run, schema)


def explain_alerts(
    diagnosed: DataFrame, make_model: Callable[[], Model] | None, system: str = ""
) -> DataFrame:
    """Add the three texts of the report, by rule or by the user's model."""
    if make_model is None:
        return rule_report(diagnosed)
    summary = "cluster_summary" if "cluster_summary" in diagnosed.columns else None
    asked = complete_batch(triage_prompts(diagnosed, summary), make_model, system)
    return parse_triage(asked).drop("prompt", "answer")


def triage(
    alerts: DataFrame,
    kb: DataFrame,
    vectors: DataFrame | None,
    conf: Settings = DEFAULTS,
    make_model: Callable[[], Model] | None = None,
    system: str = "",
    search: Search = knn_fast,
) -> Triage:
    """Triage payload rows (``id, created_at`` and the payload columns); ``search`` as in ``retrieve``.

    Retrieval, decision and suggestions run once per distinct canonical text, while the plan is built; what was
    decided is written, so that alerts, reports, notifications and knowledge do not search again. When
    the texts are few enough to broadcast, the alerts themselves are never shuffled.
    """
    parsed = merge_payload(parse_logs(alerts))
    texts = shared_texts(parsed, "canonical_text")
    size = measured(hit_columns(kb), conf)
    hits = text_hits(texts, vectors, kb, conf.top_k, conf, size, search)
    decided = cut(
        suggest_actions(decide(hits, conf.match_threshold), conf.action_threshold, conf.suggest_actions)
    )
    row_bytes = hit_bytes(size, conf.top_k, conf) + 512
    joined = join_per_text(parsed, "canonical_text", decided, texts, row_bytes, conf).drop("text_key")
    return Triage(explain_alerts(_without_hits(joined), make_model, system), kb)


def triage_asof(
    alerts: DataFrame, kb: DataFrame, vectors: DataFrame, conf: Settings = DEFAULTS
) -> Triage:
    """Triage in which each alert sees the knowledge of its own time (see ``retrieve_asof``)."""
    parsed = merge_payload(parse_logs(alerts))
    found = retrieve_asof(parsed, vectors, kb, conf.top_k, conf, "raw_log")
    decided = suggest_actions(
        decide(found, conf.match_threshold), conf.action_threshold, conf.suggest_actions
    )
    return Triage(explain_alerts(decided, None), kb)


def _without_hits(df: DataFrame) -> DataFrame:
    """Texts that found nothing: a new incident with similarity 0."""
    return df.withColumns(
        {
            "hits": F.coalesce("hits", no_hits()),
            "match_status": F.coalesce("match_status", F.lit("new_incident")),
            "similarity_score": F.coalesce("similarity_score", F.lit(0.0)),
            "suggested_actions": F.coalesce(
                "suggested_actions",
                F.array().cast("array<struct<name:string,label:string,description:string,risk_level:string>>"),
            ),
        }
    )


assert set(schemas.ALERT_VIEW) <= set(schemas.ALERTS.names)
