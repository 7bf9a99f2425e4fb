"""Known or new, which actions to offer, and the audit of requested actions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions import fixed_values as V
from emberwatch.settings import DEFAULTS

ACTION_LIST = "array<struct<name:string,label:string,description:string,risk_level:string>>"


def best_match(hits: Column) -> Column:
    """The first hit of an ordered hit list, null without hits."""
    return F.try_element_at(hits, F.lit(1))


def decide(df: DataFrame, threshold: float = DEFAULTS.match_threshold) -> DataFrame:
    """From ``hits``: ``match_status``, ``matched_knowledge_id`` (null unless matched) and
    ``similarity_score`` (the best similarity, 0 without hits)."""
    best = best_match(F.col("hits"))
    df = df.withColumn("similarity_score", F.coalesce(best["similarity"], F.lit(0.0)))
    matched = best.isNotNull() & (F.col("similarity_score") >= threshold)
    return df.withColumns(
        {
            "match_status": F.when(matched, "matched").otherwise("new_incident"),
            "matched_knowledge_id": F.when(matched, best["knowledge_id"]),
        }
    )


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(t)) for t in terms])


def action_names(
    text: Column, confidence: Column, threshold: float, catalog=V.ACTIONS
) -> Column:
    """Ordered distinct action names for a lower-cased incident text."""
    risk = {name: level for name, _, _, level in catalog}

    def names(*items: str) -> Column:
        return F.array(*[F.lit(i) for i in items]).cast("array<string>")

    offered = F.concat(
        F.when(contains_any(text, V.CACHE_WORDS), names("clear_cache", "restart_service")).otherwise(names()),
        F.when(contains_any(text, V.MEMORY_WORDS), names("scale_up", "restart_service")).otherwise(names()),
        F.when(contains_any(text, V.RELEASE_WORDS), names("rollback")).otherwise(names()),
    )
    low = [n for n, level in risk.items() if level == "low"]
    offered = F.when(confidence < threshold, F.filter(offered, lambda n: n.isin(*low))).otherwise(offered)
    return F.array_distinct(F.when(F.size(offered) == 0, names("notify_oncall")).otherwise(offered))


def suggest_actions(
    df: DataFrame,
    threshold: float = DEFAULTS.action_threshold,
    enabled: bool = True,
    catalog=V.ACTIONS,
) -> DataFrame:
    """Add ``suggested_actions``; only matched rows get any. ``catalog`` is a short constant, so
    the look-up is a literal map and needs no join."""
    none = F.array().cast(ACTION_LIST)
    if not enabled:
        return df.withColumn("suggested_actions", none)
    spec = F.create_map(
        *[
            x
            for name, label, description, level in catalog
            for x in (
                F.lit(name),
                F.struct(
                    F.lit(name).alias("name"), F.lit(label).alias("label"),
                    F.lit(description).alias("description"), F.lit(level).alias("risk_level"),
                ),
            )
        ]
    )
    best = best_match(F.col("hits"))
    text = F.lower(F.concat(F.coalesce(best["root_cause"], F.lit("")), F.lit(" "), best["title"]))
    names = action_names(text, F.col("similarity_score"), threshold, catalog)
    found = F.filter(
        F.transform(names, lambda n: F.try_element_at(spec, n)), lambda s: s.isNotNull()
    )
    return df.withColumn(
        "suggested_actions",
        F.when(F.col("match_status") == "matched", found).otherwise(none).cast(ACTION_LIST),
    )


def audit_invocations(requests: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audit rows, requests with an unknown action). ``requests`` carries the outcome in ``ok``
    and ``message``; ``catalog`` is the short action table."""
    known = F.broadcast(catalog.select(F.col("name").alias("action_name")))
    rows = requests.join(known, "action_name", "left_semi").select(
        "action_name", "alert_id", "knowledge_id", "target",
        F.coalesce("triggered_by", F.lit("user")).alias("triggered_by"),
        F.when(F.col("ok"), "ok").otherwise("failed").alias("status"),
        F.col("message").alias("result"),
    )
    return rows, requests.join(known, "action_name", "left_anti")
