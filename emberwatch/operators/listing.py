"""Filters, read views, display columns and ordered listings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch import schemas
from emberwatch.functions import fixed_values as V
from emberwatch.functions.logs import none_if_empty, strip
from emberwatch.operators.skew import join_lookup

ALERT_SEARCH = ("raw_log", "error_message")
KNOWLEDGE_SEARCH = ("title", "raw_log_sample", "root_cause")


# --- filters -----------------------------------------------------------------------------------
def filter_alerts(
    df: DataFrame,
    status: str | None = None,
    match_status: str | None = None,
    service: str | None = None,
) -> DataFrame:
    """Equality filters; an empty argument filters nothing."""
    for name, value in (("status", status), ("match_status", match_status), ("service", service)):
        if value:
            df = df.where(F.col(name) == value)
    return df


def filter_dates(
    df: DataFrame, on: str | None = None, frm: str | None = None, to: str | None = None
) -> DataFrame:
    """Calendar dates (``yyyy-MM-dd``) of ``created_at``; both bounds belong to the range."""
    day = F.to_date("created_at")
    if on:
        df = df.where(day == F.lit(on).cast("date"))
    if frm:
        df = df.where(day >= F.lit(frm).cast("date"))
    if to:
        df = df.where(day <= F.lit(to).cast("date"))
    return df


def filter_keyword(df: DataFrame, q: str | None, cols: tuple[str, ...] = ALERT_SEARCH) -> DataFrame:
    """Case-insensitive substring in any of the columns; ``%`` and ``_`` act as wildcards."""
    if not q:
        return df
    pattern = "%" + q.replace("\\", "\\\\") + "%"
    return df.where(reduce(or_, [F.col(c).ilike(pattern) for c in cols]))


def filter_error_type(df: DataFrame, error_type: str | None) -> DataFrame:
    return df.where(F.col("error_type") == error_type) if error_type else df


def active_only(kb: DataFrame) -> DataFrame:
    return kb.where("is_active")


def notify_gate(df: DataFrame, notify: bool = True, notify_on_new: bool = True) -> DataFrame:
    """Alerts that are to be notified."""
    if not notify:
        return df.where(F.lit(False))
    return df if notify_on_new else df.where(F.col("match_status") == "matched")


def by_ids(df: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with these ids, ids without a row). ``ids`` has one column ``id``."""
    wanted = ids.select("id").distinct()
    found = join_lookup(df, wanted, "id", "left_semi")
    # only the keys found travel to the second join, never the whole table
    return found, wanted.join(found.select("id"), "id", "left_anti")


# --- projections ---------------------------------------------------------------------------------
def tag_list(tags: Column) -> Column:
    """Comma-joined tags as an array: trimmed, blanks dropped, empty for null."""
    parts = F.transform(F.split(F.coalesce(tags, F.lit("")), ","), strip)
    return F.filter(parts, lambda t: t != "")


def alert_view(df: DataFrame) -> DataFrame:
    return df.select(*schemas.ALERT_VIEW)


def knowledge_view(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", tag_list(F.col("tags"))).select(*schemas.KNOWLEDGE_VIEW)


def merge_payload(df: DataFrame) -> DataFrame:
    """Payload values win when not empty; the severity is always the parsed one."""
    return df.withColumns(
        {
            "server_ip": F.coalesce(none_if_empty(F.col("server_ip")), F.col("log_server_ip")),
            "service": F.coalesce(none_if_empty(F.col("service")), F.col("log_service")),
            "severity": F.col("log_severity"),
        }
    ).drop("log_server_ip", "log_service", "log_severity")


def display_columns(df: DataFrame) -> DataFrame:
    """``service_text, time_text, similarity_text`` as a table shows them."""
    named = F.coalesce(none_if_empty(F.col("service")), none_if_empty(F.col("host")), F.lit("-"))
    return df.withColumns(
        {
            "service_text": named,
            "time_text": F.coalesce(F.date_format("created_at", V.TIME_FORMAT), F.lit("-")),
            "similarity_text": F.when(
                F.col("similarity_score").isNotNull(),
                F.format_string("%.1f%%", F.round(F.col("similarity_score") * 100, 1)),
            ).otherwise("-"),
        }
    )


def _choose(c: Column, pairs, default: Column) -> Column:
    out = default
    for key, value in reversed(list(pairs)):
        out = F.when(c == key, value).otherwise(out)
    return out


def status_labels(df: DataFrame) -> DataFrame:
    """Labels and badge classes of match status, status and severity."""
    m, s = F.col("match_status"), F.col("status")
    level = F.upper("severity")
    badge = F.lit("default")
    for name, members in V.SEVERITY_CLASSES:
        badge = F.when(level.isin(*members), name).otherwise(badge)
    plain = F.lit("default")
    return df.withColumns(
        {
            "match_label": _choose(m, ((k, F.lit(t)) for k, t, _ in V.MATCH_LABELS), m),
            "match_class": _choose(m, ((k, F.lit(c)) for k, _, c in V.MATCH_LABELS), plain),
            "status_label": _choose(s, ((k, F.lit(t)) for k, t, _ in V.STATUS_LABELS), s),
            "status_class": _choose(s, ((k, F.lit(c)) for k, _, c in V.STATUS_LABELS), plain),
            "severity_class": badge,
        }
    )


# --- ordered listings: a sort with a limit keeps only the best rows of each task ------------------
def _checked(limit: int) -> int:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    return limit


def recent_alerts(df: DataFrame, limit: int = 50) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(_checked(limit))


def top_knowledge(df: DataFrame, limit: int = 50) -> DataFrame:
    order = [F.desc("occurrence_count"), F.desc("created_at"), F.desc("id")]
    return active_only(df).orderBy(*order).limit(_checked(limit))


def recent_knowledge(df: DataFrame, limit: int = 20) -> DataFrame:
    return active_only(df).orderBy(F.desc("created_at"), F.desc("id")).limit(_checked(limit))
