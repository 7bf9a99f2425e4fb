"""Streaming jobs. Each micro-batch is an ordinary DataFrame handled by the batch operators; what
must survive between batches is a small table written under the batch id, so a repeated batch
writes the same files again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberwatch.cluster_io import cut
from emberwatch.functions import fixed_values as V
from emberwatch.functions.explain import render_cluster_notifications
from emberwatch.functions.logs import parse_logs
from emberwatch.operators.cluster import cluster_alerts
from emberwatch.plans.triage import Triage, triage
from emberwatch.settings import DEFAULTS, Settings
from emberwatch.sources.sinks import deliver_once, emit_notifications
from emberwatch.sources.tables import split_payloads


def _start(stream: DataFrame, handle, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _write(df: DataFrame, path: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


# --- triage ------------------------------------------------------------------------------------
def stream_triage(
    stream: DataFrame,
    read_kb: Callable[[SparkSession], DataFrame],
    read_vectors: Callable[[SparkSession], DataFrame],
    path: str,
    checkpoint: str,
    conf: Settings = DEFAULTS,
    available_now: bool = False,
    make_sender: Callable[[], Callable[[dict], None]] | None = None,
) -> StreamingQuery:
    """Triage every micro-batch against the knowledge as it is at that moment.

    Writes ``alerts, reports, notifications, occurrences`` and ``rejected`` below ``path``, each under the batch
    id. ``occurrences`` has the matches per knowledge row of a batch; :func:`with_occurrences` adds them to a
    knowledge table. With ``make_sender`` the notifications are delivered too and carry ``ok, error``;
    the ledger below ``deliveries`` keeps a repeated batch from sending them again. Payloads carry ``id, created_at``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        valid, rejected = split_payloads(cut(batch))
        _write(rejected, path, "rejected", batch_id)
        done = triage(valid, read_kb(spark), read_vectors(spark), conf)
        done = Triage(cut(done.diagnosed), done.kb)  # all outputs come from one evaluation
        _write(done.alerts, path, "alerts", batch_id)
        _write(done.reports, path, "reports", batch_id)
        notices = done.notifications(notify_on_new=conf.notify_on_new)
        if make_sender is None:
            notices = emit_notifications(notices)
        else:
            notices = deliver_once(notices, make_sender, f"{path}/deliveries", batch_id, "alert_ids")
        _write(notices, path, "notifications", batch_id)
        matched = done.alerts.where("match_status = 'matched'").groupBy(F.col("matched_knowledge_id").alias("id"))
        _write(matched.agg(F.count(F.lit(1)).alias("matches")), path, "occurrences", batch_id)

    return _start(stream, handle, checkpoint, available_now)


def with_occurrences(kb: DataFrame, path: str) -> DataFrame:
    """``kb`` with the matches of all batches of :func:`stream_triage` added to its counts."""
    found = kb.sparkSession.read.schema("id bigint, matches bigint").parquet(f"{path}/occurrences")
    sums = found.groupBy("id").agg(F.sum("matches").alias("_more"))
    base = F.when(F.coalesce("occurrence_count", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("occurrence_count"))
    more = F.when(F.col("_more").isNull(), F.col("occurrence_count")).otherwise(base + F.col("_more"))
    return kb.join(sums, "id", "left").withColumn("occurrence_count", more.cast("int")).select(*kb.columns)


# --- clusters ------------------------------------------------------------------------------------
_OPEN = (
    "cluster_key bigint, created_at timestamp, canonical_text string, scope string, count bigint, "
    "services array<string>, "
    "examples array<struct<batch:bigint,created_at:timestamp,id:bigint,example:string>>"
)


def stream_clusters(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    window_s: int = DEFAULTS.window_s,
    threshold: float = DEFAULTS.cluster_threshold,
    min_size: int = DEFAULTS.min_cluster_size,
    key: str | None = None,
    lateness_s: int | None = None,
    conf: Settings = DEFAULTS,
    available_now: bool = False,
    make_sender: Callable[[], Callable[[dict], None]] | None = None,
) -> StreamingQuery:
    """Leader clustering of a stream by event time, across services or only within equal ``key``.

    State is the table of open clusters. A cluster closes when the largest event time seen, less
    ``lateness_s`` (default: the window), has left its window; closed clusters of at least
    ``min_size`` alerts become notifications, smaller ones are dropped. Alerts older than the
    lateness go to ``late``. With ``make_sender`` the notifications are delivered, once per cluster, and carry
    ``delivery_key, ok, error``. Writes ``members, clusters, late, rejected, open, clock`` below ``path``."""
    lateness = window_s if lateness_s is None else lateness_s

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        scope = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
        valid, rejected = split_payloads(cut(batch))
        _write(rejected, path, "rejected", batch_id)
        rows = cut(
            parse_logs(valid).select(
                "id", "created_at", "service", "raw_log", "canonical_text", scope.alias("scope")
            )
        )
        state, clock = _previous(spark, path, batch_id)
        oldest = F.lit(clock) - F.expr(f"INTERVAL {lateness} SECONDS") if clock else None
        on_time = rows if oldest is None else rows.where(F.col("created_at") >= oldest)
        if oldest is not None:
            _write(rows.where(F.col("created_at") < oldest), path, "late", batch_id)

        leaders = state.select(F.col("cluster_key").alias("id"), "created_at", "canonical_text", "scope")
        assigned = cut(cluster_alerts(on_time, window_s, threshold, "scope", leaders, conf=conf))
        _write(assigned, path, "members", batch_id)
        now = rows.agg(F.max("created_at")).first()[0]
        clock = max(t for t in (now, clock) if t is not None) if (now or clock) else None

        current = cut(_merged(state, on_time.join(assigned, "id"), batch_id))
        if clock is not None:
            ended = F.col("created_at") + F.expr(f"INTERVAL {window_s + lateness} SECONDS") < F.lit(clock)
        else:
            ended = F.lit(False)
        notices = cluster_notices(current.where(ended), window_s, min_size)
        if make_sender is not None:
            notices = deliver_once(notices, make_sender, f"{path}/deliveries", batch_id, "cluster_key")
        _write(notices, path, "clusters", batch_id)
        _write(current.where(~ended), path, "open", batch_id)
        _write(spark.createDataFrame([(clock,)], "clock timestamp"), path, "clock", batch_id)

    return _start(stream, handle, checkpoint, available_now)


def _previous(spark: SparkSession, path: str, batch_id: int):
    if batch_id > 0:
        before = spark.read.schema(_OPEN).parquet(f"{path}/open/batch={batch_id - 1}")
        return before, spark.read.parquet(f"{path}/clock/batch={batch_id - 1}").first()[0]
    return spark.createDataFrame([], _OPEN), None


def _merged(state: DataFrame, members: DataFrame, batch_id: int) -> DataFrame:
    """Open clusters with the alerts of this batch added. Examples keep their order of arrival."""
    order = Window.partitionBy("cluster_key").orderBy("created_at", "id")
    example = F.struct(
        F.lit(batch_id).cast("bigint").alias("batch"), "created_at", "id",
        F.left("raw_log", F.lit(V.EXAMPLE_CHARS)).alias("example"),
    )
    first = (
        members.select("cluster_key", "created_at", "id", example.alias("e"))
        .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= V.EXAMPLES)
        .groupBy("cluster_key").agg(F.collect_list("e").alias("examples"))
    )
    counts = members.groupBy("cluster_key").agg(
        F.count(F.lit(1)).alias("count"),
        F.collect_set(F.nullif("service", F.lit(""))).alias("services"),
    )
    added = counts.join(first, "cluster_key")
    opened = members.where("is_leader").select("cluster_key", "created_at", "canonical_text", "scope")
    known = state.select("cluster_key", "created_at", "canonical_text", "scope").unionByName(opened)
    both = state.select("cluster_key", "count", "services", "examples").unionByName(added)
    # at most two rows per cluster here: what was known, and what this batch adds
    summed = both.groupBy("cluster_key").agg(
        F.sum("count").alias("count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("services")))).alias("services"),
        F.slice(F.array_sort(F.flatten(F.collect_list("examples"))), 1, V.EXAMPLES).alias("examples"),
    )
    return known.join(summed, "cluster_key").select(*_OPEN_NAMES)


_OPEN_NAMES = ["cluster_key", "created_at", "canonical_text", "scope", "count", "services", "examples"]


def cluster_notices(clusters: DataFrame, window_s: int, min_size: int) -> DataFrame:
    """Notifications of closed clusters."""
    large = clusters.where(F.col("count") >= min_size).select(
        "cluster_key", "count", "services",
        F.transform("examples", lambda e: e["example"]).alias("examples"),
        F.col("created_at").alias("first_seen"),
    )
    return render_cluster_notifications(large, window_s)


def open_clusters(spark: SparkSession, path: str, window_s: int, min_size: int) -> DataFrame:
    """Notifications of the clusters still open after the last batch, to close a finished stream."""
    try:
        latest = spark.read.parquet(f"{path}/clock").agg(F.max("batch")).first()[0]
    except AnalysisException as exc:
        raise ValueError(f"no cluster state below {path}") from exc
    state = spark.read.schema(_OPEN).parquet(f"{path}/open/batch={latest}")
    return cluster_notices(state, window_s, min_size)

