"""Retrieval joins: alerts or free text against the knowledge table.

All work on vectors is done once per distinct canonical text; the ordered hit list is then joined
back to the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.cluster_io import cut
from emberwatch.functions.logs import parse_logs
from emberwatch.operators.asof import last_change
from emberwatch.operators.embed import embed_texts, text_key
from emberwatch.operators.knn import knn_fast
from emberwatch.operators.knn_asof import knn_asof
from emberwatch.operators.listing import knowledge_view
from emberwatch.operators.skew import hot_keys, join_lookup, join_per_text, measured, salted_join, shared_texts
from emberwatch.settings import DEFAULTS, KNOWLEDGE, Settings

Search = Callable[..., DataFrame]  # (queries, vectors, k, namespace, conf) -> ranked neighbours

HIT = (
    "struct<knowledge_id:bigint,title:string,similarity:double,error_type:string,raw_log:string,"
    "user_guide:string,engineer_guide:string,root_cause:string>"
)


def hit_columns(kb: DataFrame) -> DataFrame:
    return kb.where("is_active").select(
        "id", "title", "error_type", F.col("raw_log_sample").alias("raw_log"), "user_guide",
        "engineer_guide", "root_cause",
    )


def hit_lists(
    ranked: DataFrame, kb: DataFrame, conf: Settings = DEFAULTS, size: tuple[int, int] | None = None
) -> DataFrame:
    """``(query_id, hits)`` from ranked neighbours. K was applied before, so the filter on active
    knowledge can leave fewer than K hits. A list holds at most K entries."""
    joined = join_lookup(ranked, hit_columns(kb), "id", "inner", conf, size)
    hit = F.struct(
        F.col("id").alias("knowledge_id"), "title", "similarity", "error_type", "raw_log",
        "user_guide", "engineer_guide", "root_cause",
    )
    ordered = F.sort_array(F.collect_list(F.struct("rank", hit.alias("hit"))))
    return joined.groupBy("query_id").agg(F.transform(ordered, lambda r: r["hit"]).alias("hits"))


def text_hits(
    texts: DataFrame, vectors: DataFrame | None, kb: DataFrame, k: int, conf: Settings, size=None, search: Search = knn_fast
) -> DataFrame:
    """``(text_key, hits)`` for distinct texts."""
    queries = embed_texts(texts, conf.dim).withColumnRenamed("text_key", "query_id")
    ranked = search(queries, vectors, k, KNOWLEDGE, conf)
    return hit_lists(ranked, kb, conf, size).withColumnRenamed("query_id", "text_key")


def hit_bytes(size: tuple[int, int] | None, k: int, conf: Settings = DEFAULTS) -> int:
    """Bytes to expect for one hit list, from the measured size of the knowledge table."""
    if size is None:
        return conf.broadcast_bytes  # nothing is broadcast
    return 64 + k * (size[1] // max(size[0], 1) + 64)


def no_hits():
    return F.array().cast(f"array<{HIT}>")


def retrieve(
    alerts: DataFrame,
    vectors: DataFrame | None,
    kb: DataFrame,
    k: int = DEFAULTS.top_k,
    conf: Settings = DEFAULTS,
    search: Search = knn_fast,
) -> DataFrame:
    """Add ``hits``: the ordered active knowledge rows among the K most similar vectors. Needs
    ``canonical_text``. ``search`` may be any of ``knn``, or ``index_search`` with ``vectors`` None."""
    texts = shared_texts(alerts, "canonical_text")
    size = measured(hit_columns(kb), conf)
    per_text = text_hits(texts, vectors, kb, k, conf, size, search)
    joined = join_per_text(alerts, "canonical_text", per_text, texts, hit_bytes(size, k, conf), conf)
    return joined.drop("text_key").withColumn("hits", F.coalesce("hits", no_hits()))


def semantic_search(
    queries: DataFrame,
    vectors: DataFrame | None,
    kb: DataFrame,
    k: int = 5,
    conf: Settings = DEFAULTS,
    search: Search = knn_fast,
) -> DataFrame:
    """``(query_id, rank, similarity, knowledge columns)`` for free-text ``(query_id, q)``."""
    if not 1 <= k <= 50:
        raise ValueError("k must be between 1 and 50")
    logs = parse_logs(queries.select("query_id", "q"), "q").where(F.length("q") > 0)
    texts = shared_texts(logs, "canonical_text")
    vecs = embed_texts(texts, conf.dim).withColumnRenamed("text_key", "query_id")
    ranked = search(vecs, vectors, k, KNOWLEDGE, conf).withColumnRenamed("query_id", "text_key")
    keyed = logs.select("query_id", text_key(F.col("canonical_text")).alias("text_key"))
    found = join_lookup(ranked, knowledge_view(kb.where("is_active")), "id", "inner", conf)
    per_text = found.groupBy("text_key").agg(
        F.collect_list(F.struct(*[c for c in found.columns if c != "text_key"])).alias("found")
    )
    joined = join_lookup(keyed, per_text, "text_key", "inner", conf)
    return joined.select("query_id", F.explode("found").alias("f")).select("query_id", "f.*")


def retrieve_asof(
    alerts: DataFrame,
    vectors: DataFrame,
    kb: DataFrame,
    k: int = DEFAULTS.top_k,
    conf: Settings = DEFAULTS,
    raw: str | None = None,
) -> DataFrame:
    """Retrieval in which an alert sees the vectors of its own time: ``valid_from <= created_at <
    valid_to``, both columns of ``vectors``.

    What an alert sees depends on its text and on how many of the changes came before it, so equal
    texts between two changes are one query. With ``raw``, the column that ``canonical_text`` was parsed from, equal
    logs are parsed once.
    """
    log = raw or "canonical_text"
    keyed = _with_last_change(alerts, vectors, conf).withColumns(
        {"text_key": text_key(F.col(log)), "_at": F.unix_micros("_at")}
    )
    # written once: counted, searched for, and looked up for hot ones
    pairs = cut(
        keyed.select("text_key", F.col(log).alias("text"), "_at").where("text IS NOT NULL")
        .groupBy("text_key", "text", "_at").agg(F.count(F.lit(1)).alias("n"))
    )
    size = pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.approx_count_distinct("_at").alias("times"),
    ).first()
    part = F.pmod(F.xxhash64("_at"), F.lit(1 + size["times"] // _TIMES))
    logs = pairs.groupBy("text_key", "text", part.alias("part")).agg(F.collect_list("_at").alias("at"))
    if raw is not None:
        logs = parse_logs(logs, "text").select("text_key", F.col("canonical_text").alias("text"), "at")
    # different logs of one canonical text meet in few tasks, which work out its vector and its similarities once
    by = F.xxhash64("text", F.pmod(F.xxhash64("text_key"), F.lit(_DEALT)))
    queries = embed_texts(logs, conf.dim, ("at",), by).withColumnRenamed("text_key", "query_id")
    found = (
        knn_asof(queries, vectors, k, KNOWLEDGE, conf)
        .withColumnsRenamed({"query_id": "text_key", "at": "_at"})
    )
    active = cut(hit_columns(kb))
    kb_size = measured(active, conf)
    if k <= _PLACES and kb_size is not None and active.groupBy("id").count().where("count > 1").isEmpty():
        joined = _hits_by_place(_join_pairs(keyed, found, pairs, size, 16 * k + 64, conf), active, k)
    else:
        each = found.select(F.struct("text_key", "_at").alias("query_id"), F.posexplode(F.arrays_zip("ids", "similarities")))
        ranked = each.select("query_id", F.col("pos").alias("rank"), F.col("col.ids").alias("id"), "col.similarities")
        lists = hit_lists(ranked.withColumnRenamed("similarities", "similarity"), kb, conf, kb_size)
        joined = _join_pairs(keyed, lists.select("query_id.*", "hits"), pairs, size, hit_bytes(kb_size, k, conf), conf)
    return joined.drop("text_key", "_at").withColumn("hits", F.coalesce("hits", no_hits()))


_TIMES = 65_536  # about as many times at most are asked with one row of a text
_DEALT = 8  # tasks that share the logs of one canonical text
_PLACES = 8  # hits are looked up place by place in a small table, up to so many


def _join_pairs(rows: DataFrame, per_pair: DataFrame, pairs: DataFrame, size, row_bytes: int, conf: Settings) -> DataFrame:
    """Left join of what was found per text and time; ``pairs`` and ``size`` give their number and that of their rows."""
    keys = ["text_key", "_at"]
    if size["pairs"] <= conf.broadcast_rows and size["pairs"] * row_bytes <= conf.broadcast_bytes:
        return rows.join(F.broadcast(per_pair), keys, "left")
    by = [c for c in ("id", "created_at") if c in rows.columns]
    return salted_join(rows, per_pair, hot_keys(pairs.select(*keys, "n"), keys, size["rows"], conf), keys, "left", by)


def _hits_by_place(rows: DataFrame, active: DataFrame, k: int) -> DataFrame:
    """``hits`` from ``ids`` and ``similarities`` without regrouping: the small table is looked up once per place."""
    for i in range(k):
        row = F.struct(*[c for c in active.columns if c != "id"])
        place = active.select(F.col("id").alias(f"_id{i}"), row.alias(f"_row{i}"))
        rows = rows.withColumn(f"_id{i}", F.get("ids", F.lit(i))).join(F.broadcast(place), f"_id{i}", "left")

    def hit(i: int):
        row = F.col(f"_row{i}")
        fields = {
            "knowledge_id": F.col(f"_id{i}"), "title": row["title"], "similarity": F.get("similarities", F.lit(i)),
            **{c: row[c] for c in ("error_type", "raw_log", "user_guide", "engineer_guide", "root_cause")},
        }
        return F.when(row.isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))

    hits = F.filter(F.array(*[hit(i) for i in range(k)]), lambda h: h.isNotNull())
    return rows.withColumn("hits", hits).drop("ids", "similarities", *[f"{n}{i}" for n in ("_id", "_row") for i in range(k)])


_NEVER = "0001-01-01"


def _with_last_change(alerts: DataFrame, vectors: DataFrame, conf: Settings) -> DataFrame:
    """``alerts`` with ``_at``: the time of the last change of ``vectors`` at or before the alert (year 1: none)."""
    changes = vectors.select(F.explode(F.array("valid_from", "valid_to")).alias("_change"))
    joined = last_change(alerts, "created_at", changes, "_change", "_at", conf)
    return joined.withColumn("_at", F.coalesce("_at", F.lit(_NEVER).cast("timestamp")))
