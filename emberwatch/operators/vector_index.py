"""A vector index kept on storage: inverted lists around centroids, extended by generations.

**Layout.** ``<path>/centroids`` has one row per list, at most ``MAX_LISTS``. ``<path>/vectors/gen=N`` has the rows written
in generation N with their list and similarity to its centroid, sorted by list, so that a search for few lists skips
row groups. Generation 0 is the build; every later one holds one batch of upserts and deletions (rows without
a vector). A generation is one write, visible when it is complete; a repeated batch with the same number
replaces itself. Of the rows of a key the latest generation counts. :func:`build_index` on :func:`indexed_vectors`
makes a new index without the replaced rows.

**Search.** A query visits the lists of its ``probes`` nearest centroids, scored in bounded blocks like ``knn``: a crowded list
is more blocks. With ``exact``, the triangle inequality of angles bounds what every other list can hold, by the
list's largest angle to its centroid. Lists whose bound reaches the query's k-th similarity are visited too, so
the answer equals ``knn``. An index that is small enough to broadcast (measured) travels to the tasks list by list, and queries
visit the same lists there, without a shuffle of queries.

Centroids are fitted on a bounded sample of ``SAMPLE`` vectors; every vector is indexed. Zero and null vectors are not
stored, as in ``upsert_vectors``. An index of no vectors has one list and answers nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.cluster_io import cut
from emberwatch.operators.knn import (
    _CELLS, _FOREVER, _grid, _hit_schema, _prepare_queries, _prepare_vectors, _ranked, unit_rows,
)
from emberwatch.operators.skew import join_lookup
from emberwatch.operators.vectors import KEY, is_zero
from emberwatch.settings import DEFAULTS, Settings

SAMPLE = 16_384
MAX_LISTS = 1_024
PROBES = 16
_HASHES = 1 << 20
_ROUNDS = 8  # of moving the centroids
_ROUNDING = 2e-6  # similarities have 6 decimals


def _fit(vectors: DataFrame, lists: int | None) -> np.ndarray:
    """Unit centroids of a sample taken by the hash of the key; about the root of the number of vectors."""
    n = vectors.count()
    share = min(_HASHES, -(-2 * SAMPLE * _HASHES // max(n, 1)))
    by_hash = F.xxhash64(*KEY)
    sample = vectors.where(F.pmod(by_hash, F.lit(_HASHES)) < share).orderBy(by_hash, *KEY).limit(SAMPLE)
    rows = sample.select("embedding").toPandas()["embedding"]
    if not len(rows):
        return np.zeros((1, 1))
    points = unit_rows(rows)
    lists = min(lists or int(np.ceil(np.sqrt(n))), MAX_LISTS, len(points))
    centroids = points[np.random.default_rng(7).permutation(len(points))[:lists]]
    for _ in range(_ROUNDS):
        nearest = np.argmax(points @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        length = np.linalg.norm(sums, axis=1)
        centroids = np.where(length[:, None] > 0, sums / np.where(length == 0, 1, length)[:, None], centroids)
    return centroids


def _scores(vectors: pd.Series, centroids: np.ndarray) -> np.ndarray:
    unit = unit_rows(vectors)
    if unit.shape[1] != centroids.shape[1]:  # the one list of an index that was built of no vectors
        return np.zeros((len(unit), len(centroids)))
    return np.clip(unit @ centroids.T, -1, 1)


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").toPandas()  # at most MAX_LISTS
    return np.vstack(rows["centroid"].to_numpy())


def _write_generation(rows: DataFrame, centroids: np.ndarray, path: str, generation: int) -> None:
    """Rows with their list; those without a vector (deletions) are in list -1."""
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("near", T.DoubleType())]
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            where, near = np.full(len(pdf), -1, dtype=np.int32), np.full(len(pdf), np.nan)
            real = pdf["embedding"].notna().to_numpy()
            if real.any():
                scores = _scores(pdf.loc[real, "embedding"], centroids)
                where[real], near[real] = scores.argmax(axis=1), scores.max(axis=1)
            yield pdf.assign(list=where, near=near)

    placed = rows.mapInPandas(place, schema)
    placed.sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/vectors/gen={generation}")


def build_index(vectors: DataFrame, path: str, lists: int | None = None) -> None:
    """Write a new index of ``vectors`` (``namespace, id, embedding`` and any other columns; one row per key)."""
    spark = vectors.sparkSession
    real = cut(vectors.where(F.col("embedding").isNotNull() & ~is_zero(F.col("embedding"))))
    centroids = _fit(real, lists)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    _write_generation(real.repartition(parts), centroids, path, 0)


def extend_index(changes: DataFrame, path: str, generation: int, deleted: DataFrame | None = None) -> None:
    """Add a generation: ``changes`` are inserted or replace their keys, the keys of ``deleted`` go.

    A key has at most one row in both together; ``generation`` is above those before it, or repeats its own batch."""
    if generation < 1:
        raise ValueError("generation 0 is the build")
    spark = changes.sparkSession
    columns = [c for c in spark.read.parquet(f"{path}/vectors").columns if c not in ("list", "near", "gen")]
    rows = changes.where(F.col("embedding").isNotNull() & ~is_zero(F.col("embedding"))).select(*columns)
    if deleted is not None:
        types = rows.schema
        gone = [F.col(c) if c in KEY else F.lit(None).cast(types[c].dataType).alias(c) for c in columns]
        rows = rows.unionByName(deleted.select(*KEY).distinct().select(*gone))
    _write_generation(rows, _centroids(spark, path), path, generation)


def _live(spark: SparkSession, path: str, conf: Settings) -> DataFrame:
    rows = spark.read.parquet(f"{path}/vectors")
    # key columns of the later generations only
    last = rows.where("gen > 0").groupBy(*KEY).agg(F.max("gen").alias("_last"))
    kept = join_lookup(rows, last, KEY, "left", conf)
    return kept.where("list >= 0 AND (_last IS NULL OR gen = _last)").drop("_last", "gen")


def indexed_vectors(spark: SparkSession, path: str, conf: Settings = DEFAULTS) -> DataFrame:
    """The vector table that the index holds now."""
    return _live(spark, path, conf).drop("list", "near")


def search_index(
    queries: DataFrame,
    path: str,
    k: int,
    namespace: str | None = None,
    probes: int = PROBES,
    exact: bool = False,
    conf: Settings = DEFAULTS,
) -> DataFrame:
    """``(query_id, rank, id, similarity)`` like the other searches."""
    spark = queries.sparkSession
    centroids = _centroids(spark, path)
    live = _live(spark, path, conf)
    if namespace is not None:
        live = live.where(F.col("namespace") == namespace)
    prepared = _prepare_queries(queries)
    width = min(probes, len(centroids))
    size = live.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0)).alias("bytes")
    ).first()
    if size["rows"] <= conf.broadcast_vectors and size["bytes"] <= conf.broadcast_bytes:
        return _ranked(_search_lists(prepared, live, centroids, k, width, exact), k)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[v is not None and bool(np.any(v)) for v in pdf["embedding"]]]
            if len(pdf):
                scores = _scores(pdf["embedding"], centroids)
                yield pdf.assign(lists=list(np.argpartition(-scores, width - 1, axis=1)[:, :width].astype(np.int32)))

    with_lists = T.StructType([*prepared.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
    asked = cut(prepared.mapInPandas(nearest, with_lists))

    def visit(some: DataFrame) -> DataFrame:
        used = [r[0] for r in some.select(F.explode("lists")).distinct().collect()]  # at most MAX_LISTS
        stored = live if len(used) == len(centroids) else live.where(F.col("list").isin(used))
        bucket = F.col("list").cast("bigint").alias("bucket")
        v = _prepare_vectors(stored.withColumn("id", F.struct(bucket, "id")), None)
        q = some.select("query_id", "embedding", "at", F.explode(F.col("lists").cast("array<bigint>")).alias("bucket"))
        return _grid(q, v.select("id.bucket", "id.id", "embedding", "valid_from", "valid_to"), k, conf)

    hits = visit(asked)
    if exact:
        hits = cut(hits)
        reach = live.groupBy("list").agg(F.min("near").alias("near")).collect()  # at most MAX_LISTS
        angle = np.full(len(centroids), -1.0)  # no vector: no angle
        for r in reach:
            angle[r["list"]] = np.arccos(min(r["near"], 1.0))
        worst = _ranked(hits, k).where(F.col("rank") == k).select("query_id", F.col("similarity").alias("worst"))

        def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                to = np.arccos(_scores(pdf["embedding"], centroids))
                best = np.cos(np.maximum(to - angle, 0)) + _ROUNDING
                may = (best >= pdf["worst"].fillna(-2.0).to_numpy()[:, None]) & (angle >= 0)
                np.put_along_axis(may, np.vstack(pdf["lists"].to_numpy()), False, axis=1)
                found = [np.flatnonzero(m).astype(np.int32) for m in may]
                yield pdf.assign(lists=found).drop(columns="worst")

        open_lists = cut(asked.join(worst, "query_id", "left").mapInPandas(others, asked.schema))
        hits = hits.unionByName(visit(open_lists))
    return _ranked(hits, k)


def _search_lists(
    prepared: DataFrame, live: DataFrame, centroids: np.ndarray, k: int, width: int, exact: bool
) -> DataFrame:
    """``(query_id, id, similarity)``: the best ``k`` of every query's lists, from an index small enough to travel to the
    tasks (checked by the caller). Queries are neither copied to their lists nor shuffled."""
    spark = prepared.sparkSession
    local = live.select("id", "embedding", "list", "near").toArrow().to_pandas()  # few rows and bytes, as measured
    if not len(local):
        return spark.createDataFrame([], _hit_schema(prepared))
    shared = spark.sparkContext.broadcast(local.sort_values("id", ignore_index=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = shared.value
        ids, unit, n = rows["id"].to_numpy(), unit_rows(rows["embedding"]), len(rows)
        members = {c: np.flatnonzero(rows["list"] == c) for c in np.unique(rows["list"])}
        angle = np.full(len(centroids), -1.0)  # no vector: no angle
        for c, at in members.items():
            angle[c] = np.arccos(min(rows["near"].to_numpy()[at].min(), 1.0))
        top, step = min(k, n), max(1, _CELLS // n)

        def visit(vectors: np.ndarray, lists: np.ndarray, order: np.ndarray) -> None:
            """Score the vectors of the wanted lists; one integer orders by similarity, then by id."""
            for c, at in members.items():
                asked = np.flatnonzero(lists[:, c])
                if len(asked):
                    millionths = np.rint(vectors[asked] @ unit[at].T * 1e6).astype(np.int64)
                    order[np.ix_(asked, at)] = millionths * n - at

        for pdf in batches:
            pdf = pdf[[v is not None and bool(np.any(v)) for v in pdf["embedding"]]]
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo : lo + step]
                vectors, scores = unit_rows(part["embedding"]), _scores(part["embedding"], centroids)
                lists = np.zeros(scores.shape, dtype=bool)
                np.put_along_axis(lists, np.argpartition(-scores, width - 1, axis=1)[:, :width], True, axis=1)
                order = np.full((len(part), n), -_FOREVER)
                visit(vectors, lists, order)
                if exact and width < len(centroids):
                    worst = np.partition(order, n - top, axis=1)[:, n - top] if top == k else np.full(len(part), -_FOREVER)
                    # similarity and place from the integer; fewer than k found: every list may hold one
                    least = np.where(worst == -_FOREVER, -2.0, -(-worst // n) / 1e6)
                    best = np.cos(np.maximum(np.arccos(scores) - angle, 0)) + _ROUNDING
                    visit(vectors, (best >= least[:, None]) & (angle >= 0) & ~lists, order)
                cols = np.argpartition(-order, top - 1, axis=1)[:, :top]
                found = np.take_along_axis(order, cols, axis=1)
                i, j = np.nonzero(found > -_FOREVER)
                at = cols[i, j]
                yield pd.DataFrame({
                    "query_id": part["query_id"].to_numpy()[i], "id": ids[at], "similarity": (found[i, j] + at) // n / 1e6,
                })

    return prepared.mapInPandas(run, _hit_schema(prepared))


def index_search(path: str, probes: int = PROBES, exact: bool = False) -> Callable[..., DataFrame]:
    """A ``search`` for ``retrieve``, ``semantic_search`` and ``triage``; their ``vectors`` are then None."""

    def search(queries: DataFrame, vectors: None, k: int, namespace: str | None, conf: Settings) -> DataFrame:
        if vectors is not None:
            raise ValueError("the index holds the vectors: pass None")
        return search_index(queries, path, k, namespace, probes, exact, conf)

    return search
