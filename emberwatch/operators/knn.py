"""Top-K similarity joins.

Results are always ``(query_id, rank, id, similarity)`` with the similarity to 6 decimals, ordered
by similarity descending, then id. Pairs are scored block by block with a matrix product, and only
the best K per query and block ever leave a task.

``knn_fast``   a small vector table (size checked) travels to the tasks; queries are not shuffled
``knn``        any size: a grid of bounded query and vector blocks, merged per query
``knn_approx`` the same grid inside random-hyperplane buckets, exact similarities, partial recall

Optional columns make the join time-aware: ``at`` on queries, ``valid_from`` and ``valid_to`` on
vectors (null = open end). A query sees a vector when ``valid_from <= at < valid_to``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.cluster_io import cut
from emberwatch.settings import DEFAULTS, Settings

_FOREVER = 2**62
_CELLS = 1_000_000  # similarities held at once by one task
_SHORT = 64  # neighbours among which those of a query's own time are looked for first


def _prepare_queries(queries: DataFrame) -> DataFrame:
    at = F.unix_micros("at") if "at" in queries.columns else F.lit(0).cast("bigint")
    return queries.select("query_id", "embedding", at.alias("at"))


def _prepare_vectors(vectors: DataFrame, namespace: str | None) -> DataFrame:
    if namespace is not None:
        vectors = vectors.where(F.col("namespace") == namespace)
    if "valid_from" in vectors.columns:
        start = F.coalesce(F.unix_micros("valid_from"), F.lit(-_FOREVER))
        end = F.coalesce(F.unix_micros("valid_to"), F.lit(_FOREVER))
    else:
        start, end = F.lit(-_FOREVER), F.lit(_FOREVER)
    # new column identities, so that a table can be searched for its own rows
    return vectors.select(
        F.col("id").alias("id"), F.col("embedding").alias("embedding"),
        start.alias("valid_from"), end.alias("valid_to"),
    )


def unit_rows(column: pd.Series) -> np.ndarray:
    m = np.vstack(column.to_numpy()).astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(length == 0, 1.0, length)[:, None]


class VectorBlock:
    """Vectors in id order, ready to be scored."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("id")
        self.ids = pdf["id"].to_numpy()
        self.unit = unit_rows(pdf["embedding"])
        self.start = pdf["valid_from"].to_numpy()
        self.end = pdf["valid_to"].to_numpy()

    def best(self, queries: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
        """Equal vectors are scored once; queries at different times choose from the same neighbours."""
        # a query without direction matches nothing
        queries = queries[[bool(np.any(v)) for v in queries["embedding"]]]
        code, _ = pd.factorize(np.array([np.asarray(v).tobytes() for v in queries["embedding"]], dtype=object))
        queries, code = queries.iloc[np.argsort(code, kind="stable")], np.sort(code, kind="stable")
        firsts = np.flatnonzero(np.diff(code, prepend=-1))
        n = len(self.ids)
        timeless = bool((self.start == -_FOREVER).all() and (self.end == _FOREVER).all())
        top = min(n, k if timeless else max(k, _SHORT))
        step = max(1, _CELLS // n)
        for lo in range(0, len(firsts), step):
            vectors = unit_rows(queries["embedding"].iloc[firsts[lo : lo + step]])
            millionths = np.rint(vectors @ self.unit.T * 1e6).astype(np.int64)
            # one integer orders by similarity, then by id
            order = millionths * n - np.arange(n)
            cols = np.argpartition(-order, top - 1, axis=1)[:, :top]
            cols = np.take_along_axis(cols, np.argsort(-np.take_along_axis(order, cols, axis=1), axis=1), axis=1)
            end = firsts[lo + step] if lo + step < len(firsts) else len(queries)
            wide = max(1, _CELLS // top)
            for at in range(firsts[lo], end, wide):
                rows = slice(at, min(at + wide, end))
                yield from self._seen(queries.iloc[rows], code[rows] - lo, millionths, order, cols, k)

    def _seen(self, part: pd.DataFrame, code: np.ndarray, millionths, order, cols, k: int) -> Iterator[pd.DataFrame]:
        """The first ``k`` neighbours that each query sees at its time."""
        at, names, n = part["at"].to_numpy()[:, None], part["query_id"].to_numpy(), len(self.ids)

        def hits(query: np.ndarray, near: np.ndarray, seen: np.ndarray) -> pd.DataFrame:
            i, j = np.nonzero(seen & (np.cumsum(seen, axis=1) <= k))
            flat = near[i, j]
            found = millionths[code[query[i]], flat] / 1e6
            return pd.DataFrame({"query_id": names[query[i]], "id": self.ids[flat], "similarity": found})

        near = cols[code]
        seen = (self.start[near] <= at) & (at < self.end[near])
        enough = np.full(len(part), cols.shape[1] == n) | (seen.sum(axis=1) >= k)
        done = np.flatnonzero(enough)
        yield hits(done, near[done], seen[done])
        rest = np.flatnonzero(~enough)
        step = max(1, _CELLS // n)
        for lo in range(0, len(rest), step):  # too few of the nearest: all are looked at
            query = rest[lo : lo + step]
            open_now = (self.start <= at[query]) & (at[query] < self.end)
            scores = np.where(open_now, order[code[query]], -_FOREVER)
            best = np.argpartition(-scores, min(k, n) - 1, axis=1)[:, : min(k, n)]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, axis=1), axis=1), axis=1)
            yield hits(query, best, np.take_along_axis(open_now, best, axis=1))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("id"))
    return (
        hits.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "similarity")
    )


def _hit_schema(queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, id bigint, similarity double"


def knn_fast(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    namespace: str | None = None,
    conf: Settings = DEFAULTS,
) -> DataFrame:
    """Exact top-K with the vectors sent to the tasks when there are at most ``conf.broadcast_vectors`` of them and
    ``conf.broadcast_bytes`` of their components; otherwise the same rows from :func:`knn`. The
    vectors are evaluated once."""
    prepared = cut(_prepare_vectors(vectors, namespace))
    size = prepared.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0)).alias("bytes")
    ).first()
    if size["rows"] > conf.broadcast_vectors or size["bytes"] > conf.broadcast_bytes:
        return _blocked(queries, prepared, k, conf)
    local = prepared.toArrow()  # few rows and bytes, as measured
    schema = _hit_schema(queries)
    ranked = f"query_id {schema.split(' ')[1].rstrip(',')}, rank int, id bigint, similarity double"
    if local.num_rows == 0:
        return queries.sparkSession.createDataFrame([], ranked)
    shared = queries.sparkSession.sparkContext.broadcast(local.to_pandas())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = VectorBlock(shared.value)
        for pdf in batches:
            if len(pdf):
                for hits in block.best(pdf, k):
                    hits.insert(1, "rank", hits.groupby("query_id", sort=False).cumcount() + 1)
                    yield hits

    return _prepare_queries(queries).mapInPandas(run, ranked)


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    namespace: str | None = None,
    conf: Settings = DEFAULTS,
) -> DataFrame:
    """Exact top-K for tables of any size."""
    return _blocked(queries, _prepare_vectors(vectors, namespace), k, conf)


def _blocked(queries: DataFrame, prepared: DataFrame, k: int, conf: Settings) -> DataFrame:
    q = cut(_prepare_queries(queries)).withColumn("bucket", F.lit(0).cast("bigint"))
    return _ranked(_grid(q, prepared.withColumn("bucket", F.lit(0).cast("bigint")), k, conf), k)


def knn_approx(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    namespace: str | None = None,
    tables: int = 8,
    bits: int = 6,
    seed: int = 7,
    conf: Settings = DEFAULTS,
) -> DataFrame:
    """Top-K among the vectors that share at least one of ``tables`` hyperplane signatures of
    ``bits`` bits with the query. A crowded bucket is split into blocks, never truncated."""
    if bits > 16 or tables > 64:
        raise ValueError("at most 16 bits and 64 tables, so that the bucket table stays small")
    q = _with_buckets(cut(_prepare_queries(queries)), tables, bits, seed)
    v = _with_buckets(_prepare_vectors(vectors, namespace), tables, bits, seed)
    hits = _grid(q, v, k, conf)
    # the same vector can be found through several signatures
    return _ranked(hits.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity")), k)


def _with_buckets(df: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("bucket", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for pdf in batches:
            if not len(pdf):
                continue
            m = unit_rows(pdf["embedding"])
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((m.shape[1], tables * bits))
            signs = (m @ planes > 0).reshape(len(pdf), tables, bits)
            signature = signs @ (1 << np.arange(bits)) + (np.arange(tables) << bits)
            for t in range(tables):
                yield pdf.assign(bucket=signature[:, t])

    return df.mapInPandas(run, schema)


def _grid(q: DataFrame, v: DataFrame, k: int, conf: Settings, meet=None, schema: str | None = None) -> DataFrame:
    """Every query block meets every vector block of its bucket; blocks have a bounded size. ``meet`` may say what
    is done where two blocks meet, with ``schema`` for what comes of it."""
    rows = F.lit(conf.knn_block_rows)
    q_sizes = q.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / rows).alias("q_blocks"))
    v_sizes = v.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / rows).alias("v_blocks"))
    # one row per bucket: one in all for the exact join, at most tables * 2**bits otherwise
    sizes = F.broadcast(q_sizes.join(v_sizes, "bucket"))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    def own(key: str, n: str):
        return F.pmod(F.xxhash64(key), F.col(n))

    q_side = q.join(sizes, "bucket").select(
        "bucket", own("query_id", "q_blocks").alias("qb"), every("v_blocks").alias("vb"),
        "query_id", "embedding", "at",
    )
    v_side = v.join(sizes, "bucket").select(
        "bucket", every("q_blocks").alias("qb"), own("id", "v_blocks").alias("vb"),
        "id", "embedding", "valid_from", "valid_to",
    )
    empty = pd.DataFrame({"query_id": [], "id": [], "similarity": []})

    def score(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(vs):
            return empty
        found = list(VectorBlock(vs).best(qs, k))
        return pd.concat(found, ignore_index=True) if found else empty

    keys = ["bucket", "qb", "vb"]
    return (
        q_side.groupBy(*keys).cogroup(v_side.groupBy(*keys)).applyInPandas(meet or score, schema or _hit_schema(q))
    )
