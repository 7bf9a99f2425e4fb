"""Vector-table operators: upsert, delete, count, cosine. The key is ``(namespace, id)``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.cluster_io import cut
from emberwatch.operators.skew import join_lookup

KEY = ["namespace", "id"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def cosine(df: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """Cosine similarity of two vector columns, to 6 decimals; 0 when either has no length."""
    va, vb = F.col(a), F.col(b)

    def length(v: Column) -> Column:
        n = F.sqrt(dot(v, v))
        return F.when(n == 0, F.lit(1.0)).otherwise(n)

    return df.withColumn(out, F.round(dot(va, vb) / (length(va) * length(vb)), 6))


def upsert_vectors(base: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Insert or replace by key. Of several changes of a key the one with the highest ``order`` (a change
    number or time, dropped from the result) wins; without ``order`` a key has at most one change. An all-zero
    vector is not stored, and leaves an earlier vector of its key in place; so does a null vector, which
    :func:`rejected_vectors` reports."""
    real = changes.where(F.col("embedding").isNotNull() & ~is_zero(F.col("embedding")))
    if order is not None:
        rest = [c for c in real.columns if c not in (*KEY, order)]
        # the text decides between changes of equal order
        last = F.max_by(F.struct(*rest), F.struct(order, "text"))
        real = real.groupBy(*KEY).agg(last.alias("_last")).select(*KEY, "_last.*").select(*base.columns)
    real = cut(real)  # its keys are measured and looked up, its rows added: embed once, not three times
    return delete_vectors(base, real).unionByName(real)


def rejected_vectors(changes: DataFrame) -> DataFrame:
    """Changes without a vector, or without a key."""
    return changes.where(F.col("embedding").isNull() | F.col("namespace").isNull() | F.col("id").isNull())


def delete_vectors(base: DataFrame, keys: DataFrame) -> DataFrame:
    """Remove keys; an unknown key changes nothing."""
    return join_lookup(base, keys.select(*KEY), KEY, "left_anti")


def count_vectors(base: DataFrame, namespaces: Iterable[str]) -> DataFrame:
    """``(namespace, vectors)`` for every requested namespace; 0 for one that is not there."""
    wanted = base.sparkSession.createDataFrame([(n,) for n in namespaces], "namespace string")
    counts = base.groupBy("namespace").agg(F.count(F.lit(1)).alias("vectors"))
    return (
        F.broadcast(wanted)
        .join(counts, "namespace", "left")
        .select("namespace", F.coalesce("vectors", F.lit(0)).cast("bigint").alias("vectors"))
    )
