"""Joins to a table with one row per key, whatever the share of the hottest key.

The lookup side is broadcast only after its size was measured. Beyond the limits both sides are
shuffled, and every hot key (more than 1/hot_fraction of all rows, hence fewer than hot_fraction
keys) is spread over several salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.cluster_io import cut
from emberwatch.operators.embed import distinct_texts, text_key
from emberwatch.settings import DEFAULTS, Settings

_MAX_SALTS = 4096
_ROW_NAMES = ("id", "created_at", "external_id", "host")  # the first two have to be there, or all columns make the salt


def _bytes_of(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    kind = field.dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        return F.coalesce(F.size(c) * 8, F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.coalesce(F.to_json(F.struct(c)), F.lit(""))) + 16
    return F.lit(16)


def measured(df: DataFrame, conf: Settings = DEFAULTS) -> tuple[int, int] | None:
    """(rows, bytes) of a table within the broadcast limits; None for a larger one.

    A plain aggregate: every task sends one row. (A limit before the count would send the limit
    from each of them to a single task.)"""
    size = sum((_bytes_of(f) for f in df.schema.fields), F.lit(0))
    got = df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")
    ).first()
    if got["rows"] > conf.broadcast_rows or got["bytes"] > conf.broadcast_bytes:
        return None
    return got["rows"], got["bytes"]


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    key: str | list[str],
    how: str = "left",
    conf: Settings = DEFAULTS,
    size: tuple[int, int] | None = None,
) -> DataFrame:
    """Join ``rows`` to ``lookup`` (unique ``key``); ``how`` is left, inner, left_anti or left_semi.

    ``size`` is the result of :func:`measured` when the caller has it already."""
    if (size or measured(lookup, conf)) is not None:
        return rows.join(F.broadcast(lookup), key, how)
    keys = [key] if isinstance(key, str) else key
    counts = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return salted_join(rows, lookup, hot_keys(counts, keys, total, conf), keys, how)


def shared_texts(df: DataFrame, text_col: str) -> DataFrame:
    """Distinct texts with row counts, written once because several plans read them."""
    return cut(distinct_texts(df, text_col))


def join_per_text(
    rows: DataFrame,
    text_col: str,
    per_text: DataFrame,
    texts: DataFrame,
    row_bytes: int,
    conf: Settings = DEFAULTS,
) -> DataFrame:
    """Left join ``per_text`` (one row per ``text_key``) to ``rows``.

    ``texts`` (from :func:`shared_texts`) gives the exact number of distinct texts and of rows per
    text, so nothing has to be counted again. Few texts: ``rows`` are not shuffled at all.
    """
    size = texts.agg(
        F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
    ).first()
    keyed = rows.withColumn("text_key", text_key(F.col(text_col)))
    if size["texts"] <= conf.broadcast_rows and size["texts"] * row_bytes <= conf.broadcast_bytes:
        return keyed.join(F.broadcast(per_text), "text_key", "left")
    hot = hot_keys(texts, ["text_key"], size["rows"], conf)
    # a salt of all columns would have every parsed field of a log worked out before the shuffle, wanted or not
    by = [c for c in _ROW_NAMES if c in rows.columns] if set(_ROW_NAMES[:2]) <= set(rows.columns) else None
    return salted_join(keyed, per_text, hot, ["text_key"], "left", by)


def hot_keys(
    counts: DataFrame, keys: list[str], total: int, conf: Settings = DEFAULTS
) -> DataFrame:
    """``(keys, salts)`` of the keys above the hot share: fewer than ``hot_fraction`` rows."""
    share = max(total // conf.hot_fraction, 1)
    return counts.where(F.col("n") > share).select(
        *keys, F.least(F.ceil(F.col("n") / share), F.lit(_MAX_SALTS)).cast("int").alias("salts")
    )


def salted_join(
    rows: DataFrame, lookup: DataFrame, hot: DataFrame, keys: list[str], how: str = "left", by: list[str] | None = None
) -> DataFrame:
    """Join with hot keys spread over salts. A row with a null key matches nothing, however many there are:
    inner and semi joins leave it out, left and anti joins deal it out by its other columns, or those named in ``by``."""
    salt_of = F.xxhash64(*[F.col(f"`{c}`") for c in by or rows.columns if c not in keys])
    nameless = F.lit(False)
    for k in keys:
        nameless = nameless | F.col(f"`{k}`").isNull()
    if how in ("inner", "left_semi"):
        rows = rows.where(~nameless)
    salts = F.when(nameless, F.lit(_MAX_SALTS)).otherwise(F.coalesce("salts", F.lit(1)))
    left = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(salt_of, salts).cast("int"))
        .drop("salts")
    )
    right = (
        lookup.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - F.lit(1)))
        )
        .drop("salts")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
