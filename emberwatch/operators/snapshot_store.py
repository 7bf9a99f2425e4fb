"""The latest row per key, kept on storage and brought up to date by logs of changes.

Rows are dealt to buckets by a hash of their key. A log touches some buckets; only these are read, merged with the log
and written again, into the folder of the new generation. A manifest names for every bucket the generation that
holds it, so a generation is a handful of new folders and older ones stay readable until they are removed.

Layout: ``path/rows/<generation>/bucket=<n>`` and ``path/manifest/generation=<n>``. The manifest is written last: a job that
dies before it changes nothing and may be run again with the same number; a generation that is there is refused,
so a log that is delivered twice is not an error to clean up. Applying a log twice under another number
changes nothing either, as its rows are no newer.

Defined cases: a null in a key is a key of its own; equal versions go to the larger row, as in
:func:`tables.latest_snapshot`; a log may be empty, late (older versions lose) or hold a key many times; before the first
generation there is no snapshot to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.operators.tables import latest_snapshot

BUCKETS = 64  # about as many as fill a file of some hundred MB each
_MANIFEST = "bucket int, held_by int, keys array<string>, version string, buckets int"


def generations(spark: SparkSession, path: str) -> DataFrame:
    """``(generation, bucket, held_by, ...)`` of all generations: a row per bucket in use."""
    return spark.read.schema(f"{_MANIFEST}, generation int").parquet(f"{path.rstrip('/')}/manifest")


def _manifest(spark: SparkSession, path: str, generation: int | None = None) -> list:
    rows = generations(spark, path)
    last = generation if generation is not None else rows.agg(F.max("generation")).first()[0]
    return rows.where(F.col("generation") == last).collect()  # at most a row per bucket


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(log: DataFrame, path: str, generation: int, keys: list[str], version: str, buckets: int, held: dict[int, int]) -> None:
    spark, home = log.sparkSession, path.rstrip("/")
    dealt = log.withColumn("bucket", _bucket(keys, buckets))
    touched = sorted(r["bucket"] for r in dealt.select("bucket").distinct().collect())  # at most ``buckets``
    old = [f"{home}/rows/{held[b]:06d}/bucket={b}" for b in touched if b in held]
    both = log.unionByName(spark.read.schema(log.schema).parquet(*old)) if old else log
    best = latest_snapshot(both, keys, version).withColumn("bucket", _bucket(keys, buckets))
    best.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/rows/{generation:06d}")
    now = held | dict.fromkeys(touched, generation)
    rows = [(b, g, keys, version, buckets) for b, g in sorted(now.items())] or [(None, None, keys, version, buckets)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{home}/manifest/generation={generation}")


def start(log: DataFrame, path: str, keys: list[str], version: str = "version", buckets: int = BUCKETS) -> None:
    """Generation 0: the snapshot of ``log``."""
    _write(log, path, 0, keys, version, buckets, {})


def apply_log(log: DataFrame, path: str, generation: int) -> None:
    """Bring the snapshot up to date by ``log``, whose columns are those of the first log; ``generation`` follows the last."""
    spark = log.sparkSession
    last = generations(spark, path).agg(F.max("generation")).first()[0]
    if generation != last + 1:
        raise ValueError(f"the next generation is {last + 1}, not {generation}")
    before = _manifest(spark, path, last)
    held = {r["bucket"]: r["held_by"] for r in before if r["bucket"] is not None}
    _write(log, path, generation, before[0]["keys"], before[0]["version"], before[0]["buckets"], held)


def snapshot(spark: SparkSession, path: str, schema: str, generation: int | None = None) -> DataFrame:
    """The latest row per key as of a generation, the last one by default."""
    home = path.rstrip("/")
    held = [r for r in _manifest(spark, path, generation) if r["bucket"] is not None]
    folders = [f"{home}/rows/{r['held_by']:06d}/bucket={r['bucket']}" for r in held]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def removable(spark: SparkSession, path: str, keep: int = 2) -> DataFrame:
    """``(folder)``: folders that none of the last ``keep`` generations reads, for the storage's own clean-up."""
    rows = generations(spark, path).where("bucket is not null")
    first_kept = F.lit(rows.agg(F.max("generation")).first()[0] - keep + 1)
    used = rows.where(F.col("generation") >= first_kept).select("bucket", "held_by").distinct()
    gone = rows.where(F.col("generation") < first_kept).select("bucket", "held_by").distinct().join(used, ["bucket", "held_by"], "left_anti")
    return gone.select(F.format_string(f"{path.rstrip('/')}/rows/%06d/bucket=%d", "held_by", "bucket").alias("folder"))
