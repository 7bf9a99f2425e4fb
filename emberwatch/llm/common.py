"""What the operators of this subpackage share: folds, written tables, joins by document."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.cluster_io import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``position``: 0, 1, 2 ... by ``order``, which should part any two rows.

    Rows are dealt to ranges and sorted there; a range begins where the rows of the ranges before it end. The driver
    sees one number per range, and no task more than its range."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stash(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        name,
    ).withColumn("_range", F.shiftright("_place", 33))
    before, total = [], 0
    for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():
        before.append((r["_range"], total))
        total += r["n"]
    base = spark.createDataFrame(before, "_range bigint, _base bigint")
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        dealt.join(F.broadcast(base), "_range").withColumn("position", F.col("_base") + within)
        .drop("_range", "_place", "_base")
    )


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the copy: lineage ends there, and
    a lost executor costs nothing but the tasks it was running."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)
