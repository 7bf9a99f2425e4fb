"""Session-level helpers: where shared checkpoints go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a missing
    setting is an error, because a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = Path(tempfile.mkdtemp(prefix="emberwatch-ckpt-")).as_uri()
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, part: str | None = None, near: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and continue from the written copy. With ``part``
    its rows lie in one folder per value of that column, and rows equal in ``part`` and ``near`` in one file.

    A table, not ``checkpoint()``: a checkpointed frame keeps the size that was estimated for its plan, and every
    join multiplies the sizes of its sides. In a loop the digits of the estimate double per round, until planning
    takes longer than the work. A written table has the size of its files."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    if part is None:
        df.write.parquet(path)
    else:
        df.repartition(part, *(near or [])).write.partitionBy(part).parquet(path)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for CPU-heavy work on an input with fewer partitions than cores, such as a
    few small files. An input that already fills the cluster is returned as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
