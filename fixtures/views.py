"""The tables the queries run on, derived in Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.cluster_io import spread
from emberwatch.functions.logs import parse_logs
from emberwatch.plans.knowledge import vectors_of
from emberwatch.sources.tables import with_resolution_defaults
from fixtures import seeds


def exprs(row) -> list[str]:
    return [f"{e} AS {c}" for c, e in row]


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def payloads(self) -> DataFrame:
        """Alert payloads with their id and arrival time: one per event."""
        return spread(self.table("events")).selectExpr(*exprs(seeds.PAYLOAD_ROW))

    def parsed(self) -> DataFrame:
        return parse_logs(self.payloads())

    def stored(self) -> DataFrame:
        """A stored alert table: one row per event."""
        return self.table("events").selectExpr(*exprs(seeds.STORED_ROW))

    def kb(self) -> DataFrame:
        """Knowledge rows: three seeds, and one per benchmark item."""
        seed_rows = self.spark.createDataFrame(
            [(*r, seeds.SEED_TIME) for r in seeds.SEED_KNOWLEDGE], seeds.SEED_SCHEMA
        ).withColumn("created_at", F.col("created_at").cast("timestamp"))
        items = self.table("benchmark").selectExpr(*exprs(seeds.BENCHMARK_ROW))
        return seed_rows.unionByName(items).withColumn("updated_at", F.col("created_at"))

    def vectors(self) -> DataFrame:
        return vectors_of(self.kb())

    def points(self) -> DataFrame:
        """The given vectors, half of them in a second namespace."""
        return self.table("embeddings").selectExpr(
            "CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS namespace",
            "vec_id AS id", "concat('v', label) AS text", "embedding",
        )

    def requests(self) -> DataFrame:
        about = self.table("labels").join(self.table("events"), F.expr("event_id = doc_id * 10"), "left")
        raw = about.selectExpr(*exprs(seeds.REQUEST_ROW))
        return with_resolution_defaults(
            raw.withColumn("tags", F.split("tag_text", ",")).drop("tag_text")
        )
