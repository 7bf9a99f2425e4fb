import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("ckpt").as_uri())
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_alerts(spark):
    """Alert payload rows from (id, seconds, service, raw_log)."""

    def make(rows):
        df = spark.createDataFrame(rows, "id bigint, sec double, service string, raw_log string")
        return df.selectExpr(
            "id", "timestamp_micros(CAST(1704067200000000 + sec * 1000000 AS bigint)) AS created_at",
            "CAST(NULL AS string) AS external_id", "CAST(NULL AS string) AS server_ip",
            "CAST(NULL AS string) AS host", "service", "'error' AS severity", "raw_log",
        )

    return make


@pytest.fixture(scope="session")
def make_kb(spark):
    """Knowledge rows from (id, sample log, title, root_cause, engineer_guide)."""

    def make(rows):
        df = spark.createDataFrame(
            rows, "id bigint, raw_log_sample string, title string, root_cause string, engineer_guide string"
        )
        return df.selectExpr(
            "id", "'Redis' AS error_type", "title", "raw_log_sample", "root_cause", "'u' AS user_guide",
            "engineer_guide", "1 AS occurrence_count", "'manual' AS source", "CAST(NULL AS string) AS tags",
            "1.0D AS confidence", "true AS is_active", "TIMESTAMP '2023-12-31 00:00:00' AS created_at",
            "TIMESTAMP '2023-12-31 00:00:00' AS updated_at",
        )

    return make
