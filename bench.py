"""Times the headline queries on one data folder and prints one JSON line.

``BENCH_SF_DIR`` names the folder, ``BENCH_CPUS`` the number of local threads. Every query is
computed in full; its result is counted by the no-op sink, not collected."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from fixtures.queries import QUERIES  # noqa: E402

HEADLINE = [
    "log_canonical_text", "emb_l2_normalize", "vec_knn", "vec_knn_fast", "join_retrieve", "join_retrieve_asof",
    "join_semantic_search", "agg_stats", "top_recent_alerts", "set_latest_snapshot", "dec_suggest_actions",
    "txt_render_notifications", "flow_triage", "flow_deposit", "flow_replay", "clu_similar_pairs",
    "clu_cluster_alerts", "agg_cluster_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["agg_readiness"](spark, sf_dir).count()  # start the JVM and the Python workers
    spent = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - start, 3)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(spent.values()), 3), "unit": "sec",
                "queries": spent, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
