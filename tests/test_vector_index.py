import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch import Settings
from emberwatch.operators import knn, vector_index

SCHEMA = "namespace string, id bigint, text string, embedding array<float>"


def rows_of(points, first=0, name="n"):
    return [(name, first + i, "", [float(x) for x in p]) for i, p in enumerate(points)]


def triples(df):
    return {(r["query_id"], r["rank"], r["id"], r["similarity"]) for r in df.collect()}


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 24))
    near = np.vstack([centres + 0.2 * rng.standard_normal((30, 24)) for _ in range(12)])
    return np.vstack([near, np.repeat(near[:3], 60, axis=0), np.zeros((2, 24))])  # copies, and vectors without direction


def test_search_equals_the_plain_one_and_most_is_found_in_few_lists(spark, points, tmp_path):
    v = spark.createDataFrame(rows_of(points), SCHEMA)
    q = v.select(F.col("id").alias("query_id"), "embedding")
    path = str(tmp_path / "index")
    vector_index.build_index(v, path)
    small = Settings(knn_block_rows=64)
    want = triples(knn.knn(q, v.where("id < 540"), 5))
    assert triples(vector_index.search_index(q, path, 5, "n", probes=2, exact=True, conf=small)) == want
    some = triples(vector_index.search_index(q, path, 5, "n", probes=6))
    assert len(some & want) / len(want) >= 0.95
    assert vector_index.search_index(q, path, 5, "missing", exact=True).isEmpty()


def test_generations_replace_delete_and_repeat(spark, points, tmp_path):
    path = str(tmp_path / "index")
    vector_index.build_index(spark.createDataFrame(rows_of(points[:200]), SCHEMA), path)
    fresh = spark.createDataFrame(rows_of(points[200:300], first=150), SCHEMA)
    for _ in range(2):  # a repeated batch changes nothing
        vector_index.extend_index(fresh, path, 1, spark.createDataFrame([("n", 0), ("n", 1), ("n", 999)], "namespace string, id bigint"))
    back = rows_of(points[:1]) + [("n", 2, "", [0.0] * 24), ("n", 3, "", None)]
    vector_index.extend_index(spark.createDataFrame(back, SCHEMA), path, 2)
    held = spark.createDataFrame(
        rows_of(points[:1]) + rows_of(points[2:150], first=2) + rows_of(points[200:300], first=150), SCHEMA
    )
    now = vector_index.indexed_vectors(spark, path)
    assert sorted(r["id"] for r in now.collect()) == sorted(r["id"] for r in held.collect())
    q = held.select(F.col("id").alias("query_id"), "embedding")
    want = triples(knn.knn(q, held, 4))
    assert triples(vector_index.search_index(q, path, 4, exact=True)) == want
    again = str(tmp_path / "again")  # a new index of what the old one holds
    vector_index.build_index(now, again, lists=3)
    assert triples(vector_index.search_index(q, again, 4, exact=True)) == want
    with pytest.raises(ValueError):
        vector_index.extend_index(fresh, path, 0)


def test_an_index_begun_empty(spark, points, tmp_path):
    path = str(tmp_path / "index")
    none = spark.createDataFrame([], SCHEMA)
    vector_index.build_index(none, path)
    q = spark.createDataFrame(rows_of(points[:3]), SCHEMA).select(F.col("id").alias("query_id"), "embedding")
    assert vector_index.search_index(q, path, 2, exact=True).isEmpty()
    vector_index.extend_index(spark.createDataFrame(rows_of(points[:5]), SCHEMA), path, 1)
    best = vector_index.search_index(q, path, 2, exact=True).where("rank = 1").collect()
    assert {(r["query_id"], r["id"]) for r in best} == {(0, 0), (1, 1), (2, 2)}


def test_an_index_search_takes_no_second_table(spark, tmp_path):
    with pytest.raises(ValueError):
        vector_index.index_search(str(tmp_path))(None, spark.range(1), 1, None, Settings())


def test_a_small_index_answers_without_copying_queries_to_their_lists(spark, points, tmp_path):
    path = str(tmp_path / "index")
    v = spark.createDataFrame(rows_of(points) + rows_of(points[:40], first=100), SCHEMA)  # some ids twice
    vector_index.build_index(v, path)
    q = v.select(F.col("id").alias("query_id"), "embedding")
    for exact, probes in ((True, 2), (False, 3)):
        local = vector_index.search_index(q, path, 5, probes=probes, exact=exact)
        assert "CoGroups" not in local._jdf.queryExecution().toString()
        blocked = vector_index.search_index(q, path, 5, probes=probes, exact=exact, conf=Settings(broadcast_vectors=0))
        assert "CoGroups" in blocked._jdf.queryExecution().toString()
        assert sorted(map(tuple, local.collect())) == sorted(map(tuple, blocked.collect()))
