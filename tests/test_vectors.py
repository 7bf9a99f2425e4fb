import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberwatch import Settings
from emberwatch.operators import embed, knn, skew, vectors
from emberwatch.operators.knn_asof import knn_asof
from fixtures.queries import ORACLE, QUERIES


def expected_vector(text, dim=256):
    """The formula, restated with plain Python."""
    v = np.zeros(dim)
    low = text.lower()

    def bucket(f):
        return int(hashlib.md5(f.encode()).hexdigest()[17:], 16) % dim

    toks = re.findall(r"[a-z][a-z0-9_]+", low)
    for tok, n in Counter(toks).items():
        w = 0.0
        for _ in range(n):
            w = 1 + math.log(w + 2)
        v[bucket(tok)] += w
    for a, b in zip(toks, toks[1:]):
        v[bucket(f"{a}_{b}")] += 1
    p = f"^{low}$" if text else ""
    for i in range(len(p) - 2):
        v[bucket("c3:" + p[i : i + 3])] += 1
    n = np.linalg.norm(v)
    return v / n if n else v


TEXTS = [
    "JedisConnectionException redis connection refused timeout",
    "JedisConnectionException Failed connecting to redis connection timed out",
    "certificate expired ssl handshake failed",
    "",
    "a",
    "emoji 😀😀 ÀÉ repeat repeat repeat repeat " + "word " * 200,
]


@pytest.mark.parametrize("dim", [256, 100])
def test_embedding_matches_formula(spark, dim):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    got = {r["id"]: np.array(r["embedding"]) for r in embed.embed(df, "t", dim).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert np.allclose(got[i], expected_vector(t, dim), atol=1e-6), t
    if dim == 256:
        assert got[0] @ got[1] > 0.7
        assert got[0] @ got[2] < 0.6
        assert not got[3].any()


def test_embed_batch_keeps_order_and_checks_length(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(20)], "id int, t string")
    got = embed.embed_batch(df, "t", lambda: lambda ts: [[float(len(t))] for t in ts]).collect()
    assert all(r["embedding"] == [float(r["id"])] for r in got)
    with pytest.raises(Exception, match="returned 0 vectors"):
        embed.embed_batch(df, "t", lambda: lambda ts: []).collect()


def unit(i, dim=8):
    return [1.0 if j == i else 0.0 for j in range(dim)]


@pytest.fixture
def store(spark):
    rows = [("knowledge", i, f"t{i}", unit(i)) for i in range(3)]
    return spark.createDataFrame(rows, "namespace string, id bigint, text string, embedding array<float>")


def test_upsert_search_delete_count(spark, store):
    q = spark.createDataFrame([("q", unit(0))], "query_id string, embedding array<float>")
    hits = knn.knn_fast(q, store, 2, "knowledge").orderBy("rank").collect()
    assert [(h["id"], h["similarity"]) for h in hits] == [(0, 1.0), (1, 0.0)]
    left = vectors.delete_vectors(store, spark.createDataFrame([("knowledge", 0), ("x", 1)], "namespace string, id bigint"))
    counts = {r["namespace"]: r["vectors"] for r in vectors.count_vectors(left, ["knowledge", "missing"]).collect()}
    assert counts == {"knowledge": 2, "missing": 0}
    change = spark.createDataFrame(
        [("knowledge", 1, "new", unit(5)), ("knowledge", 9, "zero", [0.0] * 8)], store.schema
    )
    after = {r["id"]: r["text"] for r in vectors.upsert_vectors(store, change).collect()}
    assert after == {0: "t0", 1: "new", 2: "t2"}


@pytest.mark.parametrize("search", [knn.knn_fast, knn.knn, knn.knn_approx])
def test_nothing_to_find(spark, store, search):
    q = spark.createDataFrame([("zero", [0.0] * 8), ("q", unit(1))], "query_id string, embedding array<float>")
    assert {r["query_id"] for r in search(q, store, 9, "knowledge").collect()} == {"q"}
    assert search(q, store, 3, "missing").collect() == []
    assert search(q, store, 9, "knowledge").columns == ["query_id", "rank", "id", "similarity"]


def test_ties_blocks_and_recall(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    points = np.vstack([base + 0.05 * rng.standard_normal((40, 16)) for _ in range(5)] + [base[:10], base[:10]])
    rows = [("n", i, "", [float(x) for x in p]) for i, p in enumerate(points)]
    v = spark.createDataFrame(rows, "namespace string, id bigint, text string, embedding array<float>").cache()
    q = v.select(F.col("id").alias("query_id"), "embedding")
    m = np.array([r[3] for r in rows], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    sims = np.round(m @ m.T, 6)
    want = {(i, int(j)) for i in range(len(m)) for j in sorted(range(len(m)), key=lambda j: (-sims[i, j], j))[:4]}
    small = Settings(knn_block_rows=32, broadcast_vectors=50)
    for got in (knn.knn_fast(q, v, 4), knn.knn_fast(q, v, 4, conf=small), knn.knn(q, v, 4, conf=small)):
        assert {(r["query_id"], r["id"]) for r in got.collect()} == want
    found = {(r["query_id"], r["id"]) for r in knn.knn_approx(q, v, 4, tables=8, bits=5, conf=small).collect()}
    assert len(found & want) / len(want) > 0.9


def test_salted_join_equals_plain_join(spark):
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 50) END AS t")
    texts = skew.shared_texts(rows, "t")
    per_text = texts.select("text_key", F.upper("text").alias("u"))
    conf = Settings(broadcast_rows=5, hot_fraction=20)
    got = skew.join_per_text(rows, "t", per_text, texts, 10, conf)
    assert "_salt" not in got.columns
    assert got.where("u = upper(t)").count() == 4000 and got.select("id").distinct().count() == 4000
    lookup = spark.range(40).selectExpr("concat('t', id) AS t", "id AS x")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a = skew.join_lookup(rows, lookup, "t", how, conf)
        b = rows.join(lookup, "t", how).select(*a.columns)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    hot = skew.hot_keys(texts, ["text_key"], 4000, conf).collect()
    assert len(hot) == 1 and hot[0]["salts"] > 1


def test_null_keys_survive_the_salted_left_join(spark):
    rows = spark.range(300).selectExpr("id", "CASE WHEN id % 2 = 0 THEN NULL ELSE id % 7 END AS k")
    lookup = spark.range(7).selectExpr("id AS k", "'v' AS v")
    got = skew.join_lookup(rows, lookup, "k", "left", Settings(broadcast_rows=2, hot_fraction=10))
    assert got.count() == 300 and got.where("v IS NULL").count() == 150


def test_embedding_makes_no_rows_of_features(spark):
    """One shuffle of the texts; features are neither rows nor groups."""
    df = spark.createDataFrame([(1, t) for t in TEXTS] + [(1, None)], "id int, t string")
    vec = embed.embed_texts(embed.distinct_texts(df, "t").drop("n"))
    plan = vec._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan
    steps = embed.normalised(embed.bucket_weights(embed.feature_weights(embed.feature_rows(embed.distinct_texts(df, "t")))))
    want = {r["text_key"]: r["embedding"] for r in steps.collect()}
    got = {r["text_key"]: r["embedding"] for r in vec.collect()}
    assert got.keys() == want.keys() and len(got) == len(TEXTS) + 1
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_parts_are_bounded():
    long = "x" * (embed._PART_CHARS + 5)
    texts = ["a"] * 3 + [long, long, "b"] + ["c"] * (embed._PART_TEXTS + 1)
    parts = list(embed._parts(texts))
    assert [b for _, b in parts[:-1]] == [a for a, _ in parts[1:]] and parts[0][0] == 0 and parts[-1][1] == len(texts)
    assert all(b - a == 1 or sum(map(len, texts[a:b])) <= embed._PART_CHARS and b - a <= embed._PART_TEXTS for a, b in parts)


def test_changes_are_evaluated_once(spark, store):
    seen, vector = spark.sparkContext.accumulator(0), unit(1)

    def make_model():
        def model(texts):
            seen.add(len(texts))
            return [vector] * len(texts)

        return model

    rows = spark.createDataFrame([("knowledge", 1, "n"), ("knowledge", 9, "n")], "namespace string, id bigint, text string")
    assert vectors.upsert_vectors(store, embed.embed_batch(rows, "text", make_model)).count() == 4
    assert seen.value == 2


def test_models_get_texts_in_bounded_runs(spark):
    """A batch of 3,000 rows is not one call, and what is not asked about does not become Python objects."""
    def make_model():
        return lambda texts: [[float(len(texts))] for _ in texts]

    df = spark.range(3000).coalesce(1).selectExpr("id", "if(id = 5, null, string(id)) AS t", "array(id) AS other")
    got = embed.embed_batch(df, "t", make_model).collect()
    assert [r["other"] for r in got] == [[i] for i in range(3000)]
    assert max(r["embedding"][0] for r in got) <= embed._MODEL_ROWS


def test_queries_at_many_times_share_the_scores_of_their_vector():
    """All of the nearest are over for some queries: these still get the right ones, and equal vectors are scored once."""
    rng, n = np.random.default_rng(2), 400
    block = knn.VectorBlock(pd.DataFrame({
        "id": range(n), "embedding": list(rng.normal(size=(n, 8))),
        "valid_from": rng.integers(0, 50, n), "valid_to": rng.integers(50, 100, n),
    }))
    vectors_ = rng.normal(size=(3, 8))
    block.start[np.argsort(-(knn.unit_rows(pd.Series(list(vectors_)))[0] @ block.unit.T))[:200]] = 90
    at = np.arange(300) % 101
    queries = pd.DataFrame({"query_id": range(300), "embedding": [vectors_[i % 3] for i in range(300)], "at": at})
    scored, rows = [], knn.unit_rows
    knn.unit_rows = lambda column: scored.append(len(column)) or rows(column)
    try:
        got = pd.concat(block.best(queries, 4))
    finally:
        knn.unit_rows = rows
    assert sum(scored) == 3
    for i in range(300):
        sims = np.rint(rows(pd.Series([vectors_[i % 3]])) @ block.unit.T * 1e6)[0]
        seen = [j for j in range(n) if block.start[j] <= at[i] < block.end[j]]
        want = sorted(seen, key=lambda j: (-sims[j], j))[:4]
        assert got[got["query_id"] == i]["id"].tolist() == want


@pytest.mark.parametrize("name", ["vec_knn", "vec_knn_fast", "vec_index_exact"])
def test_every_row_is_a_query(spark, tmp_path, name):
    """The registered search and its SQL ask for all rows, whatever their ids."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], i % 3) for i in range(1, 120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT query_id, rank, id, similarity FROM ({ORACLE[name]})").fetchall()
    got = QUERIES[name](spark, str(tmp_path)).select("query_id", "rank", "id", "similarity")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) == 5 * len(rows) and {w[0] for w in want} == {r[0] for r in rows}


@pytest.mark.parametrize("conf", [Settings(), Settings(broadcast_rows=3, knn_block_rows=40)])
def test_search_at_many_times(spark, conf):
    """Equal vectors in many rows, rows that come twice, times before, between and after the spans, ties between groups."""
    rng, n = np.random.default_rng(4), 150
    base = rng.integers(-2, 3, (40, 6)).astype(float)
    rows = [(i // 2 if i < 20 else i, base[0] if i % 3 == 0 else base[i % 40]) for i in range(n)]
    start = [None if i % 11 == 0 else int(x) for i, x in enumerate(rng.integers(0, 60, n))]
    end = [None if i % 4 == 0 else int(x) for i, x in enumerate(rng.integers(20, 90, n))]
    v = spark.createDataFrame(
        [(i, [float(x) for x in e], s, t) for (i, e), s, t in zip(rows, start, end)],
        "id bigint, embedding array<float>, s bigint, e bigint",
    ).select("id", "embedding", F.timestamp_micros("s").alias("valid_from"), F.timestamp_micros("e").alias("valid_to"))
    asked = [*base[:12], base[0], np.zeros(6)]
    times = [[int(x) for x in rng.permutation(np.arange(-5, 95))[:30]] for _ in asked]
    q = spark.createDataFrame(
        [(f"q{i}", [float(x) for x in e], t) for i, (e, t) in enumerate(zip(asked, times))],
        "query_id string, embedding array<float>, at array<bigint>",
    )
    got = {}
    for r in knn_asof(q, v, 4, conf=conf).collect():
        got[r["query_id"], r["at"]] = list(zip(r["ids"], r["similarities"]))
    want = {}
    unit_v = knn.unit_rows(pd.Series([e for _, e in rows]))
    for i, e in enumerate(asked):
        sims = np.rint(knn.unit_rows(pd.Series([e])) @ unit_v.T * 1e6)[0] / 1e6
        for t in times[i]:
            seen = [j for j in range(n) if (start[j] is None or start[j] <= t) and (end[j] is None or t < end[j])]
            best = sorted(((-sims[j], rows[j][0]) for j in seen))[:4]
            if best and e.any():
                want[f"q{i}", t] = [(d, -s) for s, d in best]
    assert got == want and len(want) > 200
