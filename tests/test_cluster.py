import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch import Settings
from emberwatch.functions.logs import parse_logs
from emberwatch.operators import cluster, components
from emberwatch.operators.embed import embed
from emberwatch.operators.knn import unit_rows
from emberwatch.sources.tables import stream_alerts
from emberwatch.streaming import jobs


def sequential(pdf, window_s, threshold, tick_us=1_000_000, key=None):
    """One alert after the other, as the definition says."""
    out, leaders = {}, []
    limit, window = round(threshold * 1e6), window_s * 1_000_000 // tick_us
    for r in pdf.sort_values(["ts", "id"]).itertuples(index=False):
        tick, scope = r.ts // tick_us, getattr(r, key) if key else None
        leaders = [x for x in leaders if tick - x[0] <= window]
        best, score = None, -1
        for x in leaders:
            s = int(np.rint(x[2] @ r.unit * 1e6)) if x[3] == scope else 0
            if s > score:
                best, score = x, s
        if r.unit.any() and best is not None and score >= limit:
            out[r.id] = (best[1], score / 1e6)
        else:
            if r.unit.any():
                leaders.append((tick, r.id, r.unit, scope))
            out[r.id] = (r.id, 1.0)
    return out


@pytest.fixture(scope="module")
def storm(spark, make_alerts):
    """Two hot families, one with a third of all rows, equal times, and blank logs."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        kind = i % 6
        text = (
            "redis timeout on shard 1" if kind < 2
            else f"parcel jam at chute nine, belt stopped for {300 + int(rng.integers(4))} seconds" if kind < 4
            else f"disk {int(rng.integers(3))} is full on node-{int(rng.integers(5))}" if kind == 4
            else "  " if i % 60 == 5 else f"kafka lag group g{int(rng.integers(6))}"
        )
        rows.append((i, float(np.round(rng.uniform(0, 4000), 1)), f"s{int(rng.integers(2))}", text))
    return parse_logs(make_alerts(rows)).cache()


def local(df):
    pdf = embed(df, "canonical_text").select("id", F.unix_micros("created_at").alias("ts"), "embedding", "service").toPandas()
    pdf["unit"] = list(unit_rows(pdf["embedding"]))
    return pdf


def answers(df):
    return {r["id"]: (r["cluster_key"], r["similarity"]) for r in df.collect()}


@pytest.mark.parametrize(
    "window, threshold, options",
    [
        (300, 0.88, {}),
        (300, 0.6, {"tick_us": 1_000_000}),
        (300, 0.6, {"scan_rows": 40}),
        (60, 0.5, {"tick_us": 10_000_000, "scan_rows": 60}),
        (300, 0.7, {"key": "service", "scan_rows": 100, "conf": Settings(block_rows=8, broadcast_rows=5)}),
    ],
)
def test_equals_the_sequential_answer(storm, window, threshold, options):
    got = cluster.cluster_alerts(storm, window, threshold, **options)
    want = sequential(local(storm), window, threshold, options.get("tick_us", 1), options.get("key"))
    assert answers(got) == want
    assert got.where("is_leader <> (id = cluster_key)").isEmpty()


def test_every_row_is_scanned_once(storm, monkeypatch):
    """One family that goes on without a gap, so that its first leader decides all later ones: a row is in one round,
    and a second that is larger than several blocks loses no leader."""
    written, keep = [], cluster.cut

    def counting(df, *more):
        out = keep(df, *more)
        if "later" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(cluster, "cut", counting)
    crowd = F.when(F.col("id") % 3 == 0, F.lit("2024-01-01 00:20:00").cast("timestamp")).otherwise(F.col("created_at"))
    rows = storm.withColumn("created_at", F.timestamp_micros(F.unix_micros(crowd) + F.col("id")))
    got = cluster.cluster_alerts(rows, 300, 0.3, scan_rows=20)
    assert answers(got) == sequential(local(rows), 300, 0.3, 1)
    assert len(written) > 5 and sum(written) == rows.where("canonical_text <> ''").count()


def test_rounds_of_contraction(spark, monkeypatch):
    """A chain of nodes in random order, a star and a lone node: few rounds whatever the shape."""
    rounds, hook = [], components._hooked
    monkeypatch.setattr(components, "_hooked", lambda live, salt, *more: rounds.append(salt) or hook(live, salt, *more))
    names = np.random.default_rng(3).permutation(20_001).tolist()
    chain, star = names[:10_000], names[10_000:20_000]
    rows = [*zip(chain, chain[1:]), *((star[0], x) for x in star[1:]), (names[-1], names[-1])]
    edges = spark.createDataFrame(rows, "node bigint, hub bigint").repartition(4)
    got = components.connected_components(edges, finish_edges=50).toPandas().set_index("node")["component"]
    assert len(got) == 20_001 and len(rounds) <= 20
    assert (got[chain] == min(chain)).all() and (got[star] == min(star)).all() and got[names[-1]] == names[-1]


def test_two_similar_alerts(make_alerts):
    df = make_alerts([
        (1, 0.0, "s1", "belt 4 stopped: parcel jam at chute nine"),
        (2, 1.0, "s2", "belt 4 stopped again, parcel jam seen at chute nine"),
    ])
    assert {r["id"]: r["cluster_key"] for r in cluster.cluster_alerts(df, 300, 0.5).collect()} == {1: 1, 2: 1}


@pytest.mark.parametrize("after, joins", [(300.0, True), (300.000001, False)])
def test_window_is_exact(make_alerts, after, joins):
    text = "disk is full on node four"
    df = make_alerts([(1, 0.75, "s", text), (2, 0.75 + after, "s", text)])
    got = {r["id"]: r["cluster_key"] for r in cluster.cluster_alerts(df, 300, 0.8).collect()}
    assert got == {1: 1, 2: 1 if joins else 2}
    near = df.withColumn("raw_log", F.when(F.col("id") == 2, "disk is full on node five").otherwise(F.col("raw_log")))
    assert cluster.similar_pairs(near, 300, 0.6).count() == int(joins)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (200, 201), (202, 201)]
    edges = spark.createDataFrame(chain, "node bigint, hub bigint")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert got[100] == 100 and {got[200], got[201], got[202]} == {200}


def test_similar_pairs_do_not_depend_on_block_sizes(storm):
    a = cluster.similar_pairs(storm, 300, 0.6)
    b = cluster.similar_pairs(storm, 300, 0.6, Settings(block_rows=5, broadcast_rows=3))
    assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_summary(spark, make_alerts):
    rows = [(i, float(10 - i), ["a", "", None, "b"][i % 4], f"log {i} " + "y" * 300) for i in range(6)]
    m = make_alerts(rows).withColumn("cluster_key", F.when(F.col("id") < 5, 1).otherwise(2))
    got = cluster.cluster_summary(m).collect()
    assert len(got) == 1 and got[0]["count"] == 5 and got[0]["services"] == ["a", "b"]
    assert [e[:5] for e in got[0]["examples"]] == ["log 4", "log 3", "log 2"]
    assert {len(e) for e in got[0]["examples"]} == {200}


@pytest.mark.parametrize("key", [None, "service"])
def test_stream_equals_batch(spark, storm, tmp_path, key):
    plain = storm.select("id", "created_at", "service", "raw_log")
    cut = F.lit("2024-01-01 00:35:00").cast("timestamp")
    source = str(tmp_path / "in")
    for part in (plain.where(F.col("created_at") < cut), plain.where(F.col("created_at") >= cut)):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = stream_alerts(spark, source, "parquet", ("id bigint", "created_at timestamp"), maxFilesPerTrigger="1")
    out = str(tmp_path / "out")
    jobs.stream_clusters(
        stream, out, str(tmp_path / "mark"), 300, 0.7, key=key, available_now=True
    ).awaitTermination()
    want = cluster.cluster_alerts(storm, 300, 0.7, key=key)
    assert answers(spark.read.parquet(f"{out}/members")) == answers(want)
    closed = spark.read.parquet(f"{out}/clusters").drop("batch").unionByName(jobs.open_clusters(spark, out, 300, 2))
    batch = cluster.cluster_summary(want.join(storm, "id"))
    pick = ["cluster_key", "count", "services", "examples", "first_seen"]
    assert sorted(map(str, closed.select(*pick).collect())) == sorted(map(str, batch.select(*pick).collect()))
    assert closed.where("title NOT LIKE '📢 聚合告警 · %'").isEmpty()


def test_late_alerts_are_set_aside(spark, make_alerts, tmp_path):
    source = str(tmp_path / "in")
    for rows in ([(1, 1000.0, "s", "redis down")], [(2, 100.0, "s", "redis down"), (3, 1001.0, "s", "redis down")]):
        make_alerts(rows).coalesce(1).write.mode("append").parquet(source)
    stream = stream_alerts(spark, source, "parquet", ("id bigint", "created_at timestamp"), maxFilesPerTrigger="1")
    out = str(tmp_path / "out")
    jobs.stream_clusters(stream, out, str(tmp_path / "mark"), 300, available_now=True).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(f"{out}/late").collect()] == [2]
    assert answers(spark.read.parquet(f"{out}/members")) == {1: (1, 1.0), 3: (1, 1.0)}


def test_pairs_of_texts_that_come_once_are_not_shuffled(spark, make_alerts):
    rng = np.random.default_rng(5)
    text = lambda n: f"belt {n} stopped: parcel jam seen at chute nine"
    # texts that come once, near the ends of windows and in the next one, and texts that meet, part and meet again
    rows = [(i, float(t), "s", text(i)) for i, t in enumerate(np.round(rng.uniform(0, 3000, 120)))]
    rows += [(1000 + i, float(t), "s", text("abc"[i % 3])) for i, t in enumerate([10, 290, 310, 620, 1500, 1510, 1790, 2405, 2999])]
    df = make_alerts(rows)
    want = {
        tuple(sorted((a, b))) for _, s, _, a in rows for _, t, _, b in rows if a != b and abs(s - t) <= 300
    }
    keys = {r["k"]: r["raw_log"] for r in df.select("raw_log", F.unhex(F.md5("raw_log")).alias("k")).distinct().collect()}
    for conf in (Settings(), Settings(block_rows=3, broadcast_rows=3)):
        found = cluster.similar_pairs(df, 300, 0.5, conf)
        got = [(keys[r["text_a"]], keys[r["text_b"]]) for r in found.collect()]
        assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want
    plan = cluster.similar_pairs(df, 300, 0.5)._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and plan.children().apply(0).nodeName() == "FlatMapGroupsInArrow"
