"""Keyword index and incremental snapshots: tables that are kept on storage."""

import random

import pytest

from emberwatch.operators import keyword_index, listing, snapshot_store, tables

ROW = "id bigint, raw_log string, error_message string"


def test_keyword_index_reads_few_files(spark, tmp_path):
    rnd = random.Random(2)
    word = lambda k: "".join(rnd.choice("abcdeÉß") for _ in range(k))
    rows = [(i, f"{'block%02d' % (i // 50)} {word(6)} Pool", rnd.choice([None, "", word(5), "50% of_pool"])) for i in range(400)]
    path = str(tmp_path / "index")
    df = spark.createDataFrame(rows, ROW).coalesce(1)
    keyword_index.add_rows(df, path, 0, file_rows=50)
    late = spark.createDataFrame([(900, "late BLOCK77 row", None), (901, None, None), (902, "x" * 300_000 + "needle", "")], ROW)
    keyword_index.add_rows(late, path, 1)
    everything = df.unionByName(late).cache()
    every = keyword_index.candidate_files(spark, path, "")
    for q in ("block03", "BLOCK77", "needle", "bl", "", "block%pool", "0% OF_p", "pool", "nowhere", "É", "abc", "é", "xx_needle"):
        want = sorted(r["id"] for r in listing.filter_keyword(everything, q).collect())
        assert sorted(r["id"] for r in keyword_index.search(spark, path, q, ROW).collect()) == want, q
    assert len(every) >= 9
    for q in ("block03", "needle"):
        assert len(keyword_index.candidate_files(spark, path, q)) == 1
    assert keyword_index.candidate_files(spark, path, "nowhere") == []
    assert keyword_index.candidate_files(spark, path, "bl") == every
    one = keyword_index.search(spark, path, "block03", ROW, ("raw_log",))
    assert one.count() == 50 and len(one.inputFiles()) == 1
    with pytest.raises(ValueError):
        keyword_index.candidate_files(spark, path, "block", ("title",))
    none = str(tmp_path / "none")
    keyword_index.add_rows(df.where("false"), none, 0)
    assert keyword_index.search(spark, none, "block", ROW).count() == 0


def test_logs_rewrite_only_touched_buckets(spark, tmp_path):
    rnd = random.Random(5)
    schema = "k string, part int, version int, v string"
    path = str(tmp_path / "store")

    def log(n, versions, keys):
        return [(rnd.choice(keys), rnd.choice([1, None]), rnd.choice(versions), rnd.choice(["a", "b", None])) for _ in range(n)]

    names = [f"k{i}" for i in range(40)] + [None]
    logs = [log(300, range(5), names), [("k1", 1, 9, "x"), ("k1", 1, 9, "y"), ("k2", 1, 0, "late")], [], log(200, range(12), ["hot", "k3"])]
    snapshot_store.start(spark.createDataFrame(logs[0], schema), path, ["k", "part"], buckets=16)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for n, more in enumerate(logs):
        if n:
            snapshot_store.apply_log(spark.createDataFrame(more, schema), path, n)
        so_far = spark.createDataFrame([r for part in logs[: n + 1] for r in part], schema)
        assert rows(snapshot_store.snapshot(spark, path, schema)) == rows(tables.latest_snapshot(so_far, ["k", "part"]))
    held = {(r["generation"], r["held_by"]) for r in snapshot_store.generations(spark, path).collect()}
    assert (1, 0) in held and (1, 1) in held and (2, 2) not in held
    second = [r["bucket"] for r in snapshot_store.generations(spark, path).where("generation = 1 and held_by = 1").collect()]
    assert 1 <= len(second) <= 2  # two keys
    first = spark.createDataFrame(logs[0], schema)
    assert rows(snapshot_store.snapshot(spark, path, schema, 0)) == rows(tables.latest_snapshot(first, ["k", "part"]))
    gone = snapshot_store.removable(spark, path, 1).count()
    last = snapshot_store.generations(spark, path).where("generation = 3").count()
    written = snapshot_store.generations(spark, path).select("bucket", "held_by").distinct().count()
    assert gone == written - last > 0
    with pytest.raises(ValueError):
        snapshot_store.apply_log(first, path, 3)
    empty = str(tmp_path / "empty")
    snapshot_store.start(first.where("false"), empty, ["k"])
    assert snapshot_store.snapshot(spark, empty, schema).count() == 0
    snapshot_store.apply_log(first, empty, 1)
    assert rows(snapshot_store.snapshot(spark, empty, schema)) == rows(tables.latest_snapshot(first, ["k"]))
