import json

import pytest
from pyspark.sql import functions as F

from emberwatch import Settings
from emberwatch.functions import explain
from emberwatch.functions import fixed_values as V
from emberwatch.operators import decide, listing, tables
from emberwatch.operators.retrieve import retrieve_asof, semantic_search
from emberwatch.plans import knowledge
from emberwatch.plans.replay import replay
from emberwatch.plans.triage import complete_batch, triage
from emberwatch.sources import sinks
from emberwatch.sources import tables as sources

SEED = (1, "ERROR JedisConnectionException redis connection refused timeout 10.0.1.2:6379", "redis timeout", "redis oom",
        "restart redis")


def test_known_incident(make_alerts, make_kb):
    kb = make_kb([SEED])
    alerts = make_alerts([(7, 0.0, "auth", "JedisConnectionException Failed connecting to redis connection timed out")])
    t = triage(alerts, kb, knowledge.vectors_of(kb), Settings(match_threshold=0.6))
    row = t.alerts.first()
    assert row["match_status"] == "matched" and row["matched_knowledge_id"] == 1
    assert row["similarity_score"] > 0.6
    assert row["ai_summary"] == V.PLAIN_DATABASE  # "timed out" is no timeout, "refused" is absent
    assert t.knowledge.first()["occurrence_count"] == 2
    report = t.reports.first()
    assert report["matched"] and report["retrieval"][0]["title"] == "redis timeout"
    assert report["engineer_guide"].endswith("restart redis")
    note = t.notifications().first()
    assert note["title"] == "🟡 服务异常告警 · auth" and "redis timeout (相似度 0." in note["markdown"]
    assert {a["params"]["alert_id"] for a in note["actions"]} == {"7"} and note["alert_ids"] == [7]


def test_novel_incident_and_empty_knowledge(make_alerts, make_kb):
    alerts = make_alerts([(1, 0.0, None, "quantum flux capacitor desynchronized"), (2, 0.0, None, "  ")])
    for kb in (make_kb([SEED]), make_kb([SEED]).where("id < 0")):
        t = triage(alerts, kb, knowledge.vectors_of(kb))
        rows = {r["id"]: r for r in t.alerts.collect()}
        assert {r["match_status"] for r in rows.values()} == {"new_incident"}
        assert rows[1]["similarity_score"] < 0.78 and rows[2]["similarity_score"] == 0.0
        assert t.notifications(notify_on_new=False).count() == 0
        assert t.notifications().first()["title"].startswith("🔴 服务异常告警 · 未知服务")


def test_action_suggestions(make_alerts, make_kb):
    kb = make_kb([(1, "ERROR redis cache oom connection refused", "redis oom", "redis cache oom", "clear cache")])
    alerts = make_alerts([(1, 0.0, "s", "redis cache oom connection refused")])
    vecs = knowledge.vectors_of(kb)

    def names(conf):
        return triage(alerts, kb, vecs, conf).diagnosed.select("suggested_actions.name").first()["name"]

    assert names(Settings(match_threshold=0.5, action_threshold=0.5)) == ["clear_cache", "restart_service", "scale_up"]
    assert names(Settings(match_threshold=0.5, action_threshold=0.99)) == ["clear_cache", "restart_service"]
    assert names(Settings(match_threshold=0.5, suggest_actions=False)) == []


@pytest.mark.parametrize(
    "text, confidence, want",
    [
        ("版本 deploy", 0.9, ["rollback"]),
        ("版本 deploy", 0.1, ["notify_oncall"]),
        ("nothing known", 0.9, ["notify_oncall"]),
        ("heap 内存", 0.1, ["restart_service"]),
    ],
)
def test_action_rules(spark, text, confidence, want):
    got = spark.range(1).select(decide.action_names(F.lit(text), F.lit(confidence), 0.85).alias("n")).first()["n"]
    assert got == want


def test_inactive_rows_use_up_places(make_alerts, make_kb):
    kb = make_kb([SEED, (2, SEED[1], "twin", "", "other"), (3, "disk full", "disk", "", "clean")])
    hidden = kb.withColumn("is_active", F.col("id") != 1)
    alerts = make_alerts([(1, 0.0, None, SEED[1])])
    t = triage(alerts, hidden, knowledge.vectors_of(kb), Settings(top_k=1))
    assert t.alerts.first()["match_status"] == "new_incident"
    t = triage(alerts, hidden, knowledge.vectors_of(kb), Settings(top_k=2))
    assert t.alerts.first()["matched_knowledge_id"] == 2


def test_custom_model(spark, make_alerts, make_kb):
    kb = make_kb([SEED])
    alerts = make_alerts([(1, 0.0, "auth", SEED[1])])

    def make_model():
        return lambda systems, prompts: [
            f"📢 【当前问题大白话翻译】\n`{systems[0]} {'历史经验#1' in p}`\n🛠️ 【您可以采取的行动】\nwait\n"
            f"👨‍💻 【技术排查参考（供工程师）】\n{len(p)}" for p in prompts
        ]

    r = triage(alerts, kb, knowledge.vectors_of(kb), make_model=make_model, system="SYS").reports.first()
    assert (r["plain_language"], r["user_actions"]) == ("SYS True", "wait")
    empty = spark.createDataFrame([], "prompt string")
    assert complete_batch(empty, make_model).collect() == []


def test_parse_triage_without_sections(spark):
    df = spark.createDataFrame([("  plain words \n",), ("👨‍💻 【技术排查参考（供工程师）】 only ``",)], "answer string")
    a, b = explain.parse_triage(df).collect()
    assert (a["plain_language"], a["user_actions"], a["engineer_guide"]) == ("plain words", "", "")
    assert b["engineer_guide"] == "only" and b["plain_language"].startswith("👨‍💻")


def test_rule_report_equals_parsed_answer(spark, make_alerts, make_kb):
    from emberwatch.functions.logs import parse_logs
    from emberwatch.operators.retrieve import retrieve

    kb = make_kb([SEED, (2, "disk full on node", "disk", "", "` steps 🛠️ --- 👨‍💻 more \n"), (3, "tls expired", "tls", "", "")])
    logs = [SEED[1], "disk full on node", "tls expired", "gpu fault", "  "]
    found = retrieve(parse_logs(make_alerts([(i, 0.0, None, t) for i, t in enumerate(logs)])), knowledge.vectors_of(kb), kb, 1)
    pick = ["id", "plain_language", "user_actions", "engineer_guide"]
    a = explain.rule_report(found).select(*pick)
    b = explain.parse_triage(explain.rule_triage(found)).select(*pick)
    assert a.count() == 5 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_parse_resolution_fields(spark):
    text = "【错误类型】 : Redis 超时 \n【标题】:\n【根因】: cause\nmore"
    p = explain.parse_resolution(spark.createDataFrame([(text,)], "answer string")).first()["parsed"]
    assert (p["error_type"], p["title"], p["root_cause"], p["user_guide"]) == ("Redis 超时", "", "cause", None)


def test_deposit_then_same_log_matches(spark, make_alerts, make_kb):
    novel = "quantum flux capacitor desynchronized in phase shift reactor 47"
    kb = make_kb([SEED])
    vecs = knowledge.vectors_of(kb)
    first = triage(make_alerts([(1, 0.0, "r", novel)]), kb, vecs)
    reqs = spark.createDataFrame(
        [(0, 1, None, "flux capacitor needed recalibration", "recalibrate to 1.21 gigawatts", "doc", ["flux", "x"]),
         (1, 99, None, "c", "r", "doc", []),
         (2, 1, "Typed", "again " * 20, "second", "eve", [])],
        "request_no bigint, alert_id bigint, error_type string, root_cause string, resolution string, engineer string, tags array<string>",
    )
    c = knowledge.deposit(first.alerts, kb, vecs, reqs, "2024-02-02 00:00:00")
    rows = {r["id"]: r for r in c.kb.collect()}
    assert sorted(rows) == [1, 2, 4]
    assert rows[2]["engineer_guide"] == "recalibrate to 1.21 gigawatts" and rows[2]["source"] == "engineer:doc"
    assert rows[2]["tags"] == "flux,x" and rows[4]["tags"] is None and rows[4]["error_type"] == "Typed"
    assert rows[4]["title"].endswith("…") and len(rows[4]["title"]) == 41
    assert [r["alert_id"] for r in c.rejected.collect()] == [99]
    alert = c.alerts.first()
    assert (alert["match_status"], alert["status"], alert["matched_knowledge_id"]) == ("deposited", "resolved", 4)
    second = triage(make_alerts([(2, 9.0, "r2", novel)]), c.kb, c.vectors).alerts.first()
    assert second["match_status"] == "matched" and second["matched_knowledge_id"] == 2
    assert second["similarity_score"] == 1.0
    off = knowledge.deactivate(c.kb, c.vectors, spark.createDataFrame([(2,), (77,)], "id bigint"))
    assert [r["id"] for r in off.rejected.collect()] == [77]
    third = triage(make_alerts([(3, 9.0, "r2", novel)]), off.kb, off.vectors).alerts.first()
    assert third["matched_knowledge_id"] == 4


def test_replay_equals_one_by_one(spark, make_alerts, make_kb):
    logs = ["redis connection refused timeout", "disk is full on node", "quantum flux reactor 47", "kafka lag topic orders"]
    alerts = make_alerts([(i, float(i * 10), "s", logs[i % 4]) for i in range(12)]).cache()
    kb = make_kb([SEED])
    reqs = spark.createDataFrame(
        [(0, 2, "flux broke", "fix flux", 45), (1, 1, "disk full", "clean disk", 55), (2, 11, "too early", "x", 60)],
        "request_no bigint, alert_id bigint, root_cause string, resolution string, sec bigint",
    ).selectExpr(
        "request_no", "alert_id", "CAST(NULL AS string) AS error_type", "root_cause", "resolution", "'eng' AS engineer",
        "CAST(array() AS array<string>) AS tags", "timestamp_micros(1704067200000000 + sec * 1000000) AS requested_at",
    )
    deletes = spark.createDataFrame([(2, 95), (2, 97), (50, 10)], "id bigint, sec bigint").selectExpr(
        "id", "timestamp_micros(1704067200000000 + sec * 1000000) AS deleted_at"
    )
    conf = Settings(match_threshold=0.7)
    got = replay(alerts, kb, reqs, deletes, conf)

    table, vecs, seen = kb, knowledge.vectors_of(kb), {}
    for i in range(12):
        t = i * 10
        for no, at in ((0, 45), (1, 55)):
            if t - 10 < at <= t:
                stored = triage(alerts.where(f"id <= {i - 1}"), kb, vecs, conf).alerts
                c = knowledge.deposit(stored, table, vecs, reqs.where(f"request_no = {no}").drop("requested_at")
                                      .withColumn("request_no", F.lit(0).cast("bigint")))
                table, vecs = c.kb, c.vectors
        if t - 10 < 95 <= t:
            c = knowledge.deactivate(table, vecs, spark.createDataFrame([(2,)], "id bigint"))
            table, vecs = c.kb, c.vectors
        table, vecs = (spark.createDataFrame(x.collect(), x.schema) for x in (table, vecs))
        r = triage(alerts.where(f"id = {i}"), table, vecs, conf).alerts.first()
        seen[i] = (r["similarity_score"], r["match_status"], r["matched_knowledge_id"])
    for r in got.triage.alerts.collect():
        assert (r["similarity_score"], r["match_status"], r["matched_knowledge_id"]) == seen[r["id"]], r["id"]
    assert {r["id"]: r["is_active"] for r in got.kb.select("id", "is_active").collect()} == {1: True, 2: False, 3: True}
    assert [r["request_no"] for r in got.missing.select("request_no").collect()] == [2]
    final = {r["id"]: r["match_status"] for r in got.alerts.collect()}
    assert final[1] == final[2] == "deposited"


def test_asof_with_changes_in_many_cells(spark, make_alerts, make_kb):
    from emberwatch.functions.logs import parse_logs

    kb = make_kb([(i, *SEED[1:]) for i in (1, 2, 3)])
    spans = spark.sql("""SELECT * FROM VALUES
      (1L, TIMESTAMP '2024-01-01 00:00:05', TIMESTAMP '2024-01-01 00:00:15'),
      (2L, TIMESTAMP '2024-01-01 01:00:00', TIMESTAMP '2024-01-01 01:00:59'),
      (3L, TIMESTAMP '2024-01-01 01:00:30', CAST(NULL AS timestamp)) AS t(id, valid_from, valid_to)""")
    vecs = knowledge.vectors_of(kb).join(spans, "id")
    times = (0, 5, 14.9, 15, 3599.9, 3600, 3629.9, 3630, 3659, 90_000)
    alerts = parse_logs(make_alerts([(i, float(s), None, SEED[1]) for i, s in enumerate(times)]))
    got = {r["id"]: [h["knowledge_id"] for h in r["hits"]] for r in retrieve_asof(alerts, vecs, kb).collect()}
    assert got == {0: [], 1: [1], 2: [1], 3: [], 4: [], 5: [2], 6: [2], 7: [2, 3], 8: [3], 9: [3]}


def test_a_text_is_one_query_at_all_its_times(spark, make_alerts, make_kb, monkeypatch):
    """Fifty changes: not fifty queries a text, each with its vector, and equal logs are parsed once."""
    from emberwatch.functions.logs import parse_logs
    from emberwatch.operators import retrieve

    kb = make_kb([(i, *SEED[1:]) for i in range(50)])
    spans = spark.range(50).selectExpr("id", "timestamp_seconds(1704067200 + id) AS valid_from", "CAST(NULL AS timestamp) AS valid_to")
    vecs = knowledge.vectors_of(kb).join(spans, "id")
    alerts = parse_logs(make_alerts([(i, i / 2, None, (SEED[1], "  " + SEED[1], "disk full")[i % 3]) for i in range(120)]))
    asked = []
    for name in ("knn_fast", "knn_asof"):
        search = getattr(retrieve, name, None)
        monkeypatch.setattr(retrieve, name, lambda q, *a, f=search: asked.append(q.count()) or f(q, *a), raising=False)
    for raw, queries in ((None, 2), ("raw_log", 3)):
        asked.clear()
        got = retrieve_asof(alerts, vecs, kb, 3, Settings(), *([raw] if raw else []))
        for r in got.select("id", "hits.knowledge_id").collect():
            assert r["knowledge_id"] == list(range(min(r["id"] // 2 + 1, 3))), r["id"]
        assert asked == [queries]


def test_semantic_search(spark, make_kb):
    kb = make_kb([(1, "redis OOM connection refused cache", "redis oom", "", "g"), (2, "disk full", "disk", "", "g")])
    q = spark.createDataFrame([("a", "cache connection timeout"), ("b", "")], "query_id string, q string")
    got = semantic_search(q, knowledge.vectors_of(kb), kb, 3).orderBy("rank").collect()
    assert [r["title"] for r in got] == ["redis oom", "disk"] and got[0]["similarity"] > 0
    with pytest.raises(ValueError):
        semantic_search(q, knowledge.vectors_of(kb), kb, 51)


def test_listing(spark, make_alerts):
    df = make_alerts([(1, 0.0, "auth", "redis timeout boom"), (2, 5.0, "pay", "mysql 50%_pool\\x exhausted")]).withColumns(
        {"error_message": F.lit(None).cast("string"), "status": F.lit("open"), "match_status": F.lit("new_incident")}
    )
    ids = lambda x: [r["id"] for r in x.collect()]
    assert ids(listing.filter_keyword(df, "MYSQL")) == [2]
    assert ids(listing.filter_keyword(df, "50%x")) == [2]  # % stays a wildcard
    assert ids(listing.filter_keyword(df, "pool\\x")) == [2]
    assert ids(listing.filter_keyword(df, "")) == [1, 2]
    assert ids(listing.filter_dates(df, frm="1999-01-01", to="1999-12-31")) == []
    assert ids(listing.filter_dates(df, on="2024-01-01")) == [1, 2]
    assert ids(listing.filter_alerts(df, service="auth", status="")) == [1]
    assert ids(listing.recent_alerts(df, 1)) == [2]
    with pytest.raises(ValueError):
        listing.recent_alerts(df, 501)
    plan = listing.recent_alerts(df)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_snapshot_and_versions(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 3, None), (2, 1, "x"), (1, 2, "b")], "k int, version int, v string")
    got = {r["k"]: r["v"] for r in tables.latest_snapshot(log, ["k"]).collect()}
    assert got == {1: None, 2: "x"}


def test_sources(spark, tmp_path):
    lines = [
        {"raw_log": "boom", "service": "s", "severity": "fatal"}, {"raw_log": "   "}, {"raw_log": ""}, {"service": "x"},
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    good, bad = sources.read_alerts(spark, str(tmp_path / "a.json"))
    assert {(r["raw_log"], r["severity"]) for r in good.collect()} == {("boom", "fatal"), ("   ", "error")}
    assert bad.count() == 3
    full = {"raw_log_sample": "x", "user_guide": "u", "engineer_guide": "e"}
    items = [{**full, "title": "t", "tags": ["a", "b"]}, {**full, "title": "u", "tags": [], "source": "import"}, {"title": "v"}]
    (tmp_path / "k.json").write_text("\n".join(map(json.dumps, items)) + "\n{oops\n")
    valid, rejected = sources.read_knowledge(spark, str(tmp_path / "k.json"))
    rows = {r["title"]: r for r in valid.collect()}
    assert len(rows) == 2 and sorted((r["title"] or "", r["_corrupt_record"]) for r in rejected.collect()) == [("", "{oops"), ("v", None)]
    assert (rows["t"]["tags"], rows["t"]["source"], rows["t"]["occurrence_count"]) == ("a,b", "manual", 1)
    assert rows["u"]["tags"] is None and rows["u"]["source"] == "import"
    (tmp_path / "r.json").write_text(json.dumps({"alert_id": 1, "root_cause": "c", "resolution": "r"}))
    valid, rejected = sources.read_resolutions(spark, str(tmp_path / "r.json"))
    r = valid.first()
    assert r["engineer"] == "engineer" and r["tags"] == [] and rejected.count() == 0


def test_vector_snapshot(spark, tmp_path):
    good = {"magic": "m", "data": {"knowledge": {"1": ["text, \"q\"", [0.5, 1]], "2": ["b", [0.0, 2e-3]], "x": ["c", [1]], "4": ["d", None]}, "other": {}}}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({**good, "magic": "wrong"}))
    (tmp_path / "c.json").write_text("{not json")
    valid, rejected = sources.import_vector_snapshot(spark, str(tmp_path / "*.json"), "m")
    got = valid.orderBy("id").collect()
    assert sorted(r["id"] for r in rejected.collect()) == ["4", "x"]
    assert [(r["namespace"], r["id"], r["text"]) for r in got] == [("knowledge", 1, 'text, "q"'), ("knowledge", 2, "b")]
    assert got[0]["embedding"] == [0.5, 1.0]


def test_failed_delivery_is_recorded(spark):
    def make_sender():
        def send(row):
            if row["alert_id"] == 3:
                raise RuntimeError("no route")

        return send

    df = spark.range(6).withColumnRenamed("id", "alert_id")
    got = {r["alert_id"]: (r["ok"], r["error"]) for r in sinks.emit_notifications(df, make_sender).collect()}
    assert got[3] == (False, "no route") and got[4] == (True, None) and len(got) == 6
    assert sinks.emit_notifications(df).where("ok").count() == 6


def test_null_keys_are_spread(spark):
    from emberwatch.operators.skew import salted_join

    rows = spark.range(20_000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN id % 7 END AS k")
    lookup = spark.range(7).selectExpr("id AS k", "id * 10 AS v")
    hot = rows.where("k = 1").groupBy("k").count().selectExpr("k", "8 AS salts")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(rows, lookup, hot, ["k"], "left")
        sizes = [r["count"] for r in joined.where("k IS NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 15_000 and len(sizes) > 1 and max(sizes) < 6_000
        assert joined.where("k IS NOT NULL AND v = k * 10").count() == 5_000
        assert salted_join(rows, lookup, hot, ["k"], "left_anti").count() == 15_000
        assert salted_join(rows, lookup, hot, ["k"], "left_semi").count() == 5_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_last_change_wins(spark):
    from emberwatch.operators.vectors import rejected_vectors, upsert_vectors

    base = spark.createDataFrame([("a", 1, "old", [1.0])], "namespace string, id bigint, text string, embedding array<float>")
    changes = spark.createDataFrame(
        [("a", 1, "x", [2.0], 1), ("a", 1, "y", [3.0], 2), ("a", 2, "n", None, 1), ("a", 3, "z", [0.0], 1)],
        "namespace string, id bigint, text string, embedding array<float>, v int",
    )
    assert [(r["id"], r["text"]) for r in upsert_vectors(base, changes, "v").collect()] == [(1, "y")]
    assert [r["id"] for r in rejected_vectors(changes).collect()] == [2]


def test_notifications_are_delivered_once(spark, tmp_path):
    def make_sender():
        def send(row):
            with open(tmp_path / f"{row['alert_id']}", "a") as out:
                out.write("x")

        return send

    sent = sinks.emit_notifications(spark.range(5).withColumnRenamed("id", "alert_id"), make_sender)
    assert sent.count() == 5 and sent.where("ok").count() == 5
    assert [f.read_text() for f in sorted(tmp_path.iterdir())] == ["x"] * 5
