from pyspark.sql import functions as F

from emberwatch import Settings
from emberwatch.functions import explain, logs
from emberwatch.functions import fixed_values as V
from emberwatch.operators import embed, retrieve
from emberwatch.plans.knowledge import vectors_of

CASES = [
    (1, "ERROR service=auth host=app-01 JedisConnectionException: Failed connecting to redis://10.0.1.2:6379 Connection refused"),
    (2, "ERROR java.lang.OutOfMemoryError: Java heap space\n    at com.x.RequestRouter.dispatch(RequestRouter.java:88)\n"
        "    at java.base/java.util.concurrent.ThreadPoolExecutor.runWorker(ThreadPoolExecutor.java:1128)"),
    (3, "something weird happened"),
    (4, " \t　\n"),
    (5, "   app=one app=two, module=m ip=9.9.9.9 10.1.1.1 "),
    (6, "  at a.b.C(D.java:1)\r\n  File \"x.py\", line 3, in f"),
    (7, "服务=错误 服务键=值 WARNING 异常X"),
    (8, "CRITICALLY host=h1 PANIC"),
    (9, "x" * 600),
    (10, 'Traceback (most recent call last):\n  File "a.py", line 3, in f\nValueError: bad'),
]


def parsed(spark):
    rows = logs.parse_logs(spark.createDataFrame(CASES, "id int, raw_log string")).collect()
    return {r["id"]: r for r in rows}


def test_fields(spark):
    r = parsed(spark)
    assert r[1]["exception_type"] == "JedisConnectionException"
    assert (r[1]["log_service"], r[1]["log_server_ip"], r[1]["log_severity"]) == ("auth", "10.0.1.2", "ERROR")
    assert r[1]["canonical_text"] == f"JedisConnectionException | {CASES[0][1]}"
    assert r[2]["exception_type"] == "OutOfMemoryError"
    assert r[2]["stack_trace"].splitlines()[0] == "at com.x.RequestRouter.dispatch(RequestRouter.java:88)"
    assert len(r[2]["stack_trace"].splitlines()) == 2
    assert r[2]["error_message"] == "ERROR java.lang.OutOfMemoryError: Java heap space"
    assert r[3]["canonical_text"] == "something weird happened"
    assert r[3]["stack_trace"] is None and r[3]["log_severity"] == "ERROR"
    assert r[4]["canonical_text"] == "" and r[4]["error_message"] == ""
    assert r[5]["log_service"] == "two" and r[5]["log_server_ip"] == "9.9.9.9"
    # only frames: the message falls back to the whole text
    assert r[6]["error_message"].startswith("at a.b.C(D.java:1)")
    assert r[6]["stack_trace"].count("\n") == 1
    assert r[7]["log_severity"] == "WARNING" and r[7]["exception_type"] is None
    assert r[8]["log_server_ip"] == "h1" and r[8]["log_severity"] == "PANIC"
    # the column is cut, the compared text is not
    assert len(r[9]["error_message"]) == 512 and len(r[9]["canonical_text"]) == 600
    assert r[10]["exception_type"] == "Traceback"
    assert r[10]["stack_trace"] == 'File "a.py", line 3, in f'


def test_last_pair_wins_and_order_is_kept(spark):
    df = spark.createDataFrame([("a=1 b=x=y, a=2",)], "t string").select(logs.kv_pairs(F.col("t")).alias("kv"))
    row = df.select("kv", logs.kv_last(F.col("kv"), "a").alias("a"), logs.kv_last(F.col("kv"), "z").alias("z")).first()
    assert [(p["key"], p["value"]) for p in row["kv"]] == [("a", "1"), ("b", "x=y"), ("a", "2")]
    assert row["a"] == "2" and row["z"] is None


def test_patterns_run_only_where_they_can_match(spark):
    odd = CASES + [(11, "OutOfMemor Err warn 1.2.3.4.5 a=b"), (12, "at"), (13, "xFatal at\tA.b(c)"), (14, None), (15, ""), (16, "１.２.３.４ ERR=WARNING"), (17, " at x:1")]
    df = spark.createDataFrame(odd, "id int, raw_log string")
    plain = "nullif(regexp_extract(t, {}, {}), '')"
    pattern = lambda p: "r'(?U)" + p.replace("'", "\\'") + "'"
    t = df.select("id", logs.strip(F.col("raw_log")).alias("t"))
    want = t.selectExpr(
        "id", plain.format(pattern(f"({V.EXCEPTION_NAMES})"), 1), plain.format(pattern(V.IPV4), 0),
        f"coalesce({plain.format(pattern(V.LEVEL), 1)}, 'ERROR')", f"rlike(t, {pattern(V.FRAME_LINE)})",
        f"size(regexp_extract_all(t, {pattern(V.KEY_VALUE)}, 0))",
    )
    c = F.col("t")
    found = t.select("id", logs.exception_type(c), logs.ipv4(c), logs.severity(c), logs.is_frame(c), F.size(logs.kv_pairs(c)))
    assert found.orderBy("id").collect() == want.orderBy("id").collect()
    plan = t.select(logs.exception_type(c))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan


def test_fields_nobody_asks_for_are_not_worked_out_to_salt_a_join(spark, make_alerts, make_kb):
    alerts = make_alerts([(i, float(i), "s", "disk full") for i in range(40)] + [(50, 1.0, "s", "redis timeout")])
    kb = make_kb([(1, "disk full", "t", "c", "g")])
    conf = Settings(broadcast_rows=0, hot_fraction=4)
    found = retrieve.retrieve(logs.parse_logs(alerts), vectors_of(kb), kb, conf=conf).select("id", F.size("hits").alias("n"))
    assert "CRITICAL" not in found._jdf.queryExecution().optimizedPlan().toString()  # a part of the pattern of levels
    assert found.count() == 41 and found.where("n = 1").count() == 41


def test_a_trigram_is_hashed_once_per_task(monkeypatch):
    seen = []
    plain = embed.md5
    monkeypatch.setattr(embed, "md5", lambda b: (seen.append(b), plain(b))[1])
    vectors = embed._text_vectors(16)
    first = vectors(["disk full"])
    hashed = len(seen)
    assert (vectors(["disk full"]) == first).all() and len(seen) == hashed


def test_the_last_section_is_read_to_the_end_without_looking_ahead(spark):
    answer = f"{V.HEAD_PLAIN}\nbad\n\n{V.HEAD_ACTIONS}\nwait\n\n{V.HEAD_ENGINEER}\n steps\n{V.HEAD_ENGINEER} more \n"
    df = spark.createDataFrame([(answer,), ("no head",), (None,)], "answer string")
    found = explain.parse_triage(df)
    plan = found.select("engineer_guide")._jdf.queryExecution().optimizedPlan().toString()
    assert "(.*)" in plan and "(.*?)" not in plan
    assert [r["engineer_guide"] for r in found.collect()] == [f"steps\n{V.HEAD_ENGINEER} more", "", None]
