"""Expressions and rows that define the fixture tables; they read the same in Spark and DuckDB."""

# --- one alert per event ------------------------------------------------------------------------
EXTERNAL_ID = "CASE WHEN event_id % 3 = 0 THEN concat('ext-', CAST(event_id AS varchar(20))) END"
PAYLOAD_IP = (
    "CASE WHEN event_id % 7 = 0 THEN concat('10.9.0.', CAST(user_id % 200 AS varchar(20))) "
    "WHEN event_id % 7 = 1 THEN '' END"
)
HOST = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('app-', CAST(user_id % 40 AS varchar(20))) END"
SERVICE = (
    "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 35 = 1 THEN '' "
    "ELSE concat('svc', CAST(user_id % 12 AS varchar(20))) END"
)
# A third of all rows have one text; the texts of templates 3 and 6 grow in number with the events.
RAW_LOG = """
CASE WHEN event_id % 3 = 0 THEN
  '<11>1 - mx-02 relayd - - heartbeat of broker lost for 40 s, queue outbound frozen'
ELSE CASE user_id % 8
WHEN 0 THEN concat('<11>1 - mx-02 relayd - - heartbeat of broker lost for ', CAST(41 + event_id % 9 AS varchar(20)),
  ' s, redis refuses token writes')
WHEN 1 THEN concat('{"lvl":"FATAL","unit":"ledger","peer":"led-', CAST(user_id % 16 AS varchar(20)),
  '","what":"quorum lost in round 12","commits":"held back"} ip=10.4.1.3')
WHEN 2 THEN concat('merge of segment ', CAST(user_id % 90 AS varchar(20)), ' given up: SegmentChecksumException', chr(10),
  '    at feed.Merger.fold(Merger.java:', CAST(user_id % 90 AS varchar(20)), ')', chr(10), '1 of 14 segments left as they were')
WHEN 3 THEN concat('WARNING app=uploads No space left on device /data/vol', CAST(user_id % 16 AS varchar(20)),
  '/', substr(md5(CAST(event_id AS varchar(20))), 1, 8), ' disk usage 100 percent')
WHEN 4 THEN concat('CRITICAL module=edge certificate expired for api', CAST(user_id % 24 AS varchar(20)),
  '.acme.test, TLS handshake failed')
WHEN 5 THEN concat('ERROR belt encoder lost its zero mark in parcel-sorter v7.', CAST(user_id % 4 AS varchar(20)),
  ', chute gpu camera blind')
WHEN 6 THEN concat('request ', event_type, ' rejected with payload ', props, ' trace ',
  substr(md5(CAST(event_id AS varchar(20))), 1, 12))
ELSE concat('  ', chr(9), 'Kafka consumer lag growing topic=orders group=g', CAST(user_id % 16 AS varchar(20)),
  ' topic=refunds ', chr(10), '  ')
END END
"""

PAYLOAD_ROW = [
    ("id", "event_id"),
    ("created_at", "CAST(ts AS timestamp)"),
    ("external_id", EXTERNAL_ID),
    ("server_ip", PAYLOAD_IP),
    ("host", HOST),
    ("service", SERVICE),
    ("severity", "'error'"),
    ("raw_log", RAW_LOG),
]

# --- seed knowledge -------------------------------------------------------------------------------
SEED_SCHEMA = (
    "id bigint, error_type string, title string, raw_log_sample string, root_cause string, "
    "user_guide string, engineer_guide string, occurrence_count int, source string, tags string, "
    "confidence double, is_active boolean, created_at string"
)
SEED_TIME = "2024-01-01 00:00:00"
SEED_KNOWLEDGE = [
    (
        1, "relay frozen", "Outbound queue stands still",
        "<11>1 - mx-02 relayd - - heartbeat of broker lost for 40 s, queue outbound frozen, redis refuses token writes",
        "Broker and redis share a volume that was full (oom on write)", "Mails come late.",
        "free the volume, then thaw the queue", 1, "seed:own", "queue, broker,redis", 1.0, True,
    ),
    (
        2, "quorum lost", "Ledger holds commits back",
        '{"lvl":"FATAL","unit":"ledger","peer":"led-02","what":"quorum lost in round 12","commits":"held back"} ip=10.4.1.3',
        "A mysql replica was busy with a report and did not vote", "Bookings appear with a delay.",
        "end the report; call the vote again", 4, "seed:own", "ledger,mysql, quorum,", 1.0, True,
    ),
    (
        3, "segment checksum", "Search index skips a segment",
        "merge of segment 88 given up: SegmentChecksumException\n    at feed.Merger.fold(Merger.java:88)\n1 of 14 segments left as they were",
        "Power was lost while the segment was written", "Search shows older entries for a while.",
        "write the segment again from the feed", 0, "seed:own", None, 1.0, True,
    ),
]

# --- one knowledge row per benchmark item --------------------------------------------------------------
BENCHMARK_ROW = [
    ("id", "100 + item_id"),
    ("error_type", "CASE WHEN item_id % 4 = 0 THEN NULL ELSE concat('type', CAST(item_id % 5 AS varchar(20))) END"),
    ("title", "concat('Item ', CAST(item_id AS varchar(20)))"),
    ("raw_log_sample", "text"),
    ("root_cause", "CASE WHEN item_id % 3 = 0 THEN NULL ELSE concat('cause ', left(text, 20)) END"),
    ("user_guide", "concat('guide for ', CAST(item_id AS varchar(20)))"),
    ("engineer_guide", "CASE WHEN item_id % 6 = 0 THEN '' ELSE concat('steps for ', CAST(item_id AS varchar(20))) END"),
    ("occurrence_count", "CAST(1 + item_id % 4 AS int)"),
    ("source", "'auto'"),
    ("tags", "CASE WHEN item_id % 2 = 0 THEN concat('a', CAST(item_id AS varchar(20)), ', b ,,c') END"),
    ("confidence", "CAST(0.5 AS double)"),
    ("is_active", "item_id % 7 <> 0"),
    ("created_at", "CAST('2024-01-02 00:00:00' AS timestamp) + (item_id % 29) * INTERVAL '1' DAY"),
]

# --- a stored alert table, one row per event -------------------------------------------------------
STORED_ROW = [
    ("id", "event_id"),
    ("external_id", EXTERNAL_ID),
    ("server_ip", PAYLOAD_IP),
    ("host", HOST),
    ("service", SERVICE),
    (
        "severity",
        "CASE event_id % 6 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'FATAL' WHEN 3 THEN 'err' "
        "WHEN 4 THEN 'INFO' ELSE 'critical' END",
    ),
    ("raw_log", RAW_LOG),
    ("error_message", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('seen by ', event_type) END"),
    ("stack_trace", "CAST(NULL AS varchar(20))"),
    (
        "matched_knowledge_id",
        "CASE WHEN event_id % 4 = 0 THEN 1 + event_id % 3 WHEN event_id % 4 = 1 THEN 100 + event_id % 60 END",
    ),
    (
        "similarity_score",
        "CASE WHEN event_id % 10 = 9 THEN NULL ELSE CAST(event_id % 1000 AS double) / 1000 END",
    ),
    (
        "match_status",
        "CASE event_id % 4 WHEN 0 THEN 'matched' WHEN 1 THEN 'deposited' WHEN 2 THEN 'new_incident' "
        "ELSE 'aggregated' END",
    ),
    ("status", "CASE WHEN event_id % 4 = 1 THEN 'resolved' ELSE 'open' END"),
    (
        "ai_summary",
        "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('about ', event_type) END",
    ),
    ("cluster_key", "CAST(NULL AS varchar(20))"),
    ("resolved_at", "CASE WHEN event_id % 4 = 1 THEN CAST(ts AS timestamp) END"),
    ("created_at", "CAST(ts AS timestamp)"),
    ("updated_at", "CAST(ts AS timestamp)"),
]

# --- resolution requests: one per label, joined with the event it is about; some name another alert or none ---
REQUEST_SOURCE = "labels LEFT JOIN events ON event_id = doc_id * 10"
REQUEST_ROW = [
    ("request_no", "doc_id"),
    ("alert_id", "CASE WHEN doc_id % 41 = 0 THEN -doc_id WHEN doc_id % 15 = 0 THEN doc_id * 10 - 10 ELSE doc_id * 10 END"),
    ("error_type", "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 'operator class' END"),
    (
        "root_cause",
        "CASE doc_id % 5 WHEN 0 THEN concat('redis evicted keys for ', coalesce(event_type, 'none')) "
        "WHEN 1 THEN concat('connection leak after long running reports in ', coalesce(event_type, 'none'), chr(10), 'second line') "
        "WHEN 2 THEN 'gpu driver mismatch' WHEN 3 THEN '' ELSE concat('heap dump shows ', coalesce(props, 'none')) END",
    ),
    ("resolution", "concat('restart ', coalesce(event_type, 'none'), chr(10), 'then watch')"),
    ("engineer", "CASE WHEN doc_id % 20 = 0 THEN NULL ELSE concat('eng', CAST(doc_id % 5 AS varchar(20))) END"),
    ("tag_text", "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE concat('t', CAST(doc_id % 3 AS varchar(20)), ',ops') END"),
    ("requested_at", "coalesce(CAST(ts AS timestamp), CAST('2024-02-20 00:00:00' AS timestamp)) + INTERVAL '30' MINUTE"),
]
