import pytest
from pyspark.sql import functions as F

from emberwatch.sources.sinks import deliver_once


@pytest.fixture
def notices(spark):
    return spark.range(40).select(F.col("id").alias("alert_id"), F.concat(F.lit("t"), "id").alias("title"))


def counting(folder, fails=()):
    """A sender that writes one letter per delivery to the file of its alert."""

    def make_sender():
        def send(row):
            if row["alert_id"] in fails:
                raise RuntimeError("no route")
            with open(folder / str(row["alert_id"]), "a") as out:
                out.write("x")

        return send

    return make_sender


def sent(folder):
    return {int(f.name): len(f.read_text()) for f in folder.iterdir()}


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    return folder


def test_repeated_batch_sends_nothing_again(notices, inbox, tmp_path):
    for _ in range(3):
        rows = deliver_once(notices, counting(inbox), f"{tmp_path}/ledger", 4, "alert_id")
        assert rows.where("ok AND error IS NULL").count() == rows.count() == 40
    assert sent(inbox) == {i: 1 for i in range(40)}
    # another batch is another delivery, with other keys
    other = deliver_once(notices, counting(inbox), f"{tmp_path}/ledger", 5, "alert_id")
    assert sent(inbox) == {i: 2 for i in range(40)}
    assert rows.join(other, "delivery_key").count() == 0


def test_only_failed_rows_are_tried_again(notices, inbox, tmp_path):
    first = deliver_once(notices, counting(inbox, {3, 8}), f"{tmp_path}/ledger", 0, "alert_id")
    assert {r["alert_id"] for r in first.where("NOT ok AND error = 'no route'").collect()} == {3, 8}
    second = deliver_once(notices, counting(inbox, {8}), f"{tmp_path}/ledger", 0, "alert_id")
    assert second.count() == 40 and [r["alert_id"] for r in second.where("NOT ok").collect()] == [8]
    third = deliver_once(notices, counting(inbox), f"{tmp_path}/ledger", 0, "alert_id")
    assert third.where("ok").count() == third.count() == 40
    assert sent(inbox) == {i: 1 for i in range(40)}


def test_failed_job_keeps_the_rows_of_finished_tasks(spark, inbox, tmp_path):
    """The last of four tasks waits for the others, then fails the job."""
    rows = spark.range(40).select(F.col("id").alias("alert_id"), (F.col("id") % 4).alias("part"))
    ledger = tmp_path / "ledger"

    plain_sender = counting(inbox)

    def breaking():
        plain = plain_sender()

        def send(row):
            if row["alert_id"] == 39:
                import time

                for _ in range(300):
                    if sum(1 for _ in ledger.rglob("part-*.parquet") if "_temporary" not in str(_)) >= 1:
                        break
                    time.sleep(0.1)
                raise SystemExit("worker lost")
            plain(row)

        return send

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with pytest.raises(Exception, match="worker lost|SystemExit|crashed|Python"):
            deliver_once(rows, breaking, str(ledger), 0, "alert_id").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    done = {r["alert_id"] for r in spark.read.parquet(f"{ledger}/batch=0").where("ok").collect()}
    assert done
    again = deliver_once(rows, counting(inbox), str(ledger), 0, "alert_id")
    assert again.where("ok").count() == again.count() == 40
    assert all(sent(inbox)[i] == 1 for i in done)


def test_equal_keys_and_empty_batches(spark, notices, inbox, tmp_path):
    twice = notices.where("alert_id < 2").unionByName(notices.where("alert_id < 2"))
    assert deliver_once(twice, counting(inbox), f"{tmp_path}/ledger", 0, "alert_id").count() == 2
    assert sent(inbox) == {0: 1, 1: 1}
    assert deliver_once(notices.where("alert_id < 0"), counting(inbox), f"{tmp_path}/ledger", 1, "alert_id").count() == 0


def test_streams_deliver_their_notices(spark, make_alerts, inbox, tmp_path):
    from emberwatch.sources import tables as sources
    from emberwatch.streaming import jobs

    def make_sender():
        def send(row):
            assert len(row["delivery_key"]) == 64
            with open(inbox / str(row["cluster_key"]), "a") as out:
                out.write("x")

        return send

    text = "ERROR service=mail relay handshake refused by peer"
    for second in (0.0, 5_000.0):
        rows = make_alerts([(int(second) + i, second + i, "mail", text) for i in range(2)])
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = sources.stream_alerts(
        spark, f"{tmp_path}/in", "parquet", ("id bigint", "created_at timestamp"), maxFilesPerTrigger="1"
    )
    jobs.stream_clusters(
        stream, f"{tmp_path}/out", f"{tmp_path}/mark", 60, available_now=True, make_sender=make_sender
    ).awaitTermination()
    # the second burst closed the cluster of the first and is still open itself
    assert sent(inbox) == {0: 1}
    closed = spark.read.parquet(f"{tmp_path}/out/clusters")
    assert [(r["cluster_key"], r["count"], r["ok"]) for r in closed.collect()] == [(0, 2, True)]
