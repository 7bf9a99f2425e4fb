"""Writers. Tables are appended to or written to a new place, never rewritten in place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch import schemas
from emberwatch.cluster_io import cut


def append_alerts(df: DataFrame, path: str) -> None:
    """Append triaged alerts, one folder per calendar day."""
    rows = df.select(*schemas.ALERTS.names).withColumn("date", F.to_date("created_at"))
    rows.write.mode("append").partitionBy("date").parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Write the vector table to a new folder, one sub-folder per namespace."""
    df.select(*schemas.VECTORS.names).write.mode("errorifexists").partitionBy("namespace").parquet(path)


def emit_notifications(
    df: DataFrame, make_sender: Callable[[], Callable[[dict], None]] | None = None
) -> DataFrame:
    """Deliver notifications; returns them with ``ok`` and ``error``.

    ``make_sender`` runs once per partition. A delivery that fails is recorded and does not stop
    the others. Without a sender every row counts as delivered (the table itself is the sink).
    The notifications are delivered here, once; the result is a written copy that can be read any number of
    times. Only a task that is repeated after a failure delivers its rows again."""
    if make_sender is None:
        return df.withColumns({"ok": F.lit(True), "error": F.lit(None).cast("string")})
    return cut(_sent(df, make_sender))


def deliver_once(
    df: DataFrame,
    make_sender: Callable[[], Callable[[dict], None]],
    ledger: str,
    batch: int,
    key: str | list[str],
) -> DataFrame:
    """Deliver the notifications of a batch, and none twice when the batch is repeated; returns them with
    ``delivery_key``, ``ok`` and ``error``.

    ``ledger`` is a folder with one sub-folder per batch. A task that ends puts its rows there at once, also if the job
    fails later, and a repeated batch sends only what the ledger of that batch does not show as delivered: failed
    rows are tried again. Rows of one batch with equal ``key`` columns are one notification; the first by content is sent.

    The one gap left is a task that dies between a delivery and its end: its rows are sent again, with the same
    ``delivery_key`` (batch and key columns), by which a receiver can tell. Keep speculative execution off."""
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else key
    named = df.withColumn(
        "delivery_key", F.sha2(F.concat_ws(":", F.lit(str(batch)), F.to_json(F.struct(*keys))), 256)
    )
    place = f"{ledger}/batch={batch}"
    schema = T.StructType(
        [*named.schema.fields, *_OUTCOME, T.StructField("attempt", T.LongType())]
    )
    before = _ledger(spark, place, schema)
    attempt = before.agg(F.coalesce(F.max("attempt") + 1, F.lit(0))).first()[0]
    delivered = before.where("ok").select("delivery_key")
    order = Window.partitionBy("delivery_key").orderBy(F.xxhash64(F.to_json(F.struct(*df.columns))))
    open_rows = (
        named.join(delivered, "delivery_key", "left_anti").select(*named.columns)
        .withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    )
    # rows of finished tasks move to the ledger when their task ends, not when the job does
    _sent(open_rows, make_sender).withColumn("attempt", F.lit(attempt)).write.mode("append").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2"
    ).parquet(place)
    after = _ledger(spark, place, schema)
    return after.where(F.col("ok") | (F.col("attempt") == attempt)).drop("attempt")


_OUTCOME = [T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())]


def _ledger(spark: SparkSession, place: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(place)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _sent(df: DataFrame, make_sender: Callable[[], Callable[[dict], None]]) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *_OUTCOME])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = make_sender()
        for pdf in batches:
            errors = []
            for row in pdf.to_dict("records"):
                try:
                    send(row)
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - any failure of the sender is data here
                    errors.append(str(exc))
            yield pdf.assign(
                ok=[e is None for e in errors], error=pd.Series(errors, index=pdf.index, dtype="object")
            )

    return df.mapInPandas(run, schema)
