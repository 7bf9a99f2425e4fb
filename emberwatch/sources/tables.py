"""Readers with fixed schemas. Nothing is inferred; a bad record is reported, not dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch import schemas
from emberwatch.functions import fixed_values as V

_BAD = "_corrupt_record"
KNOWLEDGE_REQUIRED = ("title", "raw_log_sample", "user_guide", "engineer_guide")
RESOLUTION_REQUIRED = ("alert_id", "root_cause", "resolution")


def _with(schema: T.StructType, *extra: str) -> T.StructType:
    return T.StructType([*schema.fields, *schemas.columns(*extra)])


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    if fmt == "json":
        full = _with(schema, f"{_BAD} string")
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
        return spark.read.schema(full).options(**options).json(path)
    return spark.read.schema(schema).format(fmt).load(path).withColumn(_BAD, F.lit(None).cast("string"))


def split_complete(df: DataFrame, *required: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): a valid record parsed and carries every required field."""
    wrong = F.col(_BAD).isNotNull() if _BAD in df.columns else F.lit(False)
    for name in required:
        wrong = wrong | F.col(name).isNull()
    return df.where(~wrong).drop(_BAD), df.where(wrong)


def split_payloads(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) alert payloads: a record must parse and its ``raw_log`` must not be empty
    (blanks are allowed). Missing severities get their default."""
    bad = F.col(_BAD).isNotNull() if _BAD in df.columns else F.lit(False)
    wrong = bad | F.col("raw_log").isNull() | (F.col("raw_log") == "")
    filled = df.withColumn("severity", F.coalesce("severity", F.lit("error")))
    return filled.where(~wrong).drop(_BAD), df.where(wrong)


def read_alerts(
    spark: SparkSession, path: str, fmt: str = "json", extra: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). ``extra`` names further columns of the files, such as ``id bigint``."""
    return split_payloads(_read(spark, path, fmt, _with(schemas.ALERT_PAYLOAD, *extra)))


def with_knowledge_defaults(df: DataFrame) -> DataFrame:
    """Manual knowledge rows: source ``manual``, full confidence, count 1, active; no tags is null."""
    return df.withColumns(
        {
            "source": F.coalesce("source", F.lit("manual")),
            "confidence": F.lit(1.0),
            "tags": F.when(F.size("tags") > 0, F.array_join("tags", ",")),
            "occurrence_count": F.lit(1),
            "is_active": F.lit(True),
        }
    )


def read_knowledge(
    spark: SparkSession, path: str, fmt: str = "json", extra: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) knowledge rows; valid ones have their defaults."""
    schema = _with(schemas.KNOWLEDGE_PAYLOAD, *extra)
    valid, rejected = split_complete(_read(spark, path, fmt, schema), *KNOWLEDGE_REQUIRED)
    return with_knowledge_defaults(valid), rejected


def with_resolution_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "engineer": F.coalesce("engineer", F.lit("engineer")),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
        }
    )


def read_resolutions(
    spark: SparkSession, path: str, fmt: str = "json", extra: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) resolution requests; valid ones have their defaults."""
    schema = _with(schemas.RESOLUTION, *extra)
    valid, rejected = split_complete(_read(spark, path, fmt, schema), *RESOLUTION_REQUIRED)
    return with_resolution_defaults(valid), rejected


def action_catalog(spark: SparkSession) -> DataFrame:
    """The remediation actions as a constant table."""
    return spark.createDataFrame(list(V.ACTIONS), schemas.ACTION_CATALOG)


def import_vector_snapshot(spark: SparkSession, glob: str, magic: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) vector rows of JSON snapshots ``{magic, data: {namespace: {id: [text, [floats]]}}}``.

    A file with another magic, or one that does not parse, gives no rows. Rejected are entries of a good file
    whose id is no number or whose vector cannot be read; their ``id`` stays as it was written. A
    snapshot is one JSON value, so a file is read by one task (2 GB at most); many files are read in
    parallel."""
    shape = "struct<magic:string,data:map<string,map<string,array<string>>>>"
    blob = spark.read.text(glob, wholetext=True).select(F.from_json("value", shape).alias("b"))
    spaces = blob.where(F.col("b.magic") == magic).select(
        F.explode("b.data").alias("namespace", "items")
    )
    rows = spaces.select("namespace", F.explode("items").alias("name", "item")).select(
        "namespace", "name",
        F.expr("try_cast(name AS bigint)").alias("id"),
        F.try_element_at("item", F.lit(1)).alias("text"),
        F.from_json(F.try_element_at("item", F.lit(2)), "array<float>").alias("embedding"),
    )
    vector_reads = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    good = F.col("id").isNotNull() & F.coalesce(vector_reads, F.lit(False))
    rejected = rows.where(~good).select("namespace", F.col("name").alias("id"), "text", "embedding")
    return rows.where(good).drop("name"), rejected


def stream_alerts(
    spark: SparkSession, path: str, fmt: str = "json", extra: tuple[str, ...] = (), **options: str
) -> DataFrame:
    """Alert payloads as an unbounded input: files, or ``fmt="kafka"`` with JSON values.

    A record that does not parse keeps its text in ``_corrupt_record``; the streaming jobs split such
    records off with :func:`split_payloads` and write them to ``rejected``."""
    schema = _with(schemas.ALERT_PAYLOAD, *extra)
    keep = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load()
        body = F.from_json(F.col("value").cast("string"), _with(schema, f"{_BAD} string"), keep)
        return raw.select(body.alias("p")).select("p.*")
    if fmt == "json":
        return spark.readStream.schema(_with(schema, f"{_BAD} string")).options(**keep | options).json(path)
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)
