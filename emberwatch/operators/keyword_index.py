"""Keyword search that reads only files which can hold the keyword.

Rows are kept as Parquet files; beside them lies a table ``(col, gram, file)``: for every searched column the hashes of
all three-character runs of its lower-case text, once per file. It is sorted, so a look-up reads the few row groups
that hold the keyword's runs. A file is read if one column has all of them; :func:`listing.filter_keyword` then decides
row by row, so the result equals the search without an index.

Layout: ``path/<generation>/rows`` and ``path/<generation>/grams``. A generation counts once its grams are written: a job
that dies before leaves rows that nobody sees, and is run again with the next number.

Defined cases: null and empty texts have no runs; wildcards (``%``, ``_``) part the keyword, and every part of three or
more characters is looked up; a keyword without such a part reads all files; an empty keyword filters nothing; a column
that was not indexed is an error; an empty table has no file to read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.operators.listing import ALERT_SEARCH, filter_keyword

GRAM = 3
FILE_ROWS = 200_000
_GRAMS = "col string, gram bigint, file string"


def grams_of(text: Column) -> Column:
    """Hashes of the distinct three-character runs of a lower-case text; linear in its length."""
    def runs(c: Column) -> Column:
        run = lambda i: F.xxhash64(*[F.get(c, i + k) for k in range(GRAM)])
        some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - GRAM, F.lit(0))), run))
        return F.when(F.size(c) >= GRAM, some).otherwise(F.array().cast("array<bigint>"))

    # a lambda's argument is computed once, an expression inside a lambda for every element
    return F.get(F.transform(F.array(F.split(F.lower(F.coalesce(text, F.lit(""))), "")), runs), 0)


def add_rows(
    df: DataFrame, path: str, generation: int, cols: tuple[str, ...] = ALERT_SEARCH, file_rows: int = FILE_ROWS
) -> None:
    """Write ``df`` as one more generation. Files have at most ``file_rows`` rows; the closer the rows of a file are
    (one service, one day), the fewer files a keyword needs."""
    spark, home = df.sparkSession, f"{path.rstrip('/')}/{generation:06d}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(f"{home}/rows")
    kept = spark.read.schema(df.schema).parquet(f"{home}/rows")
    kept = kept.select(*cols, F.concat(F.lit(f"{home}/rows/"), F.col("_metadata.file_name")).alias("file"))
    # the null run says that the column is indexed and the file exists
    per_col = [
        kept.select(F.lit(c).alias("col"), "file", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), grams_of(F.col(c)))).alias("gram"))
        for c in cols
    ]
    found = reduce(DataFrame.unionByName, per_col).select("col", "gram", "file").distinct()
    found.repartitionByRange("col", "gram").sortWithinPartitions("col", "gram").write.parquet(f"{home}/grams")


def candidate_files(spark: SparkSession, path: str, q: str, cols: tuple[str, ...] = ALERT_SEARCH) -> list[str]:
    """Files in which a row may match, at most all there are."""
    indexed = spark.read.schema(_GRAMS).parquet(f"{path.rstrip('/')}/*/grams")
    grams = indexed.where(F.col("col").isin(*cols))
    parts = F.split(F.lit(q), "[%_]")
    wanted = spark.range(1).select(F.array_distinct(F.flatten(F.transform(parts, grams_of))).alias("g")).first()["g"]
    named = grams.where("gram is null").groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    missing = set(cols) - {r["col"] for r in named.collect()}
    if missing and not indexed.isEmpty():
        raise ValueError(f"not indexed: {', '.join(sorted(missing))}")
    if not wanted:
        able = grams.where("gram is null")
    else:
        able = grams.where(F.col("gram").isin(*wanted)).groupBy("col", "file").agg(F.count(F.lit(1)).alias("n"))
        able = able.where(F.col("n") == len(wanted))
    return sorted(r["file"] for r in able.select("file").distinct().collect())  # file names, no rows


def search(
    spark: SparkSession, path: str, q: str, schema: str, cols: tuple[str, ...] = ALERT_SEARCH
) -> DataFrame:
    """The rows that :func:`listing.filter_keyword` finds in all generations."""
    files = candidate_files(spark, path, q or "", cols)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return filter_keyword(rows, q, cols)
