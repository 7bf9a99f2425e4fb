"""Importance resampling towards a target: hashed word n-grams, Gumbel top-k.

**Words and features.** A text's UTF-8 bytes go through one 256-byte table that lower-cases A-Z and turns every other
ASCII byte but digits and letters into a blank; bytes of longer UTF-8 sequences stay. ``bytes.split`` then gives the
words. A feature is a run of 1 to ``order`` words. Its bucket is the CRC-32 of the run with one blank between the words, modulo
``buckets``; the checksum of a run is carried on by the next word (``crc32(b" " + word, seed)``), so no run is ever put
together. Counters reduce: one per task, with a key per bucket.

**Weights.** With s and t the counts of a bucket in the raw and in the target texts, S and T of all buckets, the
bucket's gain is ``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))``. A text's weight is the floored
mean of its features' gains. A draw adds Gumbel noise that depends on the seed and doc_id alone, and takes the highest scores:
a sample without replacement in proportion to the weights.

**Scale.** A task sends at most one row per bucket it met to the counts' shuffle (``buckets`` rows at most, whatever the corpus is). The
gains are one array of ``buckets`` 64-bit numbers, which is all that is broadcast. Ranks come from a sort by score: rows are
dealt to ranges, counted per range, and numbered inside their range from the sum of the ranges before; no task sees more than a range.
Scores that many rows share are parted by doc_id and then by row.

Defined cases: a null or empty text has no features, weight 0, and is never drawn if ``least_words`` is above 0; a null doc_id
has the noise of the empty text and comes last among ties; repeated rows are counted, scored and drawn each for itself; empty tables: an empty raw table
gives an empty result, an empty target counts as zero everywhere; extra columns are not looked at."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import numbered, stash

BUCKETS = 10_000
ORDER = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_TABLE).split() if text else []


def buckets_of(words: list[bytes], order: int = ORDER, buckets: int = BUCKETS) -> list[int]:
    """The bucket of every feature of a text: runs of one word first, then of two, and so on."""
    seeds = [crc32(w) for w in words]
    found = [s % buckets for s in seeds]
    tails = [b" " + w for w in words]
    for n in range(1, order):
        seeds = list(map(crc32, tails[n:], seeds))
        found += [s % buckets for s in seeds]
    return found


def _counted(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A task's features per bucket."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(buckets_of(words_of(text), order, buckets))
    yield pa.RecordBatch.from_pydict(
        {"bucket": list(counts), "n": list(counts.values())}, schema=pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
    )


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket."""
    counts = (
        texts.select("text").mapInArrow(lambda batches: _counted(batches, order, buckets), "bucket bigint, n bigint")
        .groupBy("bucket").agg(F.sum("n").alias("n"))
    )
    out = np.zeros(buckets, dtype=np.int64)
    for row in counts.toLocalIterator():  # one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the log ratio of the smoothed shares, in thousandths, floored."""
    n, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n))))
        for s, t in zip(raw.tolist(), target.tolist())
    ], dtype=np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the SHA-256 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """``docs`` (doc_id, text) with ``n_words, n_features, weight`` instead of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found = buckets_of(words, order, len(own))
                n_words.append(len(words))
                n_features.append(len(found))
                weight.append(int(own[np.array(found)].sum()) // len(found) if found else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return docs.select("doc_id", "text").mapInArrow(weighed, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    seed: int = SEED, order: int = ORDER, buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs`` (doc_id, text); ``rank`` is null where the row
    is not drawn. ``floor(percent * N / 100)`` of the N rows with at least ``least_words`` words are drawn."""
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    rows = stash(
        weights(docs, gain, order).select(
            "*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"),
            (F.col("n_words") >= least_words).alias("eligible"), F.monotonically_increasing_id().alias("row"),
        ),
        "resample-scores",
    )
    draw = percent * rows.where("eligible").count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranked = numbered(rows.where("eligible"), order, "resample-order").withColumn(
        "rank", F.when(F.col("position") < draw, F.col("position") + 1)
    )
    others = rows.where("NOT eligible").withColumn("rank", F.lit(None).cast("bigint"))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(others.select(*names))


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document, with its place in the draw."""
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
