"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams (3 to 5 characters, lower case, one blank at either end) that it
has at all. From the number of toxic and of other training texts that have a bucket comes the bucket's log-count
ratio ``r``; these counts cover every labelled training row. A bucket whose ratio lies within
``Z`` standard errors of zero is left out. Logistic regression then learns one weight per remaining
bucket over the features ``r * present``; it is fitted on a bounded sample: per class the ``SAMPLE``
training rows with the smallest hashes of their id, weighted to the classes' true shares. Scores
are probabilities.

The model is one number per bucket (4 MB), whatever the corpus, and is broadcast. Counting sends, per task,
one packed row for each of 64 ranges of buckets.

Defined cases: null and empty texts have only the n-grams of blanks and get the score that the intercept gives
them; rows without a label, with a null label or a null id are not learned from; of several labels of a
document the largest counts; without labels, or with one class only, every score is the smoothed
share of toxic rows; repeated rows are scored each for itself."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.llm.common import fold, stash, unused
from emberwatch.operators.skew import join_lookup

LENGTHS = (3, 4, 5)
BITS = 20
SAMPLE = 4_000
Z = 3.0
THRESHOLD = 0.3
_RANGE = 1 << 14  # buckets in one packed row
_STEP = 1 << 20  # characters hashed at once


class NGrams:
    """The distinct n-gram buckets of a text, in order."""

    def __init__(self, lengths: tuple[int, ...] = LENGTHS, bits: int = BITS):
        self.lengths, self.shift = lengths, np.uint32(32 - bits)

    def of(self, text: str | None) -> np.ndarray:
        codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le"), dtype="<u4")
        found, longest = np.zeros(0, dtype=np.uint32), max(self.lengths)
        for lo in range(0, len(codes), _STEP):
            part, parts = codes[lo:lo + _STEP + longest - 1], [found]
            h = np.zeros(len(part), dtype=np.uint32)
            for n in range(1, min(longest, len(part)) + 1):
                h = h[: len(part) - n + 1] * np.uint32(0x01000193)
                h += part[n - 1:]
                if n in self.lengths:
                    mixed = h ^ h >> np.uint32(15)
                    mixed *= np.uint32(0x9E3779B1)
                    mixed >>= self.shift
                    parts.append(mixed)
            found = np.concatenate(parts)
            found.sort()
            fresh = np.ones(len(found), dtype=bool)
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            found = found[fresh]
        return found.astype(np.int64)


@dataclass
class Model:
    """``score = sigmoid(bias + sum of weight over the text's buckets)``."""

    weight: np.ndarray
    bias: float

    def score(self, grams: NGrams, text: str | None) -> float:
        z = self.bias + float(self.weight[grams.of(text)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, toxic)`` of the documents with a label."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return join_lookup(docs.select("doc_id", "text"), stash(known, "toxicity-labels"), "doc_id", "inner")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, rows = NGrams(), np.zeros(2, dtype=np.int64)
    count = np.zeros((1 << BITS, 2), dtype="<u4")
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            count[grams.of(text), min(toxic, 1)] += 1
            rows[min(toxic, 1)] += 1
    if rows.any():
        yield from _packed(count.astype("<i8"), rows)


def _packed(count: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, lo in enumerate(range(0, len(count), _RANGE)):
        values = [[i], [count[lo:lo + _RANGE].tobytes()], [int(rows[0])], [int(rows[1])]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["part", "counts", "others", "toxics"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            count = np.frombuffer(row["counts"], dtype="<i8")
            if (own := total.get(row["part"])) is None:
                total[row["part"]] = [count.copy(), row["others"], row["toxics"]]
            else:
                own[0] += count
                own[1] += row["others"]
                own[2] += row["toxics"]
    for part, (count, others, toxics) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([count.tobytes()]), pa.array([others]), pa.array([toxics])],
            ["part", "counts", "others", "toxics"],
        )


def log_count_ratios(train: DataFrame) -> tuple[np.ndarray, int, int]:
    """Ratio of every bucket (0 where it is within the noise), and the rows of either class."""
    kind = "part bigint, counts binary, others bigint, toxics bigint"
    counted = train.select("text", "toxic").mapInArrow(_counted, kind)
    rows = counted.repartition("part").mapInArrow(_added, kind).collect()  # one row per range of buckets
    if not rows:
        return np.zeros(1 << BITS), 0, 0
    count = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in sorted(rows, key=lambda r: r["part"])]).reshape(-1, 2)
    others, toxics = rows[0]["others"], rows[0]["toxics"]
    q, p = count[:, 0] + 1.0, count[:, 1] + 1.0
    ratio = np.log(p / (toxics + 2)) - np.log(q / (others + 2))
    ratio[np.abs(ratio) < Z * np.sqrt(1 / p + 1 / q)] = 0
    return ratio, others, toxics


def _sample(train: DataFrame, size: int) -> DataFrame:
    """Per class the rows with the smallest hashes; only hashes are ordered, texts stay where they are."""
    mixed = train.withColumn("_h", F.xxhash64(F.col("doc_id").cast("string")))
    parts = []
    for toxic in (0, 1):
        own = mixed.where(F.least("toxic", F.lit(1)) == toxic)
        last = own.select("_h").orderBy("_h").limit(size).agg(F.max("_h")).first()[0]
        parts.append(own.where(F.col("_h") <= F.lit(last)))
    return parts[0].unionByName(parts[1])


def _fit(grams: np.ndarray, size: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ratio: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weighted logistic regression over ``ratio * present`` by full gradients with Adam steps. ``grams`` holds
    the buckets of all rows, ``size[i]`` of them of row i; they are kept as 32-bit numbers and never sorted."""
    present = np.zeros(len(ratio), dtype=bool)
    present[grams] = True
    used = np.flatnonzero(present)
    at = (np.cumsum(present, dtype=np.int32) - 1)[grams]
    filled, start = np.flatnonzero(size), (np.cumsum(size) - size)[size > 0]
    scale, share = ratio[used].astype(np.float32), (weight / weight.sum()).astype(np.float32)
    w, bias = np.zeros(len(used), dtype=np.float32), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        z = np.full(len(size), bias)
        if len(filled):
            z[filled] += np.add.reduceat((scale * w)[at], start)
        slope = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic)
        moved = np.zeros(len(used))
        for lo in range(0, len(filled), 512):  # some rows at a time, so that no second array is as long as ``grams``
            rows = filled[lo:lo + 512]
            first, last = start[lo], start[lo] + size[rows].sum()
            moved += np.bincount(at[first:last], weights=np.repeat(slope[rows], size[rows]), minlength=len(used))
        gradient = np.append(scale * moved + l2 * w, slope.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, bias = w - move[:-1].astype(np.float32), bias - move[-1]
    full = np.zeros(len(ratio), dtype=np.float32)
    full[used] = scale * w
    return full, float(bias)


def train(docs: DataFrame, labels: DataFrame, wanted: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows of ``docs`` for which ``wanted`` holds."""
    rows = labelled(docs if wanted is None else docs.where(wanted), labels)
    ratio, others, toxics = log_count_ratios(rows)
    if not others or not toxics:
        share = (toxics + 1) / (others + toxics + 2)
        return Model(np.zeros(1 << BITS, dtype=np.float32), float(np.log(share / (1 - share))))
    kept = rows.sparkSession.sparkContext.broadcast(ratio != 0)

    def strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for batch in batches:
            found = [(x := grams.of(t))[kept.value[x]].astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("toxic")], ["grams", "toxic"])

    got = _sample(rows, sample).select("text", "toxic").mapInArrow(strong, "grams binary, toxic int").toArrow()
    toxic = (got["toxic"].to_numpy() > 0).astype(float)
    size = np.array([len(g.as_buffer()) // 4 for g in got["grams"]], dtype=np.int64)
    grams = np.concatenate([np.zeros(0, "<i4"), *(np.frombuffer(g.as_buffer(), "<i4") for g in got["grams"])])
    del got
    each = np.where(toxic > 0, toxics / max(toxic.sum(), 1), others / max((1 - toxic).sum(), 1))
    return Model(*_fit(grams, size, toxic, each, ratio))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(text: pa.Array) -> pa.Array:
        grams = NGrams()
        return pa.array([shared.value.score(grams, t) for t in text.to_pylist()], pa.float64())

    return docs.withColumn(out, F.arrow_udf(scores, T.DoubleType())("text"))


def learnable() -> Column:
    """Rows that may be learned from; the others are held out."""
    return fold("doc_id", 4) != 2


def remove_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject."""
    own = unused(docs, "_toxic")
    return score(docs, model, own).where(F.col(own) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: score and decision."""
    model = train(docs, labels, learnable())
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
