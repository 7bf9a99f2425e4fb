"""Text to vector: hashed word, word-pair and character-trigram weights, L2-normalised.

Texts are made distinct first, so a burst of equal logs costs one vector. A text's vector needs nothing but the
text: ``embed_texts`` sums its features in the task that holds it, so features are neither rows nor shuffled.
``feature_rows``, ``feature_weights``, ``bucket_weights`` and ``normalised`` are the same steps on tables of features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.functions import fixed_values as V
from emberwatch.settings import DEFAULTS

# The damped count reaches its fixed point (to the last bit of a double) well before this.
_DAMP_LIMIT = 64


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(V.WORD), F.lit(0))


def word_pairs(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(
        n > 1,
        F.zip_with(
            F.slice(tokens, F.lit(1), n - 1),
            F.slice(tokens, F.lit(2), n - 1),
            lambda a, b: F.concat(a, F.lit("_"), b),
        ),
    ).otherwise(F.array().cast("array<string>"))


def padded(text: Column) -> Column:
    return F.concat(F.lit(V.TEXT_START), F.lower(text), F.lit(V.TEXT_END))


def trigrams(chars: Column) -> Column:
    """Trigram features of an array of characters (linear in its length)."""
    n = F.size(chars)
    return F.when(
        n > 2,
        F.transform(
            F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
            lambda i: F.concat(
                F.lit(V.TRIGRAM_PREFIX),
                F.try_element_at(chars, i),
                F.try_element_at(chars, i + 1),
                F.try_element_at(chars, i + 2),
            ),
        ),
    ).otherwise(F.array().cast("array<string>"))


def damped(n: Column) -> Column:
    """Weight of a word seen ``n`` times: w(0) = 0, w(i) = 1 + ln(w(i-1) + 2)."""
    steps = F.sequence(F.lit(1), F.least(n, F.lit(_DAMP_LIMIT)).cast("int"))
    return F.aggregate(steps, F.lit(0.0), lambda w, _: 1 + F.log(w + 2))


def bucket(feature: Column, dim: int) -> Column:
    """Stable bucket of a feature: the last 60 bits of its MD5, modulo ``dim``."""
    tail = F.conv(F.substring(F.md5(feature), 18, 15), 16, 10).cast("bigint")
    return F.pmod(tail, F.lit(dim)).cast("int")


def distinct_texts(df: DataFrame, text_col: str) -> DataFrame:
    """``(text_key, text, n)``: every distinct text with its number of rows.

    Counted per map task first, so a text that fills a third of the input sends one row per task.
    """
    return (
        df.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
        .groupBy("text_key", "text")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _partitions(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def feature_rows(texts: DataFrame) -> DataFrame:
    """``(text_key, is_word, feature)``, one row per occurrence; a text without any keeps one row
    with a null feature. The input is partitioned by ``text_key`` for everything that follows.

    The number of partitions is stated: a text grows two hundredfold here, so partitions that look small enough to be
    joined at run time are not, and a million short texts would end in one task."""
    base = texts.select("text_key", "text").repartition(_partitions(texts.sparkSession), "text_key")
    arrays = base.select(
        "text_key", words("text").alias("tokens"), F.split(padded(F.col("text")), "").alias("chars")
    )
    tagged = F.concat(
        F.transform("tokens", lambda t: F.struct(F.lit(True).alias("is_word"), t.alias("feature"))),
        F.transform(
            F.concat(word_pairs(F.col("tokens")), trigrams(F.col("chars"))),
            lambda t: F.struct(F.lit(False).alias("is_word"), t.alias("feature")),
        ),
    )
    return arrays.select("text_key", F.explode_outer(tagged).alias("f")).select(
        "text_key", F.col("f.is_word").alias("is_word"), F.col("f.feature").alias("feature")
    )


def feature_weights(features: DataFrame) -> DataFrame:
    """``(text_key, is_word, feature, weight)``: damped for words, plain counts for the others."""
    n = F.col("n")
    return (
        features.groupBy("text_key", "is_word", "feature")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "text_key", "is_word", "feature",
            F.when(F.col("is_word"), damped(n)).otherwise(n.cast("double")).alias("weight"),
        )
    )


def bucket_weights(weights: DataFrame, dim: int = DEFAULTS.dim) -> DataFrame:
    """The sparse vector: ``(text_key, bucket, weight)`` summed per bucket, not yet normalised."""
    return (
        weights.select("text_key", bucket(F.col("feature"), dim).alias("bucket"), "weight")
        .groupBy("text_key", "bucket")
        .agg(F.sum("weight").alias("weight"))
    )


def normalised(sparse: DataFrame, dim: int = DEFAULTS.dim) -> DataFrame:
    """``(text_key, embedding array<float>)`` of unit length; all zeros for an empty text.

    Entries are sorted by bucket and the gaps between them filled with zeros, which is linear in ``dim``."""
    entry = F.when(F.col("bucket").isNotNull(), F.struct("bucket", "weight"))
    norm = F.sqrt(F.sum(F.when(F.col("bucket").isNotNull(), F.col("weight") * F.col("weight"))))
    grouped = sparse.groupBy("text_key").agg(
        F.sort_array(F.collect_list(entry)).alias("m"), norm.alias("norm")
    )

    def zeros(before: Column, to: Column) -> Column:
        return F.array_repeat(F.lit(0.0).cast("float"), (to - F.coalesce(before, F.lit(-1)) - 1).cast("int"))

    filled = F.transform(
        "m",
        lambda e, i: F.concat(
            zeros(F.get(F.col("m"), i - 1)["bucket"], e["bucket"]),
            F.array((e["weight"] / F.col("norm")).cast("float")),
        ),
    )
    last = F.get(F.col("m"), F.size("m") - 1)["bucket"]
    return grouped.select("text_key", F.concat(F.flatten(filled), zeros(last, F.lit(dim))).alias("embedding"))


_PART_TEXTS, _PART_CHARS = 1_024, 1 << 20  # what one task turns into vectors at once; a longer text goes alone
_MODEL_ROWS = 1_024  # texts handed to a model at once
_SEEN = 1 << 17  # words and word pairs whose buckets a task remembers, and as many trigrams


def _text_vectors(dim: int) -> Callable[[list[str]], np.ndarray]:
    """The vectors of some lower-case texts: the sums of ``feature_weights`` per bucket, of unit length."""

    def plain_place(feature: str) -> int:
        return int.from_bytes(md5(feature.encode("utf-8", "surrogatepass")).digest()[8:]) % 2**60 % dim

    place = lru_cache(_SEEN)(plain_place)
    low = (1 << 21) - 1

    @lru_cache(_SEEN)
    def gram_place(g: int) -> int:
        return plain_place(f"{V.TRIGRAM_PREFIX}{chr(g >> 42)}{chr(g >> 21 & low)}{chr(g & low)}")

    steps = [0.0]
    for _ in range(_DAMP_LIMIT):
        steps.append(1 + math.log(steps[-1] + 2))
    find = re.compile(V.WORD).findall

    def vectors(texts: list[str]) -> np.ndarray:
        at, weights = [], []
        for row, text in enumerate(texts):
            tokens, first = find(text), row * dim
            counts = Counter(tokens)
            at += [first + place(w) for w in counts]
            weights += [steps[min(n, _DAMP_LIMIT)] for n in counts.values()]
            at += [first + place(f"{a}_{b}") for a, b in zip(tokens, tokens[1:])]
            weights += [1.0] * (len(tokens) - 1)
        sums = np.bincount(np.array(at, dtype=np.int64), weights, len(texts) * dim)

        # trigrams as numbers: each different one is looked up once per call
        framed = [f"{V.TEXT_START}{t}{V.TEXT_END}" for t in texts]
        chars = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in framed])
        inside = rows[2:] == rows[:-2]
        grams = ((chars[:-2] << 42) | (chars[1:-1] << 21) | chars[2:])[inside]
        names, which = np.unique(grams, return_inverse=True)
        places = np.fromiter(map(gram_place, names.tolist()), dtype=np.int64, count=len(names))
        sums += np.bincount(rows[2:][inside] * dim + places[which], minlength=len(sums))
        sums = sums.reshape(len(texts), dim)
        length = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        return sums / np.where(length == 0, 1.0, length)[:, None]

    return vectors


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with a bounded number of texts and characters."""
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and (i - start == _PART_TEXTS or chars + len(text) > _PART_CHARS):
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def embed_texts(texts: DataFrame, dim: int = DEFAULTS.dim, keep: tuple[str, ...] = (), by: Column | None = None) -> DataFrame:
    """``(text_key, embedding)`` of distinct texts; all zeros for a null text. Columns named in ``keep`` are carried
    along, rows are dealt by ``by`` if it is given, and equal texts that follow each other are worked out once.

    The number of partitions is stated: work grows with the characters, so partitions that look small enough to be
    joined at run time are not, and a million short texts would end in one task."""
    names = ["text_key", *keep]
    base = texts.repartition(_partitions(texts.sparkSession), "text_key" if by is None else by)
    if by is not None:
        base = base.sortWithinPartitions("text")
    base = base.select(F.lower("text").alias("text"), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _text_vectors(dim)
        for batch in batches:
            # a null text has no features, like an empty one
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, end in _parts(texts):
                part = texts[start:end]
                first = np.array([i == 0 or part[i] != part[i - 1] for i in range(len(part))])
                found = vectors([t for t, new in zip(part, first) if new]).astype(np.float32)
                flat = pa.array(found[np.cumsum(first) - 1].ravel())
                bounds = pa.array(np.arange(end - start + 1, dtype=np.int32) * dim)
                kept = [batch.column(c).slice(start, end - start) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(bounds, flat)], [*names, "embedding"])

    schema = T.StructType([*base.select(*names).schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return base.mapInArrow(run, schema)


def embed(df: DataFrame, text_col: str, dim: int = DEFAULTS.dim) -> DataFrame:
    """Add ``embedding`` (and ``text_key``) to every row."""
    from emberwatch.operators.skew import join_per_text, shared_texts

    texts = shared_texts(df, text_col)
    return join_per_text(df, text_col, embed_texts(texts, dim), texts, row_bytes=4 * dim + 64)


def embed_batch(
    df: DataFrame, text_col: str, make_model: Callable[[], Callable[[list[str]], list]]
) -> DataFrame:
    """Add ``embedding`` from a user's batch model.

    ``make_model`` runs once per partition and returns a callable that maps a list of texts to
    vectors in the same order. An empty batch is not sent to the model; a large one goes in runs of ``_MODEL_ROWS``.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            # only texts become Python objects, some at a time; the other columns stay as they came
            at = batch.schema.get_field_index(text_col)
            for start in range(0, len(batch), _MODEL_ROWS):
                part = batch.slice(start, _MODEL_ROWS)
                texts = part.column(at).to_pylist()
                found = model(texts)
                if len(found) != len(texts):
                    raise ValueError(f"model returned {len(found)} vectors for {len(texts)} texts")
                vectors = pa.array([[float(x) for x in v] for v in found], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], [*part.schema.names, "embedding"])

    return df.mapInArrow(run, schema)
