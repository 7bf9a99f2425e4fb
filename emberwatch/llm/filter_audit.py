"""Filter interaction audit: what each filter removes in every order, from the potential of the removal game.

**Game.** A coalition is a set of filters; its worth is the number of documents that at least one of them fails. The
order in which a coalition's filters run does not change what they remove together, so all 120 orders are known
from the 32 worths: the filter that follows a coalition removes the difference of two worths.

**Potential.** ``P(none) = 0`` and ``P(S) = (worth(S) + sum of P(S without i) for i in S) / |S|``, recursively from small
coalitions to large ones. A filter's Shapley value is ``P(all) - P(all without it)``; times 120 it is the sum
of what the filter removes over all orders. 120 P is a whole number, as P is a sum of whole dividends over sizes up
to five, so everything is counted exactly in integers.

**Scale.** A document becomes five failure bits in one pass over its text. The text of smallest doc_id is the one that
passes the copy filter; of texts that occur more than once (by SHA-256) only that id is joined back, salted where a text has many copies. Counts by
part and bits are added up per task before they are shuffled: at most 32 x 4 rows per part. No document
is looked at again after that.

Defined cases: a null text is empty; a null doc_id is neither smaller than another nor has smaller ones, so such a row never
fails as a copy and makes no other fail; repeated rows with one id are not smaller than each other; a null source is
the part named by the empty string; a document without label counts as neither good nor toxic, one with several label rows has a label if one of them does; an empty
table has no parts and gives no rows; extra columns are not looked at."""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import stash
from emberwatch.operators.skew import join_lookup

FILTERS = "ABCDE"
LEAST_WORDS = 200
_N = len(FILTERS)
_ALL = (1 << _N) - 1
_ORDERS = ["".join(o) for o in permutations(FILTERS)]
_SPACE = r"[\x20\x09-\x0D]+"
_RESULT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def text_failures() -> Column:
    """Bits 0 to 3: the filters A to D that a text (``text``, not null, with its ``words``) fails."""
    n = F.size("words")
    capitals = F.length("text") - F.length(F.translate("text", string.ascii_uppercase, ""))
    tests = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct("words")) < 50 * n,
        100 * capitals > 2 * F.length("text"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    return sum((F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)), F.lit(0))


def worths(counts: np.ndarray) -> np.ndarray:
    """By coalition, how many documents fail at least one of its filters; ``counts`` is by failure bits."""
    masks = np.arange(1 << _N)
    return np.array([counts[(masks & s) != 0].sum() for s in masks], dtype=np.int64)


def potentials(worth: np.ndarray) -> list[int]:
    """120 times the potential of every coalition."""
    out = [0] * (1 << _N)
    for s in range(1, 1 << _N):
        inside = [i for i in range(_N) if s >> i & 1]
        out[s] = (120 * int(worth[s]) + sum(out[s ^ 1 << i] for i in inside)) // len(inside)
    return out


def audit_part(all_: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple]:
    """``(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` of one part, whose
    documents are counted by failure bits."""
    worth, lost_good, lost_toxic = worths(all_), worths(good), worths(toxic)
    potential, total = potentials(worth), int(all_.sum())
    for order in _ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            after = before | own
            removed = int(worth[after] - worth[before])
            yield (
                order, step, total - int(worth[after]), removed, int(worth[own]) - removed,
                int(worth[_ALL] - worth[_ALL ^ own]), int(lost_good[after] - lost_good[before]),
                int(lost_toxic[after] - lost_toxic[before]), potential[_ALL] - potential[_ALL ^ own],
            )
            before = after


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
        *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")),
    ])
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.zeros((3, 1 << _N), dtype=np.int64)
            for c in row["counts"]:
                counts[:, c["fails"]] += (c["n"], c["good"], c["toxic"])
            columns = list(zip(*((row["part"], *x) for x in audit_part(*counts))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def failures(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, fails)`` of every row of ``docs`` (doc_id, text, source)."""
    texts = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("words", F.filter(F.split("text", _SPACE), lambda w: w != ""))
    rows = stash(
        texts.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), text_failures().alias("fails")), "audit-rows"
    )
    first = stash(
        rows.groupBy("same").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first_id IS NOT NULL").drop("n"),
        "audit-copies",
    )
    copy = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    return join_lookup(rows, first, "same", "left").select(
        "doc_id", "part", (F.col("fails") + F.when(copy, F.lit(16)).otherwise(F.lit(0))).alias("fails")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see the module text."""
    marks = stash(
        labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.max(F.when(F.col("quality") == 1, F.lit(1)).otherwise(F.lit(0))).alias("good"),
            F.max(F.when(F.col("toxic") == 1, F.lit(1)).otherwise(F.lit(0))).alias("toxic"),
        ),
        "audit-labels",
    )
    counts = (
        join_lookup(failures(docs), marks, "doc_id", "left")
        .groupBy("part", "fails")
        .agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")))
    )
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("counts"))
    return parts.mapInArrow(_audited, _RESULT)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)
