"""SimHash near-duplicates: vantage-point trees over the distinct fingerprints.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Equal fingerprints
are one point, so copies cost nothing further. The distinct points are dealt to the leaves of a shallow
vantage-point tree: a point lives in the leaf that its Hamming distances to the vantage points lead to,
and it visits every other leaf that the triangle inequality cannot rule out, that is on whose side of a
border it could have a partner. Of two points that are parted at a border only the nearer one visits.
Inside a leaf the same recursion goes on; below ``LEAF`` points it compares block by block. All pairs
within ``radius`` are met, none is guessed. A leaf hands on one edge per point it links (a spanning
forest of its links), and the edges of all leaves become components.

The top tree is laid out from a bounded sample of the points (those with the smallest hashes); it only
decides where points are compared, never whether. Only distinct points and edges are shuffled.

Defined cases: a null or empty text has no words and fingerprint 0; such rows link like any others;
fewer words than a shingle are one shingle; a component is named by its smallest non-null doc_id (null if
it has none); an empty table gives an empty result; repeated rows are one point and stay repeated; extra columns, whatever their
names, are carried by :func:`deduplicate` and not looked at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.llm.common import stash, unused
from emberwatch.operators.components import connected_components
from emberwatch.operators.skew import join_lookup

SHINGLE = 4
RADIUS = 4
SEED = 42
LEAF = 512  # points compared block by block
TASK_POINTS = 32_768  # points living in one leaf of the top tree, about; fewer leaves, fewer visits
SAMPLE = 16_384  # points that the top tree is laid out from


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned 64-bit number."""
    found = text.encode("utf-8").lower().split() if text else []
    if not found:
        return 0
    joined, shingles = b" ".join(found), max(1, len(found) - words + 1)
    end = np.cumsum([len(w) + 1 for w in found]) - 1
    start = np.concatenate([[0], end[:-1] + 1])[:shingles].tolist()
    stop = end[min(words, len(found)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, shingles, 65_536):  # a very long text in pieces
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(start[lo:lo + 65_536], stop[lo:lo + 65_536])], dtype="<u8"
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > shingles, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(text: pa.Array) -> pa.Array:
    bits = np.fromiter((fingerprint(t) for t in text.to_pylist()), dtype=np.uint64, count=len(text))
    return pa.array(bits.view(np.int64))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _border(to_vantage: np.ndarray) -> int:
    """The distance that halves the points best; points at it or nearer lie inside."""
    return int(np.partition(to_vantage, (len(to_vantage) - 1) // 2)[(len(to_vantage) - 1) // 2])


def _vantage(points: np.ndarray, depth: int) -> np.uint64:
    """A vantage point far from the last one: the point whose mixed bits come first at this depth."""
    mixed = (points ^ np.uint64(0x9E3779B97F4A7C15 * (depth + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return points[np.argmin(mixed ^ mixed >> np.uint64(31))]


def top_tree(sample: np.ndarray, leaves: int, depth: int = 0) -> tuple | None:
    """``(vantage, border, inside, outside)``, or None for a leaf."""
    if leaves < 2 or len(sample) < 2:
        return None
    vantage = _vantage(sample, depth)
    away = distances(sample, vantage)
    border = _border(away)
    inside = away <= border
    if inside.all():
        return None
    return (
        vantage, border, top_tree(sample[inside], leaves // 2, depth + 1),
        top_tree(sample[~inside], leaves - leaves // 2, depth + 1),
    )


def route(node: tuple | None, points: np.ndarray, at: np.ndarray, home: np.ndarray, radius: int, path: int = 1) -> Iterator:
    """``(leaf, places, home?)``: the leaves that each point lives in or has to visit."""
    if not len(at):
        return
    if node is None:
        yield path, at, home
        return
    vantage, border, inner, outer = node
    away = distances(points[at], vantage).astype(np.int64)
    inside = away <= border
    # a point that lives inside looks for outer partners; visitors look on either side
    into = inside | (~home & (away - radius <= border))
    out = ~inside | (away + radius > border)
    yield from route(inner, points, at[into], home[into] & inside[into], radius, 2 * path)
    yield from route(outer, points, at[out], home[out] & ~inside[out], radius, 2 * path + 1)


class Forest:
    """Union-find over the places of a leaf."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def flat(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return up
            self.root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        flat = self.flat()
        lo, hi = np.minimum(flat[a], flat[b]), np.maximum(flat[a], flat[b])
        pairs = np.unique(lo[lo != hi] * len(flat) + hi[lo != hi])
        for lo, hi in zip(*(x.tolist() for x in np.divmod(pairs, len(flat)))):
            while self.root[lo] != lo:
                lo = self.root[lo]
            while self.root[hi] != hi:
                hi = self.root[hi]
            self.root[max(lo, hi)] = min(lo, hi)


def link(points: np.ndarray, living: np.ndarray, asking: np.ndarray, forest: Forest, radius: int, depth: int = 0) -> None:
    """Join in ``forest`` every pair of a living and an asking place within ``radius``."""
    if not len(living) or not len(asking):
        return
    if len(living) > LEAF and len(asking) > LEAF // 8:
        vantage = _vantage(points[living], depth)
        near, far = (distances(points[x], vantage).astype(np.int64) for x in (living, asking))
        border = _border(near)
        if (near > border).any():
            link(points, living[near <= border], asking[far - radius <= border], forest, radius, depth + 1)
            link(points, living[near > border], asking[far + radius > border], forest, radius, depth + 1)
            return
    for lo in range(0, len(living), 4096):
        part = living[lo:lo + 4096]
        for at in range(0, len(asking), 256):
            own = asking[at:at + 256]
            i, j = np.nonzero(distances(points[own][:, None], points[part][None, :]) <= radius)
            other = own[i] != part[j]
            if other.any():
                forest.join(own[i][other], part[j][other])


def leaf_edges(points: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """One edge from each linked place to the first of its links' component in this leaf."""
    forest = Forest(len(points))
    link(points, np.flatnonzero(home), np.arange(len(points)), forest, radius)
    root = forest.flat()
    at = np.flatnonzero(root != np.arange(len(points)))
    return at, root[at]


def fingerprint_edges(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(node, hub)`` between distinct fingerprints whose components are those of all close pairs."""
    spark = points.sparkSession
    total = points.count()
    sample = points.orderBy(F.xxhash64("bits"), "bits").limit(SAMPLE).toArrow()["bits"].to_numpy().view(np.uint64)
    tree = spark.sparkContext.broadcast(top_tree(sample, -(-total // TASK_POINTS)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy().view(np.uint64)
            every = np.arange(len(bits))
            for leaf, at, home in route(tree.value, bits, every, np.ones(len(bits), dtype=bool), radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), leaf)), pa.array(bits[at].view(np.int64)), pa.array(home)],
                    ["leaf", "bits", "home"],
                )

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bits", ignore_index=True)
        bits = pdf["bits"].to_numpy()
        a, b = leaf_edges(bits.view(np.uint64), pdf["home"].to_numpy(dtype=bool), radius)
        return pd.DataFrame({"node": bits[a], "hub": bits[b]})

    return (
        points.select("bits").mapInArrow(dealt, "leaf bigint, bits bigint, home boolean")
        .groupBy("leaf").applyInPandas(linked, "node bigint, hub bigint")
    )


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (doc_id, bits) with ``component_id``: the smallest doc_id reachable by links."""
    points = stash(prints.groupBy("bits").agg(F.min("doc_id").alias("doc_id")), "simhash-points")
    edges = stash(fingerprint_edges(points, radius), "simhash-edges")
    classes = stash(connected_components(edges), "simhash-classes")
    linked = points.join(classes.withColumnRenamed("node", "bits"), "bits")
    names = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stash(linked.select("bits", "component").join(names, "component").select("bits", "component_id"), "simhash-named")
    own = points.join(named, "bits", "left").select("bits", F.coalesce("component_id", "doc_id").alias("component_id"))
    return join_lookup(prints, own, "bits", "left")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, bits)`` of every row."""
    return docs.select("doc_id", _fingerprints("text").alias("bits"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint in hexadecimal and its component."""
    prints = stash(fingerprints(docs), "simhash-prints")
    return components(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component: the one with the smallest doc_id, then the smallest row number.

    The columns are those of ``docs``. Rows are numbered once, so that repeated rows are told apart."""
    row = unused(docs, "_row")
    rows = stash(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    prints = stash(rows.select(F.col(row).alias("doc_id"), _fingerprints("text").alias("bits"), F.col("doc_id").alias("own")), "simhash-prints")
    classes = components(prints.select("doc_id", "bits"), radius)
    rank = F.struct(F.col("own").isNull(), F.col("own"), F.col("doc_id"))
    first = (
        classes.join(prints.select("doc_id", "own"), "doc_id")
        .groupBy("component_id").agg(F.min(rank).alias("r"))
        .select(F.col("r.doc_id").alias(row))
    )
    # row numbers are unique, so no key is hot: the same shuffled join at every size
    kept = rows.join(first.hint("merge"), row, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
