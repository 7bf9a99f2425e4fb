"""Blocked similarity of texts, and connected components of the similarity graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.cluster_io import cut
from emberwatch.operators.knn import unit_rows
from emberwatch.operators.skew import join_lookup
from emberwatch.settings import DEFAULTS, Settings

_STRIP = 256  # rows scored at once inside one block
_CELLS = 1 << 20  # similarities held at once where pairs are wanted
FINISH_EDGES = 100_000  # a contracted graph of at most so many edges is finished by one task


def block_pairs(members: DataFrame, group: list[str], conf: Settings = DEFAULTS) -> DataFrame:
    """Replicate the members of each group so that any two of them meet in one task.

    A group larger than ``block_rows`` is cut into b blocks and becomes b*(b+1)/2 tasks of at most
    two blocks each. Adds ``lo`` and ``hi``, the two blocks of the task, and ``own``, the one the member is in."""
    sizes = members.groupBy(*group).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(conf.block_rows)).alias("_blocks")
    )
    own = F.pmod(F.xxhash64("node"), F.col("_blocks"))
    return (
        join_lookup(members, sizes, group, "inner", conf)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
        .withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other")})
        .withColumnRenamed("_own", "own").drop("_blocks", "_other")
    )


def similar_pairs_in(unit: np.ndarray, rows: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of similar rows with their similarity in millionths, one of them in ``rows`` (ascending), each pair
    once, at most ``_CELLS`` at a time."""
    wanted = np.zeros(len(unit), dtype=bool)
    wanted[rows] = True
    step = max(1, _CELLS // max(len(unit), 1))
    for start in range(0, len(rows), step):
        some = rows[start : start + step]
        part = unit[some] @ unit.T
        part *= 1e6
        i, j = np.nonzero(part >= limit - 1)
        score = np.rint(part[i, j]).astype(np.int64)
        i = some[i]
        # two of ``rows`` meet twice
        keep = (score >= limit) & (~wanted[j] | (i < j))
        yield i[keep], j[keep], score[keep]


def component_labels(unit: np.ndarray, limit: int) -> np.ndarray:
    """Component of every row: the index of its first row. Rows are scored strip by strip, each pair once."""
    root = np.arange(len(unit))
    for start in range(0, len(unit), _STRIP):
        part = unit[start : start + _STRIP] @ unit[start:].T
        part *= 1e6
        i, j = np.nonzero(part >= limit - 1)
        near = np.rint(part[i, j]) >= limit
        a, b = root[i[near] + start], root[j[near] + start]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            # hook on the smallest neighbour, then jump until flat
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
    return root


def star_edges(members: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """``(node, hub)``: per task one edge from each row to the smallest node of its component, so
    a dense family of n texts sends n edges instead of n*n/2."""
    limit = round(threshold * 1e6)

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        hub = component_labels(unit_rows(pdf["embedding"]), limit)
        nodes = pdf["node"].to_numpy()
        return pd.DataFrame({"node": nodes, "hub": nodes[hub]})

    slim = members.select(*group, "lo", "hi", "node", "embedding")
    return slim.groupBy(*group, "lo", "hi").applyInPandas(stars, "node bigint, hub bigint")


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Every node of the edges ``a, b`` with the smallest node of its component."""
    names, at = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
    a, b = at[: len(pdf)], at[len(pdf):]
    root = np.arange(len(names))
    while len(a):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, hi, lo)  # hook on the smallest neighbour, then jump until flat
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return pd.DataFrame({"node": names, "root": names[root]})


def _one_task(live: DataFrame) -> DataFrame:
    """Finish a graph of bounded size (``finish_edges``) in one task."""

    def finish(parts):
        parts = [p for p in parts if len(p)]
        if parts:
            yield _forest(pd.concat(parts, ignore_index=True))

    return live.coalesce(1).mapInPandas(finish, "node bigint, root bigint")


def _known_size(nodes: int, conf: Settings) -> tuple[int, int] | None:
    """Rows and bytes of a table of pairs of numbers, where that may be broadcast."""
    fits = nodes <= conf.broadcast_rows and 32 * nodes <= conf.broadcast_bytes
    return (nodes, 32 * nodes) if fits else None


def _hooked(live: DataFrame, salt: int, size: tuple[int, int] | None, conf: Settings) -> DataFrame:
    """``(node, root)``: every node hooks on the neighbour that comes first in an order by hash, if that is
    before itself; then all jump to the root of their tree."""
    def rank(c: str) -> Column:
        return F.struct(F.xxhash64(F.lit(salt), F.col(c)).alias("h"), F.col(c).alias("node"))

    both = live.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), rank("b").alias("near")),
        F.struct(F.col("b").alias("node"), rank("a").alias("near")),
    )).alias("e")).select("e.node", "e.near")
    near = both.groupBy("node").agg(F.min("near").alias("near"))
    flat = cut(near.select("node", F.least("near", rank("node"))["node"].alias("root")))
    while True:
        above = flat.select(F.col("node").alias("root"), F.col("root").alias("_above"))
        flat = cut(join_lookup(flat, above, "root", "inner", conf, size).select(
            "node", F.col("_above").alias("root"), (F.col("root") != F.col("_above")).alias("_moved")
        ))
        moved = not flat.where("_moved").isEmpty()
        flat = flat.drop("_moved")
        if not moved:
            return flat


def _contracted(live: DataFrame, roots: DataFrame, size: tuple[int, int] | None, conf: Settings) -> DataFrame:
    """The edges between different roots, each once."""
    for end in ("a", "b"):
        named = roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
        live = join_lookup(live, named, end, "inner", conf, size)
    return (
        live.where("_a <> _b")
        .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
    )


def connected_components(
    edges: DataFrame, conf: Settings = DEFAULTS, finish_edges: int = FINISH_EDGES
) -> DataFrame:
    """``(node, component)`` with the smallest node of each component as its name.

    Rounds of contraction: every node hooks on its first neighbour in an order by hash that is drawn anew
    each round, trees are flattened by pointer jumping, and only edges between different roots are kept.
    A node is first among its neighbours with a chance of 1 / (neighbours + 1), so at least half of the
    nodes are expected to go each round, whatever the shape of the graph: a chain loses two thirds, and
    its trees are as deep as the logarithm of its length. What is left is finished by one task once it has at most
    ``finish_edges`` edges. The rounds' tables shrink like the graph; they are put together from the
    smallest one up. Hubs are salted by :func:`join_lookup`; lineage is cut each round."""
    ends = edges.select(F.explode(F.array("node", "hub")).alias("node")).distinct()
    live = cut(
        edges.where("node <> hub")
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    )
    levels = []
    while left := live.count():
        if left <= finish_edges:
            levels.append(cut(_one_task(live)))
            break
        size = _known_size(2 * left, conf)
        levels.append(_hooked(live, len(levels), size, conf))
        live = cut(_contracted(live, levels[-1], size, conf))
    if not levels:
        return ends.withColumn("component", F.col("node"))
    roots = levels.pop()
    while levels:
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("_top"))
        roots = cut(join_lookup(levels.pop(), up, "root", "left", conf).select(
            "node", F.coalesce("_top", "root").alias("root")
        ))
    names = roots.groupBy("root").agg(F.min("node").alias("component"))
    named = join_lookup(roots, names, "root", "inner", conf).select("node", "component")
    return ends.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
