"""Top-K similarity at many times: a query is a text with the times at which it is asked.

A query is scored once for all its times, and equal vectors are scored once for all their rows. What a group of equal
vectors shows changes only when one of its rows comes or goes, so its first K rows are worked out per span of time.
Results are those of ``knn`` for every pair of query and time: similarity to 6 decimals, descending, then id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.cluster_io import cut
from emberwatch.operators.knn import _CELLS, _FOREVER, _SHORT, _grid, _prepare_vectors, unit_rows
from emberwatch.settings import DEFAULTS, Settings

_SCORES = 4 * _CELLS  # in single precision
_FEW = 8  # groups of equal vectors looked at first
FOUND = "at bigint, ids array<bigint>, similarities array<double>"


class TimedVectors:
    """Vectors with their spans, ready to be searched for the first ``k`` at any time."""

    def __init__(self, pdf: pd.DataFrame, k: int):
        pdf = pdf.sort_values("id", kind="stable")
        self.k, self.n, self.ids = k, len(pdf), pdf["id"].to_numpy()
        embeddings = pdf["embedding"].to_numpy()
        group, _ = pd.factorize(np.array([np.asarray(v).tobytes() for v in embeddings], dtype=object))
        self.own = np.vstack(embeddings[np.unique(group, return_index=True)[1]])
        start, end = pdf["valid_from"].to_numpy(), pdf["valid_to"].to_numpy()
        self.times = np.unique(np.concatenate([start, end]))
        # seen at a time of rank t when first <= t < last
        first, last = np.searchsorted(self.times, start, "right"), np.searchsorted(self.times, end, "right")
        keys, rows = [], []
        members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
        for g, at in enumerate(members):
            for t, seen in _spans(at.tolist(), first, last, k):
                keys.append(g * (len(self.times) + 1) + t)
                rows.append(seen)
        self.keys, self.rows = np.array(keys), np.array(rows, dtype=np.int64)
        # before its first row comes and after its last one goes a group shows nothing; in between it may have gaps
        lasting = first < last
        self.comes, self.goes = np.full(len(self.own), len(self.times) + 1), np.zeros(len(self.own), dtype=np.int64)
        np.minimum.at(self.comes, group[lasting], first[lasting])
        np.maximum.at(self.goes, group[lasting], last[lasting])

    @classmethod
    def of(cls, fields: dict) -> TimedVectors:
        """From what ``vars`` gives: plain arrays, which travel to tasks without this module."""
        made = cls.__new__(cls)
        vars(made).update(fields)
        return made

    @cached_property
    def unit(self) -> np.ndarray:
        return unit_rows(pd.Series(list(self.own)))

    @cached_property
    def single(self) -> np.ndarray:
        return self.unit.astype(np.float32)

    def _shown(self, groups: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The first ``k`` rows that the groups show at the times of these ranks, -1 for none."""
        return self.rows[np.searchsorted(self.keys, groups * (len(self.times) + 1) + rank, "right") - 1]

    def _best(self, millionths: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For lists of groups, the best ``k`` of all their rows, as one integer that orders by similarity, then by id."""
        order = np.where(rows >= 0, millionths[:, :, None] * self.n - rows, -_FOREVER).reshape(len(rows), -1)
        if order.shape[1] < self.k:
            order = np.pad(order, ((0, 0), (0, self.k - order.shape[1])), constant_values=-_FOREVER)
        top = np.partition(order, order.shape[1] - self.k, axis=1)[:, -self.k :]
        return np.sort(top, axis=1)[:, ::-1]

    def _exact(self, vectors: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Similarities in millionths of every vector with its own list of groups, in double precision."""
        out = np.empty(groups.shape, dtype=np.int64)
        step = max(1, _CELLS // max(1, groups.shape[1] * vectors.shape[1]))
        for lo in range(0, len(groups), step):
            dots = np.matmul(self.unit[groups[lo : lo + step]], vectors[lo : lo + step, :, None])
            out[lo : lo + step] = np.rint(dots[:, :, 0] * 1e6)
        return out

    def _above(self, scores: np.ndarray) -> np.ndarray:
        """No group with a score up to this one, in single precision, orders above the integer returned."""
        error = (self.own.shape[1] + 4) * 2.0**-24
        return (np.ceil((scores + error) * 1e6).astype(np.int64) + 1) * self.n

    def search(self, vectors: np.ndarray, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``(pairs, k)`` integers for pairs of a vector (its row in ``vectors``) and a time; ``code`` ascends. Groups are
        chosen by scores in single precision; what could still be among the best within its error is looked at too."""
        rank, out = np.searchsorted(self.times, at, "right"), np.full((len(at), self.k), -_FOREVER)
        step = max(1, _SCORES // len(self.own))
        for lo in range(0, len(vectors), step):
            some = vectors[lo : lo + step]
            scores = some.astype(np.float32) @ self.single.T
            pairs = np.arange(*np.searchsorted(code, [lo, lo + step]))
            often = np.bincount(code[pairs] - lo, minlength=len(some))[code[pairs] - lo] > _FEW
            left = self._near(some, scores, code - lo, rank, pairs[often], out)
            left = self._open(some, scores, code - lo, rank, np.concatenate([pairs[~often], left]), out)
            self._rest(some, code - lo, rank, left, out)
        return out

    def _near(
        self, vectors: np.ndarray, scores: np.ndarray, code: np.ndarray, rank: np.ndarray, todo: np.ndarray, out: np.ndarray
    ) -> np.ndarray:
        """Vectors asked about at many times: their nearest groups are chosen once. Returns the pairs that see too few."""
        if not len(todo):
            return todo
        groups, short = len(self.own), min(len(self.own), _SHORT)
        asked = np.unique(code[todo])
        near = np.argpartition(scores[asked], groups - short, axis=1)[:, groups - short :]
        score = np.take_along_axis(scores[asked], near, axis=1)
        order = np.argsort(-score, axis=1)
        near, score = np.take_along_axis(near, order, axis=1), np.take_along_axis(score, order, axis=1)
        millionths = self._exact(vectors[asked], near)
        for width in sorted({min(_FEW, short), short}):
            bound, left, wide = self._above(score[:, width - 1]), [], max(1, _CELLS // (width * self.k))
            for p in range(0, len(todo), wide):
                pairs = todo[p : p + wide]
                query = np.searchsorted(asked, code[pairs])
                shown = self._shown(near[query, :width], rank[pairs][:, None])
                best = self._best(millionths[query, :width], shown)
                sure = (best[:, -1] > bound[query]) | (width == groups)
                out[pairs[sure]] = best[sure]
                left.append(pairs[~sure])
            todo = np.concatenate(left) if left else todo
        return todo

    def _open(
        self, vectors: np.ndarray, scores: np.ndarray, code: np.ndarray, rank: np.ndarray, todo: np.ndarray, out: np.ndarray
    ) -> np.ndarray:
        """The nearest of the groups that have come and not gone at the time of a pair. Returns the pairs that see too few."""
        left, step = [], max(1, _SCORES // len(self.own))
        top = min(_FEW + self.k, len(self.own))
        for p in range(0, len(todo), step):
            pairs = todo[p : p + step]
            now = rank[pairs][:, None]
            score = scores[code[pairs]]
            # set back, not made equal: many equal numbers are slow to choose from
            np.subtract(score, np.float32(8), out=score, where=(now < self.comes) | (self.goes <= now))
            groups = np.argpartition(score, len(self.own) - top, axis=1)[:, len(self.own) - top :]
            best = self._best(self._exact(vectors[code[pairs]], groups), self._shown(groups, now))
            least = np.take_along_axis(score, groups, axis=1).min(axis=1)
            sure = (best[:, -1] > self._above(least)) | (least < -4) | (top == len(self.own))
            out[pairs[sure]] = best[sure]
            left.append(pairs[~sure])
        return np.concatenate(left) if left else todo

    def _rest(self, vectors: np.ndarray, code: np.ndarray, rank: np.ndarray, todo: np.ndarray, out: np.ndarray) -> None:
        """Pairs whose nearest groups have gaps at their time, or more groups are as near than makes a difference."""
        todo = todo[np.argsort(rank[todo], kind="stable")]
        every = np.arange(len(self.own))
        for same in np.split(todo, np.flatnonzero(np.diff(rank[todo])) + 1):
            if not len(same):
                continue
            shown = self._shown(every, rank[same[0]])
            open_now = np.flatnonzero(shown[:, 0] >= 0)
            shown, top = shown[open_now], min(self.k, len(open_now))
            if not top:
                continue
            unit, step = self.unit[open_now], max(1, _CELLS // len(open_now))
            for p in range(0, len(same), step):
                pairs = same[p : p + step]
                millionths = np.rint(vectors[code[pairs]] @ unit.T * 1e6).astype(np.int64)
                # the best k rows are in the k groups whose first rows are best
                order = millionths * self.n - shown[:, 0]
                groups = np.argpartition(order, len(open_now) - top, axis=1)[:, len(open_now) - top :]
                out[pairs] = self._best(np.take_along_axis(millionths, groups, axis=1), shown[groups])

    def found(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the integers of ``search``."""
        millionths = -(-order // self.n)
        return self.ids[millionths * self.n - order], millionths / 1e6


def _spans(rows: list[int], first: np.ndarray, last: np.ndarray, k: int) -> Iterator[tuple[int, list[int]]]:
    """``(rank of time, first k rows seen from then on)`` of one group; rows come in the order of their ids."""
    comes = sorted((int(first[r]), r) for r in rows if first[r] < last[r])
    yield 0, [-1] * k
    heap: list[int] = []
    i = 0
    for t in sorted({t for t, _ in comes} | {int(last[r]) for _, r in comes}):
        while i < len(comes) and comes[i][0] == t:
            heappush(heap, comes[i][1])
            i += 1
        seen: list[int] = []
        while heap and len(seen) < k:
            r = heappop(heap)
            if last[r] > t:
                seen.append(r)
        yield t, seen + [-1] * (k - len(seen))
        for r in seen:
            heappush(heap, r)


def _pairs(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different vectors of a batch, and per pair of row and time: row, vector and time, in the order of the vectors."""
    batch = batch.assign(_row=np.arange(len(batch)))
    batch = batch[[v is not None and bool(np.any(v)) for v in batch["embedding"]]]  # no direction: no match
    code, _ = pd.factorize(np.array([np.asarray(v).tobytes() for v in batch["embedding"]], dtype=object))
    firsts = np.unique(code, return_index=True)[1]
    vectors = unit_rows(batch["embedding"].iloc[firsts]) if len(batch) else np.zeros((0, 1))
    counts = np.array([len(a) for a in batch["at"]], dtype=np.int64)
    at = np.concatenate([np.zeros(0, dtype=np.int64), *batch["at"]]).astype(np.int64)
    code, row = np.repeat(code, counts), np.repeat(batch["_row"].to_numpy(), counts)
    order = np.argsort(code, kind="stable")
    return vectors, row[order], code[order], at[order]


def knn_asof(
    queries: DataFrame, vectors: DataFrame, k: int, namespace: str | None = None, conf: Settings = DEFAULTS
) -> DataFrame:
    """``(query_id, at, ids, similarities)``: the exact top-K of every query ``(query_id, embedding, at array<bigint>)`` at
    each of its times (all different, in microseconds) among the ``vectors`` with ``valid_from <= at < valid_to``. A pair that finds nothing
    has no row. The vectors are evaluated once; they travel to the tasks when those that differ have at most
    ``conf.broadcast_bytes`` and all have at most ``conf.broadcast_rows`` rows."""
    prepared = cut(_prepare_vectors(vectors, namespace))
    groups = prepared.groupBy("embedding").agg(F.count(F.lit(1)).alias("n"))
    size = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.size("embedding") * 4), F.lit(0)).alias("bytes")
    ).first()
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {FOUND}"
    if not size["rows"]:
        return queries.sparkSession.createDataFrame([], schema)
    if size["rows"] > conf.broadcast_rows or size["bytes"] > conf.broadcast_bytes:
        return _blocked(queries, prepared, k, conf, schema)
    rows = F.collect_list(F.struct("id", "valid_from", "valid_to"))
    local = prepared.groupBy("embedding").agg(rows.alias("rows")).toArrow().to_pandas()  # few rows and bytes, as measured
    local = local.explode("rows", ignore_index=True)
    spans = pd.DataFrame(local["rows"].tolist(), index=local.index)
    fields = vars(TimedVectors(spans.assign(embedding=local["embedding"]), k))
    shared = queries.sparkSession.sparkContext.broadcast(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = TimedVectors.of(shared.value)
        for batch in batches:
            vectors, row, code, at = _pairs(pa.Table.from_batches([batch]).select(["embedding", "at"]).to_pandas())
            best = stored.search(vectors, code, at)
            known = best > -_FOREVER
            hit = known[:, 0]
            ids, similarities = stored.found(best[known])
            ends = pa.array(np.concatenate([[0], np.cumsum(known[hit].sum(axis=1))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("query_id").take(pa.array(row[hit])), pa.array(at[hit]),
                    pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(similarities)),
                ],
                ["query_id", "at", "ids", "similarities"],
            )

    return queries.select("query_id", "embedding", "at").mapInArrow(run, schema)


def _blocked(queries: DataFrame, prepared: DataFrame, k: int, conf: Settings, schema: str) -> DataFrame:
    """The same for any number of vectors: blocks of queries meet blocks of vectors, the best of each are merged."""
    zero = F.lit(0).cast("bigint")
    q = cut(queries.select("query_id", "embedding", "at")).withColumn("bucket", zero)
    names = ["query_id", "at", "id", "similarity"]

    def score(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(vs):
            return pd.DataFrame({n: [] for n in names})
        stored = TimedVectors(vs, k)
        vectors, row, code, at = _pairs(qs)
        best = stored.search(vectors, code, at)
        pair, place = np.nonzero(best > -_FOREVER)
        ids, similarities = stored.found(best[pair, place])
        return pd.DataFrame(dict(zip(names, (qs["query_id"].to_numpy()[row[pair]], at[pair], ids, similarities))))

    hits = _grid(q, prepared.withColumn("bucket", zero), k, conf, score, f"{schema.split(',')[0]}, at bigint, id bigint, similarity double")
    w = Window.partitionBy("query_id", "at").orderBy(F.desc("similarity"), F.asc("id"))
    best = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    found = F.sort_array(F.collect_list(F.struct("rank", "id", "similarity")))
    lists = best.groupBy("query_id", "at").agg(found.alias("found"))
    return lists.select("query_id", "at", F.col("found.id").alias("ids"), F.col("found.similarity").alias("similarities"))
