"""Near-duplicate embeddings with hierarchical navigable small-world graphs.

Vectors are compared within their label. Exact copies become one point with a count. The points of a
label are dealt to shards of about ``SHARD`` points. Within a shard a point that is at or above the threshold with
an earlier leader belongs to that leader's group, else it is a leader; the graph has the leaders alone, so a large group
of near copies is one node. A task builds and writes its shard. Every block of points then queries every shard of its label: a beam search
finds the leaders near a query. By the triangle inequality of angles only leaders within the threshold's angle plus
the width of their group can have linked members; the members of those are compared in double precision, and what is
at or above the threshold is a link. Beams widen in two ways. A beam that holds nothing but such leaders may have missed some, so that query
is repeated with a wider one, up to a beam of the whole shard. And beams are audited: ``AUDIT`` queries, before the first search and again
among the queries that end with each beam, have to find ``EVIDENCE`` leaders each, half of them the nearest to the query, half dealt evenly
over the shard. A query that is too far from such a leader to have a link in its group is moved on the arc to it, just as far as
where a link is possible: the farthest place from which the leader has to be found. So there is evidence whether queries have links or
not, and it is about links: random vectors far from each other ask for no wider beam the more of them there are. While the share found
is below ``RECALL`` in either half, the beam is doubled. And a leader that a search for itself in its own shard misses is compared with all
queries of that shard. A task hands on the number of links per query and a spanning forest of its links; only those are
shuffled, never pairs. Components are joined across shards by Spark.

Defined cases: vectors that are null, empty, zero, or have null or non-finite components, and vectors with a null
label, link with nothing and are their own component; vectors of different lengths do not link; repeated
rows are other vectors and link; a component is named by its smallest non-null vec_id; an empty table
gives an empty result."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import stash
from emberwatch.llm.simhash import Forest
from emberwatch.operators.components import connected_components
from emberwatch.operators.skew import join_lookup

THRESHOLD = 0.98
SHARD = 16_384
NEIGHBOURS = 16  # links kept per node of a layer; twice as many in the lowest
BUILD_BEAM = 48
BEAM = 48
AUDIT = 128
EVIDENCE = 10  # nearest points that an audited query has to find, however far they are
RECALL = 0.999
_BATCH = 256
_SLACK = 1e-4  # of single precision, while searching
_EXPAND = 4  # nodes opened at once per query, more in wide beams


@dataclass
class Layer:
    nodes: np.ndarray  # places of the layer's nodes in the shard
    links: np.ndarray  # (nodes, width) positions in ``nodes``, -1 where there is none


class Graph:
    """A hierarchical small-world graph over unit vectors."""

    def __init__(self, unit: np.ndarray, layers: list[Layer] | None = None):
        self.unit = np.ascontiguousarray(unit, dtype=np.float32)
        self.layers: list[Layer] = layers or []
        if layers is None:
            self._build()

    def _build(self) -> None:
        n = len(self.unit)
        mixed = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
        level = np.floor(-np.log((mixed + np.uint64(1)).astype(float) / 2**53) / np.log(NEIGHBOURS)).astype(int)
        order = np.argsort(-level, kind="stable")  # nodes of upper layers come first in every layer
        for k in range(int(level.max(initial=0)), -1, -1):
            nodes = order[: int((level >= k).sum())]
            if not len(nodes):
                continue
            width = NEIGHBOURS * (2 if k == 0 else 1)
            links = np.full((len(nodes), width), -1, dtype=np.int32)
            layer = Layer(nodes, links)
            done, size = 0, 1
            while done < len(nodes):
                size = min(_BATCH, max(1, done), len(nodes) - done)
                self._insert(layer, done, size)
                done += size
            self.layers.append(layer)

    def _insert(self, layer: Layer, done: int, size: int) -> None:
        """Link the next ``size`` nodes of a layer to the ones before them and to each other."""
        vectors = self.unit[layer.nodes]
        new = np.arange(done, done + size)
        own = vectors[new]
        inner = own @ own.T
        inner[np.arange(size)[:, None] <= np.arange(size)[None, :]] = -np.inf  # earlier ones only
        ids, sims = np.broadcast_to(new, (size, size)), inner
        if done:
            start = self._descend(own, len(self.layers)) if self.layers else np.zeros(size, dtype=np.int64)
            far, far_sims = self._beam(vectors, layer.links, own, start, BUILD_BEAM)
            ids, sims = np.concatenate([far, ids], axis=1), np.concatenate([far_sims, sims], axis=1)
        chosen = self._diverse(vectors, own, ids, sims, NEIGHBOURS)
        layer.links[new, :NEIGHBOURS] = chosen
        source, column = np.nonzero(chosen >= 0)
        target = chosen[source, column].astype(np.int64)
        self._link_back(vectors, layer.links, target, new[source])

    def _link_back(self, vectors: np.ndarray, links: np.ndarray, target: np.ndarray, source: np.ndarray) -> None:
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        width = links.shape[1]
        for lo in range(0, len(nodes), 1024):
            part, at, n = nodes[lo:lo + 1024], first[lo:lo + 1024], count[lo:lo + 1024]
            extra = np.full((len(part), n.max(initial=0)), -1, dtype=np.int64)
            row = np.repeat(np.arange(len(part)), n)
            column = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            extra[row, column] = source[np.repeat(at, n) + column]
            every = np.concatenate([links[part], extra], axis=1)
            sims = np.where(every >= 0, np.einsum("amd,ad->am", vectors[every], vectors[part]), -np.inf)
            fits = (every >= 0).sum(1) <= width
            packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), axis=1)[:, :width]
            links[part[fits]] = packed[fits]
            if not fits.all():
                full = ~fits
                links[part[full]] = self._diverse(vectors, vectors[part[full]], every[full], sims[full], width)

    @staticmethod
    def _diverse(vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Nearest first, those nearer to the node than to any chosen before; then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : max(3 * width, BUILD_BEAM)]
        ids, sims = np.take_along_axis(ids, order, 1).astype(np.int64), np.take_along_axis(sims, order, 1)
        near = vectors[ids]
        between = near @ near.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, dtype=bool)
        for j in range(ids.shape[1]):
            closer = (np.where(taken, between[:, j], -np.inf) > sims[:, j, None]).any(axis=1)
            taken[:, j] = np.isfinite(sims[:, j]) & ~closer & (taken.sum(1) < width)
        rank = np.where(np.isfinite(sims), ~taken * 1.0, 2.0)
        pick = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out = np.where(np.take_along_axis(rank, pick, 1) < 2, np.take_along_axis(ids, pick, 1), -1)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1).astype(np.int32)

    @staticmethod
    def _beam(vectors: np.ndarray, links: np.ndarray, asked: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes met per query, best-first; all queries advance together."""
        q, n = len(asked), len(vectors)
        seen = np.zeros((q, n), dtype=bool)
        ids, sims = np.full((q, beam), -1, dtype=np.int64), np.full((q, beam), -np.inf, dtype=np.float32)
        opened = np.ones((q, beam), dtype=bool)
        every = np.arange(q)
        ids[:, 0], sims[:, 0], opened[:, 0] = start, np.einsum("ad,ad->a", vectors[start], asked), False
        seen[every, start] = True
        expand = min(max(_EXPAND, beam // 16), beam)
        while len(live := np.flatnonzero(~opened.all(axis=1))):
            score = np.where(opened[live], -np.inf, sims[live])
            best = np.argpartition(-score, expand - 1, axis=1)[:, :expand]
            usable = np.isfinite(np.take_along_axis(score, best, 1))
            opened[live[:, None], best] = True
            ahead = np.where(usable[:, :, None], links[np.take_along_axis(ids[live], best, 1)], -1).reshape(len(live), -1)
            ahead = np.sort(ahead, axis=1)
            fresh = ahead >= 0
            fresh[:, 1:] &= ahead[:, 1:] != ahead[:, :-1]
            fresh &= ~seen[live[:, None], ahead]
            row, column = np.nonzero(fresh)
            node = ahead[row, column]
            seen[live[row], node] = True
            found = np.full(ahead.shape, -np.inf, dtype=np.float32)
            found[row, column] = np.einsum("ad,ad->a", vectors[node], asked[live[row]])
            all_sims, all_ids = np.concatenate([sims[live], found], axis=1), np.concatenate([ids[live], ahead], axis=1)
            all_open = np.concatenate([opened[live], ~fresh], axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_sims, keep, 1)
            opened[live] = np.take_along_axis(all_open, keep, 1) | ~np.isfinite(sims[live])
        return ids, sims

    def _descend(self, asked: np.ndarray, layers: int) -> np.ndarray:
        """Where to start in the layer below the first ``layers``: nodes keep their position there."""
        at = np.zeros(len(asked), dtype=np.int64)
        for layer in self.layers[:layers]:
            at = self._beam(self.unit[layer.nodes], layer.links, asked, at, 1)[0][:, 0]
        return at

    def near(self, asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``beam`` best points met per query (-1: none)."""
        low = self.layers[-1]
        vectors = self.unit[low.nodes]
        ids, sims = [], []
        for lo in range(0, len(asked), _BATCH):
            part = asked[lo:lo + _BATCH]
            found, score = self._beam(vectors, low.links, part, self._descend(part, len(self.layers) - 1), beam)
            ids.append(np.where(found >= 0, low.nodes[found], -1))
            sims.append(score)
        return np.concatenate(ids), np.concatenate(sims)


class Shard:
    """Points in groups around leaders, and the graph of the leaders."""

    def __init__(self, exact: np.ndarray, threshold: float = THRESHOLD, saved: bytes | None = None):
        self.exact = exact
        if saved is None:
            self.group = self._groups(exact.astype(np.float32), threshold)
        else:
            with np.load(io.BytesIO(saved)) as x:
                self.group = x["group"]
                layers = [Layer(x[f"n{i}"], x[f"l{i}"]) for i in range((len(x.files) - 1) // 2)]
        self.leaders = np.unique(self.group)
        self.number = np.searchsorted(self.leaders, self.group)  # of each point's leader
        self.members = np.argsort(self.number, kind="stable")
        self.bounds = np.searchsorted(self.number[self.members], np.arange(len(self.leaders) + 1))
        self.centres = exact[self.leaders]
        self.graph = Graph(self.centres) if saved is None else Graph(self.centres, layers)

    @staticmethod
    def _groups(unit: np.ndarray, threshold: float) -> np.ndarray:
        """The place of every point's leader."""
        leader = np.arange(len(unit))
        chosen = np.zeros(0, dtype=np.int64)
        for lo in range(0, len(unit), _BATCH):
            part = np.arange(lo, min(lo + _BATCH, len(unit)))
            if len(chosen):
                cosine = unit[part] @ unit[chosen].T
                best = cosine.argmax(axis=1)
                near = cosine[np.arange(len(part)), best] >= threshold
                leader[part[near]] = chosen[best[near]]
                part = part[~near]
            inner, new = unit[part] @ unit[part].T >= threshold, []
            for k in range(len(part)):
                own = [j for j in new if inner[k, j]]
                if own:
                    leader[part[k]] = part[own[0]]
                else:
                    new.append(k)
            chosen = np.concatenate([chosen, part[new]])
        return leader

    def least(self, threshold: float) -> np.ndarray:
        """By leader, the cosine below which none of its members can be linked with a query."""
        cosine = np.einsum("ad,ad->a", self.exact, self.exact[self.group])
        width = np.zeros(len(self.leaders))
        np.maximum.at(width, self.number, np.arccos(np.clip(cosine, -1, 1)))
        return np.cos(np.minimum(np.pi, np.arccos(np.clip(threshold, -1, 1)) + width))

    def dump(self) -> bytes:
        out = io.BytesIO()
        layers = {f"{kind}{i}": x for i, y in enumerate(self.graph.layers) for kind, x in (("n", y.nodes), ("l", y.links))}
        np.savez(out, group=self.group, **layers)
        return out.getvalue()


def edge_probes(
    centres: np.ndarray, least: np.ndarray, queries: np.ndarray, own: np.ndarray,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(query, leader)`` to audit: each query with half of ``EVIDENCE`` leaders nearest to it, and with as many dealt
    evenly. A query is taken as it is if that leader can have linked members, else moved on the arc to that leader, just
    as far as where it can. ``own`` is a query's own number among the leaders (-1: none), which is not one of the nearest."""
    q, n, k = len(queries), len(centres), EVIDENCE // 2
    if not q:
        return []
    cosine = queries @ centres.T
    others = cosine.copy()
    mine = np.flatnonzero(own >= 0)
    others[mine, own[mine]] = -np.inf
    nearest = np.argpartition(others, -min(k, n), axis=1)[:, -min(k, n):]
    spread = np.linspace(0, n - 1, q * k).astype(np.int64).reshape(k, q).T
    out = []
    for leader in (nearest, spread):
        near, edge, centre = np.take_along_axis(cosine, leader, 1)[:, :, None], least[leader][:, :, None], centres[leader]
        across = queries[:, None] - near * centre
        across /= np.maximum(np.linalg.norm(across, axis=2, keepdims=True), 1e-12)
        moved = edge * centre + np.sqrt(np.maximum(0, 1 - edge * edge)) * across
        out.append((np.where(near >= edge, queries[:, None], moved).reshape(-1, centres.shape[1]), leader.reshape(-1)))
    return out


def recall(graph: Graph, probes: np.ndarray, leader: np.ndarray, beam: int) -> float:
    """The share of ``probes`` whose ``leader`` is in their beam, or whose beam is full of nearer ones."""
    asked = probes.astype(np.float32)
    ids, sims = graph.near(asked, beam)
    cosine = np.einsum("ad,ad->a", asked, graph.unit[leader])
    return float(((ids == leader[:, None]).any(axis=1) | (sims > cosine[:, None]).all(axis=1)).mean())


def _confirmed(shard: Shard, queries: np.ndarray, row: np.ndarray, number: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """``(query, place)`` of the members of candidate leaders whose cosine in double precision is at or above the threshold."""
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    size = shard.bounds[number + 1] - shard.bounds[number]
    rows, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    one = np.flatnonzero(size == 1)
    for lo in range(0, len(one), 65_536):
        at = one[lo:lo + 65_536]
        place = shard.leaders[number[at]]
        kept = np.einsum("ad,ad->a", queries[row[at]], shard.exact[place]) >= threshold
        rows.append(row[at][kept])
        places.append(place[kept])
    several = np.flatnonzero(size > 1)
    for own in np.split(several, np.flatnonzero(np.diff(number[several])) + 1) if len(several) else ():
        members = shard.members[shard.bounds[number[own[0]]]:shard.bounds[number[own[0]] + 1]]
        for lo in range(0, len(own), _BATCH):
            part = row[own[lo:lo + _BATCH]]
            i, j = np.nonzero(queries[part] @ shard.exact[members].T >= threshold)
            rows.append(part[i])
            places.append(members[j])
    return np.concatenate(rows), np.concatenate(places)


def links_of(
    shard: Shard, queries: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM, own: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """``(query, place)`` of all links found, itself included; see the module text for how beams widen. ``own``: the
    queries are the points of the shard."""
    graph, asked, n = shard.graph, queries.astype(np.float32), len(shard.leaders)
    least = (shard.least(threshold) - _SLACK).astype(np.float32)
    lowest, open_, wide, rows, numbers = least.min(initial=1), np.arange(len(queries)), beam, [], []
    lost = [np.zeros(0, dtype=np.int64)]
    mine = np.where(shard.group == np.arange(len(queries)), shard.number, -1) if own else np.full(len(queries), -1)

    def some(of: np.ndarray) -> np.ndarray:
        return of[np.unique(np.linspace(0, len(of) - 1, min(AUDIT, len(of))).astype(int))]

    def passes(audit: np.ndarray) -> bool:
        return all(
            recall(graph, probes, leader, wide) >= RECALL
            for probes, leader in edge_probes(shard.centres, least, queries[audit], mine[audit])
        )

    first = some(open_)
    while 2 * wide < n and not passes(first):
        wide *= 2
    passed = wide
    while len(open_):
        if 2 * wide >= n or wide > 16 * beam:  # a beam of the whole shard
            for lo in range(0, len(open_), _BATCH):
                i, j = np.nonzero(asked[open_[lo:lo + _BATCH]] @ graph.unit.T >= least)
                rows.append(open_[lo + i])
                numbers.append(j)
            break
        ids, sims = graph.near(asked[open_], wide)
        done = ~(sims >= lowest).all(axis=1)
        audit = some(open_[done])
        if not (wide == passed and np.array_equal(audit, first)) and not passes(audit):
            wide *= 2
            continue
        i, j = np.nonzero((sims >= least[ids]) & (ids >= 0) & done[:, None])
        rows.append(open_[i])
        numbers.append(ids[i, j])
        leads = mine[open_]
        lost.append(leads[done & (leads >= 0) & ~(ids == leads[:, None]).any(axis=1)])
        open_, wide = open_[~done], 4 * wide
    missed = np.concatenate(lost)
    for lo in range(0, len(queries) if len(missed) else 0, _BATCH):
        i, j = np.nonzero(asked[lo:lo + _BATCH] @ graph.unit[missed].T >= least[missed])
        rows.append(lo + i)
        numbers.append(missed[j])
    pairs = np.unique(np.concatenate([*lost[:1], *rows]) * n + np.concatenate([*lost[:1], *numbers]))
    return _confirmed(shard, queries, pairs // n, pairs % n, threshold)


def _unit(blob: bytes, dim: int) -> np.ndarray:
    x = np.frombuffer(blob, dtype="<f8").reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable() -> Column:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine & some, F.lit(False))


def links(points: DataFrame, threshold: float = THRESHOLD, shard_size: int = SHARD) -> DataFrame:
    """``(kind, a, b)`` for distinct ``points`` (node, label, embedding, n): kind 0 has the node and how many rows
    it is linked with in one shard, kind 1 an edge of a spanning forest."""
    sizes = points.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard_size).alias("shards"))
    dealt = join_lookup(points, sizes, ["label", "dim"], "inner").withColumn(
        "shard", F.pmod(F.xxhash64("node"), F.col("shards"))
    )

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        dim = int(pdf["dim"].iloc[0])
        exact = np.stack(pdf["embedding"].to_numpy()).astype("<f8")
        shard = Shard(_unit(exact.tobytes(), dim), threshold)
        return pd.DataFrame({
            "label": [pdf["label"].iloc[0]], "dim": [dim], "shard": [pdf["shard"].iloc[0]],
            "nodes": [pdf["node"].to_numpy("<i8").tobytes()], "counts": [pdf["n"].to_numpy("<i8").tobytes()],
            "vectors": [exact.tobytes()], "graph": [shard.dump()],
        })

    slim = dealt.select(F.col("label").cast("string").alias("label"), "dim", "shard", "node", "n", "embedding")
    shards = stash(
        slim.groupBy("label", "dim", "shard").applyInPandas(
            packed, "label string, dim int, shard bigint, nodes binary, counts binary, vectors binary, graph binary"
        ),
        "embedding-shards",
    )
    names = shards.select("label", "dim", "shard")
    pairs = names.join(names.withColumnRenamed("shard", "block"), ["label", "dim"])
    asking = shards.select(
        "label", "dim", F.col("shard").alias("block"), F.col("nodes").alias("q_nodes"),
        F.col("counts").alias("q_counts"), F.col("vectors").alias("q_vectors"),
    )
    work = pairs.join(shards, ["label", "dim", "shard"]).join(asking, ["label", "dim", "block"])

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for w in pdf.itertuples():
            exact, queries = _unit(w.vectors, w.dim), _unit(w.q_vectors, w.dim)
            row, place = links_of(Shard(exact, threshold, w.graph), queries, threshold, own=w.shard == w.block)
            nodes, asked = np.frombuffer(w.nodes, "<i8"), np.frombuffer(w.q_nodes, "<i8")
            counts = np.frombuffer(w.counts, "<i8")
            other = asked[row] != nodes[place]
            row, place = row[other], place[other]
            linked_rows = np.bincount(row, weights=counts[place], minlength=len(asked)).astype(np.int64)
            every = np.unique(np.concatenate([asked, nodes]))
            forest = Forest(len(every))
            forest.join(np.searchsorted(every, asked[row]), np.searchsorted(every, nodes[place]))
            root = forest.flat()
            at = np.flatnonzero(root != np.arange(len(every)))
            out.append(pd.DataFrame({"kind": 0, "a": asked, "b": linked_rows}))
            out.append(pd.DataFrame({"kind": 1, "a": every[at], "b": every[root[at]]}))
        return pd.concat(out)

    return work.groupBy("label", "dim", "shard", "block").applyInPandas(linked, "kind int, a bigint, b bigint")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, shard_size: int = SHARD) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    key = ["label", "k1", "k2"]
    rows = embeddings.select("vec_id", "label", "embedding", _usable().alias("usable")).withColumns({
        "k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit("second key"), "embedding"),
    })
    points = stash(
        rows.where("usable").groupBy(*key)
        .agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("embedding")}),
        "embedding-points",
    )
    found = stash(links(points, threshold, shard_size), "embedding-links")
    classes = stash(connected_components(found.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("hub"))), "embedding-classes")
    linked = points.select("node", "first_id").join(classes, "node")
    smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = linked.join(smallest, "component").select("node", "component_id")
    counted = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    known = stash(
        points.select(*key, "node", "n", "first_id").join(counted, "node", "left").join(named, "node", "left").select(
            *key, (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component_id", "first_id").alias("component_id"),
        ),
        "embedding-known",
    )
    usable = join_lookup(rows.where("usable").drop("embedding"), known, key, "left")
    lone = rows.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.select("vec_id", "n_links", "component_id").unionByName(lone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
