"""Leader clustering of alert bursts.

In (time, id) order an alert joins the most similar open leader (the oldest on a tie), or becomes a
leader itself. A leader stays open for ``window_s`` seconds; its vector never changes.

How this runs in parallel with exactly the sequential result:

1. Equal texts have equal vectors, so rows are reduced to one per (text, tick) before anything
   else. A tick is a microsecond, so that windows are exact; a coarser tick (``tick_us``) reduces more rows,
   and windows then count whole ticks.
2. Alerts whose texts are in different components of the similarity graph never interact.
   Components are hashed into bins, and bins are scanned independently.
3. A bin with many rows (one component may hold most alerts) is cut in time into blocks of bounded
   size. Round n scans the n-th block of every bin, each starting from the leaders of the blocks before
   it that are still open, so every row is scanned once. (Where windows follow each other the first leader
   decides all later ones, so blocks cannot be guessed ahead of the one before.)
4. Members take no part in the scan; they look their leader up afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.cluster_io import cut
from emberwatch.functions import fixed_values as V
from emberwatch.functions.logs import parse_logs
from emberwatch.operators.components import (
    block_pairs,
    connected_components,
    similar_pairs_in,
    star_edges,
)
from emberwatch.operators.embed import distinct_texts, embed_texts, text_key
from emberwatch.operators.knn import unit_rows
from emberwatch.operators.skew import hot_keys, join_lookup, measured, salted_join
from emberwatch.settings import DEFAULTS, Settings

TICK_US = 1
SCAN_ROWS = 200_000

_SCAN = (
    "bin bigint, text_key binary, scope string, tick bigint, is_leader boolean, leader_id bigint, leader_ts bigint, "
    "similarity double, later array<struct<ts:bigint,id:bigint,similarity:double>>, "
    "embedding array<float>"
)


# --- similar texts -----------------------------------------------------------------------------
def _text_cells(base: DataFrame, window_us: int) -> DataFrame:
    """``(text_key, cell)`` with the first and last time of the text there; a cell is one window long."""
    cell = F.floor(F.col("ts") / F.lit(window_us)).alias("cell")
    return base.groupBy("text_key", cell).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


def _neighbours(cells: DataFrame) -> DataFrame:
    """Texts of a cell together with those of the cell before it, once per group: ``first`` is the text's first
    time in the cell, ``before`` its last time in the cell before (null: not there)."""
    spread = cells.select("text_key", "cell", "first", "last", F.explode(F.array(F.lit(0), F.lit(1))).alias("_before"))
    return (
        spread.groupBy((F.col("cell") + F.col("_before")).alias("cell"), "text_key")
        .agg(
            F.min(F.when(F.col("_before") == 0, F.col("first"))).alias("first"),
            F.max(F.when(F.col("_before") == 1, F.col("last"))).alias("before"),
        )
        .withColumn("node", F.xxhash64("text_key"))
    )


def _meetings(cells: DataFrame) -> DataFrame:
    """Like ``_neighbours``, with what tells whether two texts have met in the group before this one (``first_before``: the
    first time in the cell before, ``earlier``: the last time in the one before that) and ``lone``: the text is in one cell
    only. One row per text and group."""
    lone = (F.count(F.lit(1)).over(Window.partitionBy("text_key")) == 1).alias("lone")
    spread = cells.select("*", lone).withColumn("_back", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))

    def seen(back: int, time: str) -> Column:
        return F.when(F.col("_back") == back, F.col(time))

    return (
        spread.groupBy((F.col("cell") + F.col("_back")).alias("cell"), "text_key")
        .agg(
            F.min(seen(0, "first")).alias("first"), F.max(seen(1, "last")).alias("before"),
            F.min(seen(1, "first")).alias("first_before"), F.max(seen(2, "last")).alias("earlier"),
            F.max("lone").alias("lone"),
        )
        .where("first IS NOT NULL OR before IS NOT NULL")
        .withColumn("node", F.xxhash64("text_key"))
    )


_TIMES = ["first", "before", "first_before", "earlier"]
_PAIR = "text_a binary, text_b binary, similarity double"


def similar_pairs(
    alerts: DataFrame,
    window_s: int = DEFAULTS.window_s,
    threshold: float = DEFAULTS.cluster_threshold,
    conf: Settings = DEFAULTS,
) -> DataFrame:
    """``(text_a, text_b, similarity)``: different canonical texts at least ``threshold`` similar
    that occur at most ``window_s`` seconds apart.

    Texts, not alerts: a burst of n equal alerts adds nothing to the result. A family of n similar texts still
    has n*(n-1)/2 pairs; the clusters use one edge per text instead (``star_edges``).

    A pair is written by the one task in which its texts meet for the first time, so pairs are not shuffled. That is known
    there if one of them is ``lone``, in one cell only: its groups follow each other. Two texts that come back again and
    again may meet, part and meet; these alone are scored by themselves and made distinct."""
    # a condition on texts would be pushed under the parser; those without a key are left out by the join
    base = _base(alerts, None).where("ts IS NOT NULL")
    vec = cut(embed_texts(distinct_texts(base, "canonical_text"), conf.dim))
    window_us, limit = window_s * 1_000_000, round(threshold * 1e6)
    around = cut(_meetings(_text_cells(base, window_us)))
    # pairs leave a task some at a time, so its blocks may be larger: b blocks are b copies of every row
    wide = replace(conf, block_rows=4 * conf.block_rows)

    def pairs(of_lone: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches)
            own, lone = table["own"].to_numpy(), table["lone"].to_numpy()
            asked = np.flatnonzero(lone == of_lone)
            if not len(asked):
                return
            names = table["text_key"].combine_chunks().cast(pa.binary())
            place = np.empty(len(table), dtype=np.int64)  # in the order of keys
            place[pa.compute.sort_indices(names).to_numpy()] = np.arange(len(table))
            first, before, first_before, earlier = (
                table[c].to_pandas().to_numpy(dtype=float) for c in _TIMES
            )
            crossing = bool((own != own[0]).any())

            def near(i, j, here, last) -> np.ndarray:
                # both in this cell, or one here at most a window after the other was in the cell before; two texts
                # of the cell before were paired in their own cell
                both = ~np.isnan(here[i]) & ~np.isnan(here[j])
                return both | (here[i] - last[j] <= window_us) | (here[j] - last[i] <= window_us)

            vectors = _matrix(table["embedding"]).astype(np.float64)
            length = np.linalg.norm(vectors, axis=1)
            unit = vectors / np.where(length == 0, 1.0, length)[:, None]
            for i, j, score in similar_pairs_in(unit, asked, limit):
                keep = near(i, j, first, before) & ~near(i, j, first_before, earlier)
                if crossing:  # those of one block meet in the task of that block
                    keep &= own[i] != own[j]
                i, j, score = i[keep], j[keep], score[keep]
                swap = place[i] > place[j]
                a, b = np.where(swap, j, i), np.where(swap, i, j)
                columns = [names.take(pa.array(a)), names.take(pa.array(b)), pa.array(score / 1e6)]
                yield pa.RecordBatch.from_arrays(columns, ["text_a", "text_b", "similarity"])

        return run

    def found(some: DataFrame, of_lone: bool) -> DataFrame:
        members = join_lookup(block_pairs(some, ["cell"], wide), vec, "text_key", "inner", conf)
        times = [(F.col(c) - F.col("cell") * window_us).alias(c) for c in _TIMES]
        slim = members.select("cell", "lo", "hi", "own", "lone", "text_key", *times, "embedding")
        return slim.groupBy("cell", "lo", "hi").applyInArrow(pairs(of_lone), _PAIR)

    return found(around, True).unionByName(found(around.where("NOT lone"), False).distinct())


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


# --- clustering ------------------------------------------------------------------------------------
def _base(alerts: DataFrame, key: str | None) -> DataFrame:
    if "canonical_text" not in alerts.columns:
        alerts = parse_logs(alerts)
    scope = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    return alerts.select(
        "id", F.unix_micros("created_at").alias("ts"), scope.alias("scope"), "canonical_text",
        text_key(F.col("canonical_text")).alias("text_key"),
    )


def _components(base: DataFrame, vec: DataFrame, window_us: int, threshold: float, conf: Settings):
    """``(text_key, comp)``: components of the texts that are similar and meet in neighbouring cells of time."""
    keyed = vec.withColumn("node", F.xxhash64("text_key"))
    around = _neighbours(_text_cells(base, window_us))
    members = join_lookup(around, vec, "text_key", "inner", conf)
    # a task sends one edge per text, not its pairs, so its blocks may be larger: b blocks are b copies of every row
    wide = replace(conf, block_rows=4 * conf.block_rows)
    edges = cut(star_edges(block_pairs(members, ["cell"], wide), ["cell"], threshold).distinct())
    labels = connected_components(edges, conf).withColumnRenamed("component", "comp")
    return join_lookup(keyed.select("text_key", "node"), cut(labels.distinct()), "node", "inner", conf).drop("node")


def _blocks(rows: DataFrame, scan_rows: int) -> DataFrame:
    """``(bin, second, block)``: whole seconds in time order, about ``scan_rows`` rows per block. The window
    runs over the seconds of a bin, whose number is bounded by the time span (2.6 million in a month), not
    by the number of alerts."""
    seconds = rows.groupBy("bin", "second").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("bin").orderBy("second")) - F.col("n")
    about = seconds.select("bin", "second", F.floor(before / F.lit(scan_rows)).alias("about"))
    # numbered without gaps (a crowded second may take several numbers): each block follows the one before
    number = F.dense_rank().over(Window.partitionBy("bin").orderBy("about")).cast("bigint") - 1
    return about.select("bin", "second", number.alias("block"))


class _OpenLeaders:
    """Leaders in time order with their similarity (in millionths) to the texts of the block that they can meet. The
    first texts have one row each, in time order (``lone`` has their ticks); the others may come at any time."""

    def __init__(self, unit: np.ndarray, scope: np.ndarray, lone: np.ndarray, window_ticks: int, limit: int):
        self.unit, self.scope, self.lone, self.window, self.limit = unit, scope, lone, window_ticks, limit
        self.sims = np.empty((64, len(unit)), dtype=np.int32)
        self.marks = np.empty((64, 3), dtype=np.int64)  # tick, ts, id
        self.first = self.used = 0
        self.until = np.full(len(unit), np.iinfo(np.int64).min)

    def add(self, vector: np.ndarray, scope: str, tick: int, ts: int, alert: int, since: int | None = None) -> None:
        """``since``: the tick before which no row is left to scan."""
        if self.used == len(self.sims):
            self._make_room()
        sims = self.sims[self.used]
        sims[:] = 0
        lo = 0 if since is None else np.searchsorted(self.lone, since)
        hi = max(lo, np.searchsorted(self.lone, tick + self.window, side="right"))
        for met in (slice(lo, hi), slice(len(self.lone), None)):
            found = np.rint(self.unit[met] @ vector * 1e6).astype(np.int32)
            found[self.scope[met] != scope] = 0
            sims[met] = found
            near = found >= self.limit
            self.until[met][near] = np.maximum(self.until[met][near], tick + self.window)
        self.marks[self.used] = tick, ts, alert
        self.used += 1

    def _make_room(self) -> None:
        live = slice(self.first, self.used)
        size = self.used - self.first
        if size > len(self.sims) // 2:
            self.sims = np.vstack([self.sims[live], np.empty_like(self.sims)])
            self.marks = np.vstack([self.marks[live], np.empty_like(self.marks)])
        else:
            self.sims[:size], self.marks[:size] = self.sims[live].copy(), self.marks[live].copy()
        self.first, self.used = 0, size

    def best(self, text: int, tick: int) -> tuple[int, int, int]:
        """(id, ts, similarity) of the most similar open leader, the oldest on a tie."""
        while self.first < self.used and tick - self.marks[self.first, 0] > self.window:
            self.first += 1
        scores = self.sims[self.first : self.used, text]
        open_now = tick - self.marks[self.first : self.used, 0] <= self.window
        at = self.first + int(np.argmax(np.where(open_now, scores, -1)))
        return int(self.marks[at, 2]), int(self.marks[at, 1]), int(self.sims[at, text])


def _scanner(window_ticks: int, limit: int):
    def scan(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({name: [] for name in _SCAN_NAMES})
        rows = rows.sort_values(["tick", "first_ts", "first_id"], ignore_index=True)
        plain = side[side["leader_id"].isna()]
        position = {k: i for i, k in enumerate(zip(plain["text_key"], plain["scope"]))}
        texts = np.array([position[k] for k in zip(rows["text_key"], rows["scope"])])
        # texts of a single row first, in time order, so that those a leader can meet are one slice
        times, first_row = np.bincount(texts, minlength=len(plain)), np.zeros(len(plain), dtype=np.int64)
        first_row[texts[::-1]] = np.arange(len(texts))[::-1]
        order = np.lexsort((first_row, times > 1))
        texts, plain = np.argsort(order)[texts], plain.iloc[order]
        lone = rows["tick"].to_numpy()[first_row[order][: int((times == 1).sum())]]
        vectors, unit, scopes = plain["embedding"].to_numpy(), unit_rows(plain["embedding"]), plain["scope"].to_numpy()
        leaders = _OpenLeaders(unit, scopes, lone, window_ticks, limit)
        known = side[side["leader_id"].notna()].sort_values(["leader_ts", "leader_id"])
        if len(known):
            marks = known[["leader_tick", "leader_ts", "leader_id"]].astype("int64").to_numpy()
            for vector, scope, mark in zip(unit_rows(known["embedding"]), known["scope"], marks):
                leaders.add(vector, scope, *mark)

        texts = texts.tolist()
        ticks, first_ts, first_id = (rows[c].to_numpy() for c in ("tick", "first_ts", "first_id"))
        last_ts, last_id = rows["last_ts"].to_numpy(), rows["last_id"].to_numpy()
        several = (last_ts > first_ts) | (last_id > first_id)
        is_leader, found, later = [], [], []
        start = 0
        for i, (t, tick) in enumerate(zip(texts, ticks)):
            if tick != ticks[start]:
                start = i
            later.append([])
            if leaders.until[t] >= tick:
                is_leader.append(False)
                found.append(leaders.best(t, tick))
                continue
            mark = (int(first_ts[i]), int(first_id[i]))
            leaders.add(unit[t], scopes[t], int(tick), *mark, since=int(tick))
            is_leader.append(True)
            found.append((mark[1], mark[0], 1_000_000))
            # alerts of this tick that come after the new leader may prefer it
            for r in range(start, i):
                if several[r] and not is_leader[r] and (last_ts[r], last_id[r]) > mark:
                    score = int(leaders.sims[leaders.used - 1, texts[r]])
                    best = round(later[r][-1]["similarity"] * 1e6) if later[r] else found[r][2]
                    if score >= limit and score > best:
                        later[r].append({"ts": mark[0], "id": mark[1], "similarity": score / 1e6})
        return pd.DataFrame(
            {
                "bin": rows["bin"], "text_key": rows["text_key"], "scope": rows["scope"], "tick": ticks,
                "is_leader": is_leader, "leader_id": [f[0] for f in found],
                "leader_ts": [f[1] for f in found], "similarity": [f[2] / 1e6 for f in found],
                "later": later, "embedding": [vectors[t] if led else None for t, led in zip(texts, is_leader)],
            }
        )

    return scan


_SCAN_NAMES = [
    "bin", "text_key", "scope", "tick", "is_leader", "leader_id", "leader_ts", "similarity", "later",
    "embedding",
]


def cluster_alerts(
    alerts: DataFrame,
    window_s: int = DEFAULTS.window_s,
    threshold: float = DEFAULTS.cluster_threshold,
    key: str | None = None,
    open_leaders: DataFrame | None = None,
    tick_us: int = TICK_US,
    scan_rows: int = SCAN_ROWS,
    conf: Settings = DEFAULTS,
) -> DataFrame:
    """``(id, cluster_key, is_leader, similarity)`` for alerts with ``id, created_at`` and either
    ``raw_log`` or ``canonical_text``; ``cluster_key`` is the id of the leader.

    ``key`` names a column whose values never share a cluster. ``open_leaders`` (``id, created_at,
    canonical_text`` and the key) are leaders from earlier input that may still take members."""
    if (window_s * 1_000_000) % tick_us:
        raise ValueError("the window must be a whole number of ticks")
    window_us, window_ticks = window_s * 1_000_000, window_s * 1_000_000 // tick_us
    with_text = _base(alerts, key)
    known = _base(open_leaders, key) if open_leaders is not None else None
    all_texts = with_text if known is None else with_text.unionByName(known)
    # no filter on the parsed text: it would be pushed below the parsing and parse every log twice
    vec = cut(embed_texts(distinct_texts(all_texts, "canonical_text"), conf.dim))
    # from here on only (id, time, key of the text): logs are parsed twice, not at every use
    base = cut(with_text.withColumn("blank", F.col("canonical_text") == "").drop("canonical_text"))
    real, silent = base.where("NOT blank").drop("blank"), base.where("blank")
    tick = F.floor(F.col("ts") / F.lit(tick_us)).alias("tick")
    if known is not None:
        known = known.drop("canonical_text")
    all_rows = real if known is None else real.unionByName(known)
    stamp = F.struct("ts", "id")
    reduced = cut(
        real.groupBy("text_key", "scope", tick).agg(
            F.min(stamp).alias("_f"), F.max(stamp).alias("_l"), F.count(F.lit(1)).alias("n")
        )
    )
    parts = _components(all_rows, vec, window_us, threshold, conf)
    bins = max(1, -(-reduced.count() * 4 // scan_rows))
    part_of = cut(
        parts.select("text_key", F.pmod(F.xxhash64("comp"), F.lit(bins)).cast("bigint").alias("bin"))
    )
    rows = join_lookup(reduced, part_of, "text_key", "inner", conf).select(
        "bin", "text_key", "scope", "tick",
        F.col("_f.ts").alias("first_ts"), F.col("_f.id").alias("first_id"),
        F.col("_l.ts").alias("last_ts"), F.col("_l.id").alias("last_id"),
        F.floor(F.col("tick") * tick_us / 1_000_000).alias("second"),
    )
    plan = cut(_blocks(rows, scan_rows))
    placed = cut(join_lookup(rows, plan, ["bin", "second"], "inner", conf).drop("second"), "block", ["bin"])
    starts = cut(placed.groupBy("bin", "block").agg(F.min("tick").alias("start")))

    own_texts = cut(
        join_lookup(placed.select("bin", "block", "text_key", "scope").distinct(), vec, "text_key", "inner", conf).select(
            "bin", "block", "text_key", "scope", "embedding",
            *[F.lit(None).cast("bigint").alias(c) for c in ("leader_tick", "leader_ts", "leader_id")],
        ),
        "block", ["bin"],
    )
    given = None
    if known is not None:
        seeds = join_lookup(known, part_of, "text_key", "inner", conf).select(
            "bin", "text_key", "scope", tick, F.col("ts").alias("leader_ts"), F.col("id").alias("leader_id")
        )
        # leaders of earlier input precede every block; a late alert may even be older than they are
        reach = seeds.join(starts, "bin").where(
            (F.col("block") == 0) | (F.col("start") - F.col("tick") <= window_ticks)
        ).withColumnRenamed("tick", "leader_tick")
        given = cut(join_lookup(reach, vec, "text_key", "inner", conf).select(*own_texts.columns))
    scan = _scanner(window_ticks, round(threshold * 1e6))
    rounds = (plan.agg(F.max("block")).first()[0] or 0) + 1
    scanned, open_now = [], None
    for n in range(rounds):
        side = own_texts.where(F.col("block") == n)
        if given is not None:
            side = side.unionByName(given.where(F.col("block") == n))
        if open_now is not None:
            side = side.unionByName(open_now)
        mine = placed.where(F.col("block") == n).groupBy("bin", "block")
        scanned.append(cut(mine.cogroup(side.groupBy("bin", "block")).applyInPandas(scan, _SCAN)))
        if n + 1 < rounds:
            led = scanned[-1].where("is_leader").select(
                "bin", "text_key", "scope", "embedding", F.col("tick").alias("leader_tick"), "leader_ts", "leader_id"
            )
            if open_now is not None:
                led = led.unionByName(open_now.drop("block"))
            # a leader whose window has ended at the start of a block is closed for the later ones too
            following = F.broadcast(starts.where(F.col("block") == n + 1))
            open_now = cut(
                led.join(following, "bin").where(F.col("start") - F.col("leader_tick") <= window_ticks)
                .select(*own_texts.columns)
            )
    found = reduce(DataFrame.unionByName, scanned)
    return _assigned(real, silent, found, reduced, tick, conf)


def _assigned(real, silent, found, reduced, tick, conf: Settings) -> DataFrame:
    keys = ["text_key", "scope", "tick"]
    lookup = found.select(*keys, "is_leader", "leader_id", "similarity", "later")
    # the rows per (text, tick) are known from the reduction
    size = reduced.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    ticked = real.select("id", "ts", "text_key", "scope", tick)
    if size["rows"] <= conf.broadcast_rows and measured(lookup, conf) is not None:
        joined = ticked.join(F.broadcast(lookup), keys)
    else:
        joined = salted_join(ticked, lookup, hot_keys(reduced, keys, size["total"], conf), keys, "inner")
    newer = F.filter(
        "later",
        lambda x: (x["ts"] < F.col("ts")) | ((x["ts"] == F.col("ts")) & (x["id"] < F.col("id"))),
    )
    pick = F.try_element_at(newer, F.lit(-1))
    members = joined.select(
        "id",
        F.coalesce(pick["id"], "leader_id").alias("cluster_key"),
        (F.col("is_leader") & (F.col("id") == F.col("leader_id"))).alias("is_leader"),
        F.coalesce(pick["similarity"], "similarity").alias("similarity"),
    )
    # a text without content has no direction: always a cluster of its own
    alone = silent.select(
        "id", F.col("id").alias("cluster_key"), F.lit(True).alias("is_leader"), F.lit(1.0).alias("similarity")
    )
    return members.unionByName(alone)


def cluster_summary(members: DataFrame, min_size: int = DEFAULTS.min_cluster_size) -> DataFrame:
    """``(cluster_key, count, services, examples, first_seen)`` of clusters with ``min_size`` alerts.

    ``members`` has ``cluster_key, id, created_at, service, raw_log``. Only three example rows per
    cluster and task are shuffled."""
    counts = members.groupBy("cluster_key").agg(
        F.count(F.lit(1)).alias("count"),
        F.array_sort(F.collect_set(F.nullif("service", F.lit("")))).alias("services"),
        F.min("created_at").alias("first_seen"),
    ).where(F.col("count") >= min_size)
    order = Window.partitionBy("cluster_key").orderBy("created_at", "id")
    firsts = (
        members.select(
            "cluster_key", "created_at", "id", F.left("raw_log", F.lit(V.EXAMPLE_CHARS)).alias("example")
        )
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= V.EXAMPLES)
        .groupBy("cluster_key")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "example"))).alias("_e"))
    )
    return counts.join(firsts, "cluster_key").select(
        "cluster_key", "count", "services",
        F.transform("_e", lambda e: e["example"]).alias("examples"), "first_seen",
    )
