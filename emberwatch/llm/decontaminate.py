"""Benchmark decontamination with suffix arrays of the training texts.

The training texts are cut into shards (the Arrow batches of the scan). A task numbers the words of
its shard, sorts the suffixes into a suffix array and finds every benchmark window in it by binary
search, which gives the places of all verbatim matches. Two facts keep the array small without losing
a match: only the benchmark's words get a number (any other word is 0 and equals no window), and a
suffix whose first two words never follow each other in the benchmark cannot start a match. Suffixes
are compared by as many words as the longest window has.

No text is shuffled. The benchmark goes to the tasks in blocks of at most ``block_words`` words; a
benchmark of several blocks is several passes over the rows, which carry the places hit so far, so
neither the driver nor a task ever holds more than a block.

Defined cases: a null or empty text has no words and no hits; an item without words has no windows; an
item of fewer than ``window`` words is one window; equal items all count; an empty benchmark hits
nothing; repeated rows are answered each for itself."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import unused

WINDOW = 10
BLOCK_WORDS = 2_000_000

# Bytes that separate words become blanks; A-Z become a-z; all else (0-9, a-z, non-ASCII) is kept.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A
    else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F
    else b
    for b in range(256)
)

HIT_TYPE = "struct<n_words:bigint,spans:array<bigint>,items:array<string>>"
_ARROW_HIT = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split() if text else []


@dataclass
class Windows:
    """A block of benchmark windows, each distinct one once."""

    vocab: dict[bytes, int]
    ids: np.ndarray  # (n, window) word numbers, 0 behind the end of a short window
    length: np.ndarray
    first: np.ndarray  # by word number: does a window start with it?
    single: np.ndarray  # by word number: is it a window on its own?
    pairs: np.ndarray  # sorted first two words of the longer windows
    owner_start: np.ndarray  # items of window i: owners[owner_start[i]:owner_start[i + 1]]
    owners: np.ndarray
    owner_pos: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], window: int = WINDOW) -> Windows:
        vocab: dict[bytes, int] = {}
        names, rows, length, owners, pos = [], [], [], [], []
        for name, text in items:
            number = [vocab.setdefault(w, len(vocab) + 1) for w in words_of(text)]
            if not number:
                continue
            own = np.zeros((max(1, len(number) - window + 1), window), dtype=np.int32)
            size = min(window, len(number))
            own[:, :size] = np.lib.stride_tricks.sliding_window_view(np.array(number, dtype=np.int32), size)
            rows.append(own)
            length.append(np.full(len(own), size))
            owners.append(np.full(len(own), len(names)))
            pos.append(np.arange(len(own)))
            names.append(name)
        if not rows:
            rows, length = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
            owners, pos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ids, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        which = which.reshape(-1)
        order = np.argsort(which, kind="stable")
        size = np.zeros(len(ids), dtype=np.int64)
        size[which] = np.concatenate(length)
        first, single = np.zeros(len(vocab) + 1, dtype=bool), np.zeros(len(vocab) + 1, dtype=bool)
        first[ids[:, 0]] = True
        single[ids[size == 1, 0]] = True
        many = ids[size > 1].astype(np.int64)
        pairs = np.unique(many[:, 0] << 32 | many[:, 1]) if window > 1 else np.zeros(0, np.int64)
        return cls(
            vocab, ids, size, first, single, pairs,
            np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(ids)))]),
            np.concatenate(owners)[order], np.concatenate(pos)[order], names,
        )


class SuffixArray:
    """The suffixes of a shard that can start a match, in the order of their first words."""

    def __init__(self, ids: np.ndarray, block: Windows):
        width = block.ids.shape[1]
        self.text = np.concatenate([ids, np.zeros(width, dtype=np.int32)])
        at = np.flatnonzero(block.first[ids])
        pair = self.text[at].astype(np.int64) << 32 | self.text[at + 1]
        slot = np.searchsorted(block.pairs, pair)
        known = slot < len(block.pairs)
        known[known] = block.pairs[slot[known]] == pair[known]
        at = at[known | block.single[ids[at]]]
        columns = [self.text[at + j] for j in range(width)]
        self.at = at[np.lexsort(columns[::-1])]

    def _bound(self, j: int, word: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
        """First place in lo..hi whose j-th word is not below (with ``right``: above) ``word``."""
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            seen = self.text[self.at[mid] + j]
            up = seen <= word[open_] if right else seen < word[open_]
            lo[open_] = np.where(up, mid + 1, lo[open_])
            hi[open_] = np.where(up, hi[open_], mid)
        return lo

    def find(self, block: Windows) -> tuple[np.ndarray, np.ndarray]:
        """All ``(place, window)`` at which a window occurs, by binary search of every window."""
        which = np.arange(len(block.ids))
        lo, hi = np.zeros(len(which), dtype=np.int64), np.full(len(which), len(self.at))
        done = [np.zeros((0, 3), dtype=np.int64)]
        for j in range(block.ids.shape[1]):
            word = block.ids[which, j].astype(np.int64)
            lo, hi = self._bound(j, word, lo, hi, False), self._bound(j, word, lo, hi, True)
            found = lo < hi
            end = found & (block.length[which] == j + 1)
            done.append(np.stack([which[end], lo[end], hi[end]], axis=1))
            go = found & ~end
            which, lo, hi = which[go], lo[go], hi[go]
        which, lo, hi = np.concatenate(done).T
        count = hi - lo
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return self.at[np.repeat(lo, count) + step], np.repeat(which, count)


def _shard(texts: list[str | None], block: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts, a 0 behind each text; where each begins; how many words it has."""
    get, number, size = block.vocab.get, [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = words_of(text)
        size[i] = len(words)
        number.append(np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words)))
        number.append(np.zeros(1, dtype=np.int32))
    ids = np.concatenate(number) if number else np.zeros(0, dtype=np.int32)
    return ids, np.cumsum(size + 1) - size - 1, size


def shard_matches(texts: list[str | None], block: Windows) -> list[tuple[int, str, int, int, int]]:
    """Longest verbatim matches of a shard: ``(text, item, start in text, start in item, words)``."""
    ids, start, _ = _shard(texts, block)
    place, window = SuffixArray(ids, block).find(block)
    count = block.owner_start[window + 1] - block.owner_start[window]
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    own = np.repeat(block.owner_start[window], count) + step
    place, size = np.repeat(place, count), np.repeat(block.length[window], count)
    item, at = block.owners[own], block.owner_pos[own]
    order = np.lexsort((place, place - at, item))
    place, at, item, size = place[order], at[order], item[order], size[order]
    fresh = np.ones(len(place), dtype=bool)
    fresh[1:] = (item[1:] != item[:-1]) | (place[1:] - place[:-1] != 1) | (at[1:] - at[:-1] != 1)
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(place)) - 1 if len(head) else head
    text = np.searchsorted(start, place[head], side="right") - 1
    return [
        (int(t), block.names[item[h]], int(place[h] - start[t]), int(at[h]), int(place[z] - place[h] + size[z]))
        for t, h, z in zip(text, head, last)
    ]


def _hits(texts: list[str | None], before: list, block: Windows) -> pa.Array:
    """Per text: words, spans hit (start, end, start, end, ...) and names of the items found."""
    ids, start, size = _shard(texts, block)
    place, window = SuffixArray(ids, block).find(block)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + block.length[window], -1)
    hit = np.concatenate([[False], np.cumsum(edge) > 0])
    change = np.flatnonzero(hit[1:] != hit[:-1])  # starts and ends in turn
    span_of = np.searchsorted(start, change, side="right") - 1
    found = np.unique((np.searchsorted(start, place, side="right") - 1) * max(len(block.ids), 1) + window)
    doc, window = np.divmod(found, max(len(block.ids), 1))
    cut_span, cut_doc = np.searchsorted(span_of, np.arange(len(texts) + 1)), np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i, old in enumerate(before):
        spans = (change[cut_span[i]:cut_span[i + 1]] - start[i]).tolist()
        names = {
            block.names[o]
            for w in window[cut_doc[i]:cut_doc[i + 1]]
            for o in block.owners[block.owner_start[w]:block.owner_start[w + 1]]
        }
        if old:
            spans, names = _merged(old["spans"], spans), names.union(old["items"])
        out.append({"n_words": int(size[i]), "spans": spans, "items": sorted(names, key=lambda x: (x is None, x or ""))})
    return pa.array(out, type=_ARROW_HIT)


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for lo, hi in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of at most so many words (or one item), read one partition at a time."""
    items, words = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    for row in rows.toLocalIterator():
        size = len(words_of(row["t"]))
        if items and words + size > block_words:
            yield items
            items, words = [], 0
        items.append((row["i"], row["t"]))
        words += size
    yield items


def with_hits(
    docs: DataFrame, benchmark: DataFrame, out: str = "hits",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with a column ``out``: words, spans of words hit, and items found, for every row.

    Items with a null id count together as one item, a null at the end of the items."""
    sc = docs.sparkSession.sparkContext
    result = docs.withColumn(out, F.lit(None).cast(HIT_TYPE))
    for items in _blocks(benchmark, block_words):
        hits = _hits_udf(sc.broadcast(Windows.of(items, window)))
        result = result.withColumn(out, hits(F.col("text"), F.col(out)))
    return result


def _hits_udf(block: Broadcast):
    def hits(text: pa.Array, before: pa.Array) -> pa.Array:
        return _hits(text.to_pylist(), before.to_pylist(), block.value)

    return F.arrow_udf(hits, HIT_TYPE)


def _matches_udf(block: Broadcast):
    fields = ("item_id", "doc_start", "item_start", "n_words")
    arrow = pa.list_(pa.struct([(f, pa.string() if f == "item_id" else pa.int64()) for f in fields]))

    def found(text: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(text))]
        for t, *rest in shard_matches(text.to_pylist(), block.value):
            out[t].append(dict(zip(fields, rest)))
        return pa.array(out, type=arrow)

    return F.arrow_udf(found, "array<struct<item_id:string,doc_start:bigint,item_start:bigint,n_words:bigint>>")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, doc_start, item_start, n_words)``: the longest verbatim matches, in words."""
    sc = docs.sparkSession.sparkContext
    parts = []
    for items in _blocks(benchmark, block_words):
        found = _matches_udf(sc.broadcast(Windows.of(items, window)))
        parts.append(docs.select("doc_id", F.explode(found("text")).alias("m")).select("doc_id", "m.*"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with the columns they had."""
    hits = unused(docs, "_hits")
    kept = with_hits(docs, benchmark, hits, window)
    return kept.where(F.size(F.col(hits)["spans"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with the numbers and the digest of the items found."""
    none = F.lit(_digest([]))
    hit = F.aggregate(
        F.sequence(F.lit(0), F.size("h.spans") - 2, F.lit(2)), F.lit(0).cast("bigint"),
        lambda n, i: n + F.get("h.spans", i + 1) - F.get("h.spans", i),
    )
    any_hit = F.size("h.spans") > 0
    return with_hits(docs.select("doc_id", "text"), benchmark, "h").select(
        "doc_id", F.col("h.n_words").alias("n_words"),
        F.when(any_hit, hit).otherwise(F.lit(0).cast("bigint")).alias("n_hit"),
        F.size("h.items").cast("bigint").alias("n_items"),
        F.when(any_hit, F.sha2(F.array_join("h.items", ","), 256)).otherwise(none).alias("items_sha256"),
        any_hit.alias("contaminated"),
    )
