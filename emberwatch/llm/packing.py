"""Packing tokenised documents into sequences of a fixed length by minimum bin slack.

**Pieces.** A document is its ids from the tokenizers library and the end id. Only a document longer than a
sequence is cut; its last piece may be shorter. Pieces are never cut again, so packing depends on their lengths alone.

**Minimum bin slack.** Sequences are filled one after the other. Each takes the longest piece that is left and the fullest
feasible combination of the other lengths beside it: the sums that lengths can reach are bits of one whole number,
``sums |= sums << length`` adds a piece, and copies are added in powers of two. The highest bit within the space is the
fullest filling; going back through the sums (longest length first, as many of it as can be) names the combination. It
is then removed, as often as the pieces suffice, since the same combination stays the fullest until one of its lengths runs short. Sums
of short lengths are kept from one combination to the next while their counts still exceed what fits.

**Scale.** The search sees one count per length, at most ``SEQUENCE`` numbers for any corpus. A combination ends
when a length has fewer pieces than it takes, so there are at most about ``SEQUENCE * ln(SEQUENCE)`` combinations, each of at most
``sqrt(2 * SEQUENCE)`` lengths: the plan has a size bound without regard to the input, and is broadcast. Documents are encoded where they lie;
rows of a few numbers per piece are numbered in order of length (ranges, no task sees more than one) and look their place
up in the plan by length and number.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each for itself; a null doc_id is packed
like any other; pieces of one length are told apart by doc_id, piece and row; an empty table gives an empty result; extra columns
are not looked at; the string of an added token in a text is that token."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import numbered, stash
from emberwatch.llm.library_ids import ChunkEncoder, between_blanks

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SEQUENCE = 4096
_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path, between_blanks)
    return _ENCODERS[path]


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    end = np.array([end_id], dtype="<u4")
    for batch in batches:
        rows: list[tuple] = []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), _encoder(path).encode(batch.column("text"))):
            ids = np.concatenate([ids, end], dtype="<u4")
            for piece, start in enumerate(range(0, len(ids), size)):
                own = ids[start:start + size]
                rows.append((doc, piece, start, len(own), crc32(own.tobytes())))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, path: str | None = None, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of the pieces of every row of ``docs`` (doc_id, text)."""
    path = path or public_tokenizers.path(TOKENIZER)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _cut(batches, path, end_id, size), _PIECE)


@dataclass
class Slack:
    """What is left to pack: lengths, shortest first, and the sums that the first of them can reach."""

    lengths: list[int]
    counts: list[int]
    size: int
    sums: list[int] = field(default_factory=lambda: [1])  # sums[i]: of the first i lengths

    def _with(self, sums: int, length: int, count: int) -> int:
        count, step, within = min(count, self.size // length), 1, (1 << self.size + 1) - 1
        while count > 0:
            take = min(step, count)
            sums |= sums << take * length & within
            count, step = count - take, 2 * step
        return sums

    def fullest(self) -> dict[int, int]:
        """Places in ``lengths`` and how many of each: the longest one and the fullest filling beside it."""
        top = len(self.lengths) - 1
        for i in range(len(self.sums) - 1, top):
            self.sums.append(self._with(self.sums[i], self.lengths[i], self.counts[i]))
        longest = self.lengths[top]
        space = self.size - longest
        reach = self._with(self.sums[top], longest, self.counts[top] - 1) & ((1 << space + 1) - 1)
        left = reach.bit_length() - 1
        taken = {top: 1}
        for i in range(top, -1, -1):
            if not left:
                break
            length = self.lengths[i]
            count = min(self.counts[i] - taken.get(i, 0), left // length)
            while not self.sums[i] >> left - count * length & 1:
                count -= 1
            if count:
                taken[i] = taken.get(i, 0) + count
                left -= count * length
        return taken

    def remove(self, taken: dict[int, int]) -> int:
        """Take the combination as often as it goes; returns how often."""
        times = min(self.counts[i] // n for i, n in taken.items())
        changed = []
        for i, n in taken.items():
            enough = self.size // self.lengths[i]
            self.counts[i] -= n * times
            if self.counts[i] < enough:
                changed.append(i)
        if changed:
            del self.sums[min(changed) + 1:]
            gone = [i for i in changed if not self.counts[i]]
            for i in sorted(gone, reverse=True):
                del self.lengths[i], self.counts[i]
        return times


_RUN = ["length", "first", "sequence", "per", "offset"]


def plan(counts: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Runs of pieces, by length and number of their first piece: columns ``_RUN``. The pieces of a run fill its
    sequences from ``sequence`` on, ``per`` in each, one after the other from ``offset`` on."""
    slack = Slack(sorted(counts), [counts[k] for k in sorted(counts)], size)
    used, runs, sequence = dict.fromkeys(counts, 0), [], 0
    while slack.lengths:
        found = slack.fullest()
        taken = {slack.lengths[i]: n for i, n in found.items()}
        times, offset = slack.remove(found), 0
        for length, n in taken.items():
            runs.append((length, used[length], sequence, n, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, len(_RUN))


def _placed(batches: Iterator[pa.RecordBatch], runs: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
    length_of, first, sequence, per, offset = runs.T
    key = before[length_of] + first  # the place of a run's first piece among all pieces
    order = np.argsort(key, kind="stable")
    for batch in batches:
        position, length = (batch.column(c).to_numpy() for c in ("position", "length"))
        at = order[np.searchsorted(key[order], position, side="right") - 1]
        turn, slot = np.divmod(position - key[at], per[at])
        columns = [c for c in batch.schema.names if c != "position"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in columns), pa.array(sequence[at] + turn), pa.array(offset[at] + slot * length)],
            [*columns, "sequence_id", "offset"],
        )


def pack(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``cut`` (see :func:`pieces`) with ``sequence_id`` and ``offset``."""
    rows = stash(cut.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    found = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row per length
    counts = {r["length"]: r["n"] for r in found}
    before = np.zeros(size + 2, dtype=np.int64)
    before[1:] = np.cumsum([counts.get(k, 0) for k in range(size + 1)])  # pieces of all shorter lengths
    shared = rows.sparkSession.sparkContext.broadcast((plan(counts, size), before))
    order = [F.col("length"), F.col("doc_id").asc_nulls_last(), F.col("piece"), F.col("row")]
    return numbered(rows, order, "packing-order").drop("row").mapInArrow(
        lambda batches: _placed(batches, *shared.value),
        _PIECE + ", sequence_id bigint, offset bigint",
    )


def report(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs))
