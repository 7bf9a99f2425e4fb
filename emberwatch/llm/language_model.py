"""Language-model scores by a weighted backoff automaton.

**Model.** Words up to ``ORDER`` long are counted over all training texts. A context ``h`` seen ``C(h)`` times gives
``p(w|h) = (c(hw) + K * p(w|h')) / (C(h) + K)``, where ``h'`` is ``h`` without its first word; the empty context
gives ``p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))``. Nothing is pruned, so each context's probabilities
sum to one, and what a context leaves to the shorter one is ``K / (C(h) + K)``.

**Automaton.** Contexts are states; an n-gram that was seen is an arc with its log-probability; a failure arc goes
to the state of the shorter context and carries the logarithm of ``K / (C(h) + K)``. One pass over a
text, left to right, carries the state: where it has no arc for the next word, failure arcs are taken and their
weights added, until there is one.

**Scale.** The model is as large as the corpus and is never in one place. Texts are cut into blocks of about
``BLOCK_CHARS``, which are written with their words as numbers. Each block asks for the n-grams that it
holds: their hashes go, packed, to buckets by hash, with the block's training counts. A bucket adds
up what all blocks know and answers each block with what the others add, in the order of the question.
With them a block builds, slice of texts by slice, the part of the automaton that the slice can reach and scores it. An
n-gram comes once per block, so a frequent one makes no bucket larger than the others. A bucket has about
``BUCKET_KEYS`` n-grams. Sorted hashes travel as differences, counts and answers as the bytes they fill, both compressed.

Single words are told apart by 63 bits of their hash. Longer n-grams have as many bits as it takes for the chance that
one shares its hash with another to be at most ``2 ** -SPARE_BITS``, by the number of tokens, up to 63.

Defined cases: null and empty texts are the end token alone; unknown words share the mass of one word; with no
training text, N and V are 0 and every token has probability 1; repeated rows count and are
scored each for itself; a null doc_id belongs to the fold of the empty text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import fold, stash

ORDER = 3
K = 2.0  # pseudo-count of the shorter context
ADD = 0.1
BLOCK_CHARS = 16 << 20
SLICE_TOKENS = 350_000  # an automaton is built for so many tokens, or for one longer text
SPARE_BITS = 24
BUCKET_KEYS = 1_000_000
_BEGIN, _END = 0, 1  # numbers of the two marks; words follow
_MARKS = [b" begin", b" end"]  # no word has a blank
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _zip(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(raw: bytes) -> bytes:
    size = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], size, codec="zstd", asbytes=True) if size else b""


def pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 64 as planes of bytes, as many planes as the largest one needs."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    width = -(-int(values.max()).bit_length() // 8) if len(values) else 0
    return len(values).to_bytes(8, "little") + _zip(planes[:, :width].T.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    size, planes = int.from_bytes(raw[:8], "little"), np.frombuffer(_unzip(raw[8:]), np.uint8)
    out = np.zeros((size, 8), dtype=np.uint8)
    if len(planes):
        out[:, : len(planes) // size] = planes.reshape(-1, size).T
    return out.view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def key_bits(tokens: int) -> int:
    """Bits of the hash of a longer n-gram, see above."""
    return min(63, max(40, tokens.bit_length() + SPARE_BITS))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").lower().split() if text else []


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its words, and every text as word numbers with the end mark."""
    part, number = TaskContext.get().partitionId(), 0
    ids: dict[bytes, int] = {}
    rows: list[tuple] = []
    texts: list[np.ndarray] = []
    size = 0

    def row() -> pa.RecordBatch:
        nonlocal number, ids, rows, texts, size
        values = {
            "block": [part << 32 | number],
            "words": [_zip(b" ".join(list(ids)))],
            "doc_ids": [[r[0] for r in rows]], "learn": [[r[1] for r in rows]],
            "lengths": [pack(np.array([len(t) for t in texts]))],
            "n_tokens": [sum(map(len, texts))],
            "tokens": [pack(np.concatenate(texts))],
        }
        number, ids, rows, texts, size = number + 1, {}, [], [], 0
        return pa.RecordBatch.from_pydict(values, schema=_BLOCK_ARROW)

    for batch in batches:
        for doc, learn, text in zip(*(batch.column(c) for c in ("doc_id", "learn", "text"))):
            words = words_of(text.as_py())
            own = np.fromiter((ids.setdefault(w, len(ids) + 2) for w in words), dtype=np.uint32, count=len(words))
            texts.append(np.append(own, np.uint32(_END)))
            rows.append((doc.as_py(), learn.as_py()))
            size += 6 * len(words) + 16
            if size > BLOCK_CHARS:
                yield row()
    if rows:
        yield row()


_BLOCK = "block bigint, words binary, doc_ids array<bigint>, learn array<boolean>, lengths binary, n_tokens bigint, tokens binary"
_BLOCK_ARROW = pa.schema([
    ("block", pa.int64()), ("words", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
    ("learn", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("n_tokens", pa.int64()), ("tokens", pa.binary()),
])


@dataclass
class Gram:
    """The distinct n-grams of one length in a block."""

    which: np.ndarray  # by place: the n-gram that ends there, -1 if none
    first: np.ndarray  # by n-gram: a place where it ends
    total: np.ndarray  # by n-gram: how often training texts have it


@dataclass
class Block:
    """A block's texts as one run of word numbers, a begin mark before and an end mark behind each text."""

    number: int
    words: list[bytes]
    doc_ids: list
    learn: np.ndarray
    tokens: np.ndarray
    start: np.ndarray  # place of each text's begin mark
    stop: np.ndarray  # place behind its end mark

    @classmethod
    def of(cls, row: dict) -> Block:
        length = unpack(row["lengths"]).astype(np.int64)
        stop = np.cumsum(length + 1)
        start = stop - length - 1
        tokens = np.full(int(stop[-1]), _BEGIN, dtype=np.int32)
        inner = np.ones(len(tokens), dtype=bool)
        inner[start] = False
        tokens[inner] = unpack(row["tokens"])
        words = _unzip(row["words"])
        return cls(
            row["block"], _MARKS + (words.split(b" ") if words else []), list(row["doc_ids"]),
            np.array(row["learn"], dtype=bool), tokens, start, stop,
        )

    def slices(self) -> Iterator[Block]:
        """The same texts, in blocks of about ``SLICE_TOKENS``."""
        lo = 0
        while lo < len(self.start):
            first = int(self.start[lo])
            hi = max(lo + 1, int(np.searchsorted(self.stop, first + SLICE_TOKENS, "right")))
            yield Block(
                self.number, self.words, self.doc_ids[lo:hi], self.learn[lo:hi], self.tokens[first:int(self.stop[hi - 1])],
                self.start[lo:hi] - first, self.stop[lo:hi] - first,
            )
            lo = hi

    def word_hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), dtype=np.uint64, count=len(self.words))

    def ends(self, order: int, bits: int, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per length: places where an n-gram ends, and the key of each; ``word`` has the words' hashes."""
        since = np.arange(len(self.tokens)) - np.repeat(self.start, self.stop - self.start)
        h = word[self.tokens]
        for n in range(1, order + 1):
            if n > 1:
                h = (h ^ h >> np.uint64(31)) * _MULT
                h[1:], h[0] = h[:-1] + word[self.tokens[1:]] * np.uint64(2 * n + 1), 0
            at = np.flatnonzero(since >= n - 1)
            yield at, h[at] >> np.uint64(64 - _width(n, bits))

    def counted(self, order: int, bits: int, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per length: keys of the distinct n-grams, ascending, and how often each is in a training text."""
        learn = np.repeat(self.learn, self.stop - self.start).astype(np.uint64)
        for at, keys in self.ends(order, bits, word):
            keys = keys << np.uint64(1) | learn[at]
            keys.sort()
            own, fresh = keys >> np.uint64(1), np.ones(len(keys), dtype=bool)
            fresh[1:] = own[1:] != own[:-1]
            first = np.flatnonzero(fresh)
            yield own[first], np.add.reduceat(keys & np.uint64(1), first).astype(np.int64) if len(first) else np.zeros(0, np.int64)

    def grams(self, order: int, bits: int, word: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]]) -> list[Gram]:
        """Per length the distinct n-grams, numbered in the order in which they come, so that a text's arcs are
        neighbours in memory; ``known`` has the keys that there are, ascending, and their totals."""
        out = []
        for (at, keys), (there, totals) in zip(self.ends(order, bits, word), known):
            distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            fresh = np.zeros(len(at), dtype=bool)
            fresh[first] = True
            number = (np.cumsum(fresh) - 1)[first]
            which, total = np.full(len(self.tokens), -1), np.zeros(len(distinct), dtype=np.int64)
            which[at] = number[inverse]
            total[number] = totals[np.searchsorted(there, distinct)]
            out.append(Gram(which, at[fresh], total))
        return out


def _width(length: int, bits: int) -> int:
    return 63 if length == 1 else bits


def _bucket_of(keys: np.ndarray, width: int, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(width - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


_ASK = "bucket bigint, block bigint, length int, keys binary, counts binary"


def _asked(batches: Iterator[pa.RecordBatch], order: int, bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block.of(batch.slice(i, 1).to_pylist()[0])
            for n, (keys, count) in enumerate(block.counted(order, bits, block.word_hashes()), 1):
                # keys are sorted, so buckets are
                cut = np.searchsorted(_bucket_of(keys, _width(n, bits), buckets), np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full), pa.array(np.full(len(full), block.number)), pa.array(np.full(len(full), n, dtype=np.int32)),
                        pa.array([pack_sorted(keys[cut[j]:cut[j + 1]]) for j in full], pa.binary()),
                        pa.array([pack(count[cut[j]:cut[j + 1]]) for j in full], pa.binary()),
                    ],
                    ["bucket", "block", "length", "keys", "counts"],
                )


def _answered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals for all askers of a bucket; also how many distinct training words it holds and their tokens."""
    out = []
    for n, own in pdf.groupby("length"):
        keys = [unpack_sorted(k) for k in own["keys"]]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack(c) for c in own["counts"]])
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype("<u8")
        begin = np.uint64(xxhash.xxh64_intdigest(_MARKS[_BEGIN]) >> 1)
        word = (total > 0) & (distinct != begin) if n == 1 else np.zeros(len(distinct), dtype=bool)
        cut = np.cumsum([0, *map(len, keys)])
        others = total[inverse] - counts  # what other blocks add: mostly 0 for long n-grams, and packs well
        answers = [pack(others[cut[i]:cut[i + 1]]) for i in range(len(keys))]
        frame = pd.DataFrame({"block": own["block"].to_numpy(), "length": n, "bucket": own["bucket"].to_numpy(), "totals": answers})
        frame["kinds"], frame["sum"] = 0, 0
        frame.loc[0, ["kinds", "sum"]] = int(word.sum()), int(total[word].sum())
        out.append(frame)
    return pd.concat(out)


_ANSWER = "block bigint, length int, bucket bigint, totals binary, kinds bigint, sum bigint"


class Automaton:
    """States are contexts; ``arc[state, word]`` is the place of a weight and of the state it leads to."""

    def __init__(self, unigram: np.ndarray):
        self.weight: list[float] = unigram.tolist()  # of the root's arcs, one per word number
        self.words = len(unigram)
        self.into: list[int] = [0] * self.words
        self.arc: dict[int, int] = {}
        self.fail, self.backoff = [0], [0.0]

    def run(self, state: int, tokens: list[int]) -> float:
        """The log10 probability of ``tokens`` after ``state``."""
        arc, fail, backoff, weight, into, words = self.arc.get, self.fail, self.backoff, self.weight, self.into, self.words
        total = 0.0
        for token in tokens:
            while state:
                at = arc(state * words + token)
                if at is not None:
                    break
                total += backoff[state]
                state = fail[state]
            else:
                at = token
            total += weight[at]
            state = into[at]
        return total


def automaton(block: Block, grams: list[Gram], n_all: int, n_kinds: int) -> tuple[Automaton, int, np.ndarray]:
    """The part of the automaton that a block's texts can reach, the state after a begin mark, and by word
    number how often training texts have the word."""
    ones = grams[0]
    count = np.zeros(len(block.words), dtype=np.int64)
    count[block.tokens[ones.first]] = ones.total
    seen = np.where(np.arange(len(count)) == _BEGIN, 0, count)
    unigram = (seen + ADD) / (n_all + ADD * (n_kinds + 1)) if n_all else np.ones(len(count))
    auto = Automaton(np.log10(unigram))
    states: list[np.ndarray] = []  # per length: the state of each n-gram, 0 (the root) where it is none
    chance = unigram[block.tokens[ones.first]]
    for n, own in enumerate(grams, 1):
        last = block.tokens[own.first]
        seen = np.flatnonzero(own.total > 0)
        if n > 1:
            shorter, context = grams[n - 2], grams[n - 2].which[own.first - 1]
            suffix = shorter.which[own.first]
            chance = (own.total + K * chance[suffix]) / (shorter.total[context] + K)
        if n < len(grams):
            goes_on = seen[last[seen] != _END]
            fails = states[-1][suffix[goes_on]] if n > 1 else np.zeros(len(goes_on), dtype=np.int64)
            state = np.zeros(len(own.first), dtype=np.int64)
            state[goes_on] = len(auto.fail) + np.arange(len(goes_on))
            auto.fail += fails.tolist()
            auto.backoff += np.log10(K / (own.total[goes_on] + K)).tolist()
            states.append(state)
        if n == 1:
            target = np.zeros(len(count), dtype=np.int64)
            if states:
                target[last] = states[0]
            auto.into = target.tolist()
        else:
            source = states[n - 2][context[seen]] * auto.words + last[seen]
            into = states[n - 1][seen] if n < len(grams) else states[n - 2][suffix[seen]]
            auto.arc.update(zip(source.tolist(), range(len(auto.weight), len(auto.weight) + len(seen))))
            auto.weight += np.log10(chance[seen]).tolist()
            auto.into += into.tolist()
    return auto, auto.into[_BEGIN], count


_SCORE = "doc_id bigint, learn boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _scored(block: Block, grams: list[Gram], n_all: int, n_kinds: int) -> pd.DataFrame:
    auto, begin, count = automaton(block, grams, n_all, n_kinds)
    base = np.array(auto.weight[: auto.words])[block.tokens]
    known = (count > 0)[block.tokens]
    rows = []
    for doc, learn, start, stop in zip(block.doc_ids, block.learn.tolist(), block.start.tolist(), block.stop.tolist()):
        tokens = block.tokens[start + 1:stop]
        rows.append((
            doc, learn, len(tokens), int(known[start + 1:stop].sum()), float(base[start + 1:stop].sum()),
            auto.run(begin, tokens.tolist()),
        ))
    out = pd.DataFrame(rows, columns=["doc_id", "learn", "n_tokens", "n_known", "base_score", "score"])
    return out.astype({"doc_id": "Int64"})


def score(docs: DataFrame, learn: Column, order: int = ORDER) -> DataFrame:
    """``doc_id, learn, n_tokens, n_known, train_tokens, base_score, score`` of every row; rows for which
    ``learn`` holds are the training texts."""
    blocks = stash(
        docs.select("doc_id", F.coalesce(learn, F.lit(False)).alias("learn"), "text").mapInArrow(_blocks, _BLOCK),
        "lm-blocks",
    )
    tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    buckets = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-order * tokens // BUCKET_KEYS))
    bits = key_bits(tokens)
    asked = blocks.mapInArrow(lambda batches: _asked(batches, order, bits, buckets), _ASK)
    answers = stash(asked.groupBy("bucket").applyInPandas(_answered, _ANSWER), "lm-answers")
    sums = answers.agg(F.coalesce(F.sum("sum"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    n_all, n_kinds = sums["n"], sums["v"]

    def scored(own: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in own.to_dict("records"):
            block = Block.of(row)
            word, known = block.word_hashes(), []
            for n, (keys, count) in enumerate(block.counted(order, bits, word), 1):
                parts = totals[totals["length"] == n].sort_values("bucket")["totals"]
                known.append((keys, count + np.concatenate([np.zeros(0, "<u8"), *map(unpack, parts)]).astype(np.int64)))
            for part in block.slices():
                out.append(_scored(part, part.grams(order, bits, word, known), n_all, n_kinds))
        return pd.concat(out)

    both = blocks.groupBy("block").cogroup(answers.drop("kinds", "sum").groupBy("block"))
    return both.applyInPandas(scored, _SCORE).withColumn("train_tokens", F.lit(n_all).cast("bigint"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document; the fold with remainder 0 is held out."""
    return score(docs, fold("doc_id", 10) != 0).select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
