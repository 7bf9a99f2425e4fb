"""Language identification with n-gram filters whose cells are language bitmasks.

The filter is a Bloom filter cut into bit slices: a cell holds one bit per language, so one look-up in
``HASHES`` cells and a bitwise AND give all languages that have an n-gram. A text's n-grams (three characters,
lower case, letters only, words set off by blanks) are looked up, the bits are counted per language, and the count is
corrected for the filter's false positives, whose rate is the share of a language's bits that are set, to
the power of ``HASHES``. The language with the highest corrected share of n-grams wins; that share is the
score.

An n-gram belongs to a language if its frequency there is at least ``RELATIVE`` times its
frequency in the language that uses it most; names, quotations and wrong labels do not spread it to all. The
counts cover all training rows and are summed by Spark; the filter has at most ``CELLS`` rows per 62
languages, whatever the corpus, and only it reaches the driver.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; equal scores go to
the language that comes first by name; rows with a null text or language teach nothing; nothing learned means
``und`` for all; a text whose n-grams are all unknown gets score 0 and the first language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import fold, stash

CELLS = 1 << 20
HASHES = 3
RELATIVE = 0.05
WORD_BITS = 62  # languages per slice word
_STEP = 1 << 18  # characters handled at once
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Is a code point a letter?"""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """The three-character n-grams of a text as numbers, in parts of bounded length."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype="<u4")
    for lo in range(0, len(codes), _STEP):
        part = codes[max(0, lo - 2):lo + _STEP]
        letter = _letters()[part]
        if not letter.any():
            continue
        after = np.concatenate([[False], letter[:-1]])
        kept = np.concatenate([[32], np.where(letter, part, 32)[letter | after], [32]]).astype(np.int64)
        grams = kept[:-2] << 42 | kept[1:-1] << 21 | kept[2:]
        yield grams[kept[1:-1] != 32]  # the middle is a letter


def cells_of(grams: np.ndarray, cells: int = CELLS) -> list[np.ndarray]:
    shift = np.uint64(64 - (cells.bit_length() - 1))
    own = grams.astype(np.uint64)
    return [((own ^ own >> np.uint64(29)) * mix >> shift).astype(np.int64) for mix in _MIX[:HASHES]]


@dataclass
class Filter:
    languages: list[str]
    words: np.ndarray  # (slice words, cells)

    def __post_init__(self):
        bits = [
            np.count_nonzero(self.words[i // WORD_BITS] >> np.uint64(i % WORD_BITS) & np.uint64(1))
            for i in range(len(self.languages))
        ]
        self.false_rate = (np.array(bits) / self.words.shape[1]) ** HASHES

    def shares(self, text: str | None) -> np.ndarray | None:
        """Corrected share of n-grams per language; None if the text has no letter."""
        hits, total = np.zeros((len(self.words), 64), dtype=np.int64), 0
        for grams in ngrams(text):
            at = cells_of(grams, self.words.shape[1])
            total += len(grams)
            for i, word in enumerate(self.words):
                mask = word[at[0]]
                for cell in at[1:]:
                    mask &= word[cell]
                octets = mask.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
                hits[i] += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
        if not total:
            return None
        own = hits[:, :WORD_BITS].reshape(-1)[: len(self.languages)] / total
        return np.clip((own - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)

    def decide(self, text: str | None) -> tuple[str, float]:
        shares = self.shares(text) if self.languages else None
        if shares is None:
            return "und", 0.0
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def settle(lang: str) -> None:
        keys, counts = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        size[lang] = 0
        own = total.setdefault(lang, [])
        own.append((keys, counts))
        if len(own) > 8:
            total[lang] = [_summed(own)]

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            for grams in ngrams(text):
                waiting.setdefault(lang, []).append(grams)
                size[lang] = size.get(lang, 0) + len(grams)
                if size[lang] > 4 * _STEP:
                    settle(lang)
    for lang in list(waiting):
        settle(lang)
    for lang, own in total.items():
        keys, counts = _summed(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)


def train(docs: DataFrame, wanted: Column | None = None, cells: int = CELLS) -> Filter:
    """Learn a filter from ``text`` and ``lang`` of the rows for which ``wanted`` holds."""
    rows = docs.where("text is not null and lang is not null")
    rows = rows if wanted is None else rows.where(wanted)
    counts = stash(
        rows.select("text", "lang").mapInArrow(_counted, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "language-counts",
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r["lang"] for r in totals.select("lang").collect())  # a row per language
    number = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1 if languages else F.lit(0)
    share = counts.join(F.broadcast(totals), "lang").select("gram", number.alias("i"), (F.col("n") / F.col("total")).alias("share"))
    best = share.groupBy("gram").agg(F.max("share").alias("best"), F.collect_list(F.struct("i", "share")).alias("all"))
    owned = best.select("gram", "best", F.explode("all").alias("x")).where(F.col("x.share") >= RELATIVE * F.col("best"))
    marks = owned.select(
        "gram", F.expr(f"CAST(x.i DIV {WORD_BITS} AS int)").alias("word"),
        F.expr(f"shiftleft(1L, CAST(x.i % {WORD_BITS} AS int))").alias("mask"),
    ).groupBy("gram", "word").agg(F.bit_or("mask").alias("mask"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cells_of(batch.column("gram").to_numpy(), cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(at)), pa.concat_arrays([batch.column("word")] * HASHES), pa.concat_arrays([batch.column("mask")] * HASHES)],
                ["cell", "word", "mask"],
            )

    got = (
        marks.mapInArrow(placed, "cell bigint, word int, mask bigint")
        .groupBy("cell", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most ``cells`` rows per word
    )
    words = np.zeros((max(1, -(-len(languages) // WORD_BITS)), cells), dtype=np.uint64)
    words[got["word"].to_numpy(), got["cell"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return Filter(languages, words)


_KIND = "struct<lang_pred:string,score:double>"
_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: Filter, out: str = "language") -> DataFrame:
    """``docs`` with a column ``out``: the language and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("lang_pred", "score"), shared.value.decide(t))) for t in text.to_pylist()], _ARROW)

    return docs.withColumn(out, F.arrow_udf(run, _KIND)("text"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: is it held out, its language, the score."""
    model = train(docs, fold("doc_id", 3) != 1)
    return identify(docs.select("doc_id", "text"), model, "x").select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "x.lang_pred", "x.score"
    )
