"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string has one encoding, and that encoding is the encoding of a shorter prefix and
one last token. The table of last tokens therefore is the whole result: ``Prefixes.last[i]`` is the last
token of the first ``i`` bytes. Among the tokens that end at a byte, the valid one is the one that BPE
would leave standing beside the last token before it; undoing merges along the seam decides that, without
encoding anything again. Appending bytes extends the table. An edit refills it from the edit on and stops
as soon as it agrees with the old table over the length of the longest token, because from there on equal
bytes give equal entries.

A text is cut where a single blank stands between two other characters, and around a single line end; no
match of the splitting pattern crosses such a place, so each piece can be matched and encoded on its own.
Tasks remember the pieces and prefixes they have met (``CACHE`` at most, then they forget them), because
texts repeat them; in this shared table an entry is filled when it is first asked for.

Defined cases: null and empty texts have no tokens and decode to nothing; every byte string can be
encoded; repeated rows and ties need no rule; extra columns are not touched."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
CACHE = 400_000
SHARED = 32  # bytes of the longest match that is looked up in the shared table of prefixes

_CUT = regex.compile(r"(?<=\S) (?=\S)")


def parts_of(text: str) -> list[tuple[list[str], list[str]]]:
    """The pieces of a text in order, as runs of pieces without and then with a blank before them."""
    if not text:
        return []
    if text.replace("\n", " ") == " ".join(text.split()):
        lines = [line.split(" ") for line in text.split("\n")]  # single blanks and single line ends, which are matches
    else:
        lines = [_CUT.split(text)]
    return [(line[:1] if i == 0 else ["\n", line[0]], line[1:]) for i, line in enumerate(lines)]


def encode_pieces(text: str, heads: dict, rest: dict, fill: Callable) -> list:
    """What ``heads`` (pieces without) and ``rest`` (pieces with a blank before them) hold for the pieces of a
    text, in order; ``fill`` completes the missing ones."""
    out: list = []
    for first, tail in parts_of(text):
        for known, pieces, blank in ((heads, first, ""), (rest, tail, " ")):
            found = list(map(known.get, pieces))
            if None in found:
                fill(known, pieces, found, blank)
            out += found
    return out


class Vocabulary:
    """Ranks, how each token was merged, and the tokens that end at a byte."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.bytes[rank] = token
        self.size = list(map(len, self.bytes))
        self.longest = max(self.size)
        self.halves = [(r, r) for r in range(len(self.bytes))]  # a byte is its own half
        self.merged: dict[tuple[int, int], int] = {}
        self.seams: dict[int, bool] = {}  # seams judged so far; texts meet the same ones again and again
        for rank, token in enumerate(self.bytes):  # smaller ranks first: their halves are known by then
            if len(token) > 1:
                parts = Prefixes(self, token, below=rank).tokens()
                if len(parts) == 2:
                    self.halves[rank] = (parts[0], parts[1])
                    self.merged[parts[0], parts[1]] = rank
                    self.seams.pop(parts[0] << 32 | parts[1], None)
        self.seams.clear()

    def stands(self, left: int, right: int) -> bool:
        """Would BPE leave this seam open?"""
        seam = left << 32 | right
        if (open_ := self.seams.get(seam)) is None:
            if len(self.seams) > CACHE:
                self.seams.clear()
            open_ = self.seams[seam] = self._stands(left, right)
        return open_

    def _stands(self, left: int, right: int) -> bool:
        """Take the later merge beside the seam apart, step by step: no pair met at the seam may have been
        due before the merge that hides it."""
        halves, due = self.halves, len(self.bytes)
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < due:
                return False
            left_half, right_half = halves[left][1], halves[right][0]
            left_ends, right_ends = left_half == left, right_half == right
            if left_ends and right_ends:
                return True
            if right_ends or (left > right and not left_ends):
                due, left = left, left_half
            else:
                due, right = right + 1, right_half


class Prefixes:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"", below: int | None = None):
        self.vocabulary, self.data, self.last, self.below = vocabulary, b"", [-1], below
        self.append(data)

    def _fill(self, end: int) -> int:
        """The last token of the first ``end`` bytes."""
        get, data, last, vocabulary = self.vocabulary.rank.get, self.data, self.last, self.vocabulary
        judged = vocabulary.seams.get
        for start in range(max(0, end - vocabulary.longest), end):  # a longer token is met first
            token = get(data[start:end])
            if token is None or (self.below is not None and token >= self.below):
                continue
            if start == 0:
                return token
            left = last[start]
            open_ = judged(left << 32 | token)
            if open_ if open_ is not None else vocabulary.stands(left, token):
                return token
        raise ValueError("a byte has no token")

    def append(self, data: bytes) -> None:
        start, self.data = len(self.data), self.data + data
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._fill(end))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of ``start..stop``; returns how many entries had to be filled."""
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[: start + 1]
        same, end = 0, start
        while end < len(self.data) and same < self.vocabulary.longest:
            end += 1
            self.last.append(self._fill(end))
            agrees = end > start + len(data) and old[end - shift] == self.last[-1]
            same = same + 1 if agrees else 0
        self.last += old[end - shift + 1:] if end < len(self.data) else []
        return end - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes[self.last[end]])
        return out[::-1]


class Encoder:
    """Encodes texts piece by piece and remembers the pieces."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, cache: int = CACHE):
        self.vocabulary, self.pattern, self.cache = Vocabulary(path), regex.compile(pattern), cache
        self.prefixes: dict[bytes, int] = {}  # last tokens of the prefixes asked for, shared by all words
        self.heads: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    def _last(self, prefix: bytes) -> int:
        """The table entry of a short prefix; shorter ones are looked at only where a seam needs them."""
        token = self.prefixes.get(prefix)
        if token is None:
            get, stands = self.vocabulary.rank.get, self.vocabulary.stands
            for start in range(len(prefix)):
                token = get(prefix[start:])
                if token is not None and (start == 0 or stands(self._last(prefix[:start]), token)):
                    break
            self.prefixes[prefix] = token
        return token

    def word(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if len(data) > SHARED:
            return Prefixes(self.vocabulary, data).tokens()
        out, size = [], self.vocabulary.size
        while data:
            out.append(token := self._last(data))
            data = data[:-size[token]]
        return out[::-1]

    def piece(self, text: str) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        ids: list[int] = []
        for match in self.pattern.findall(text):
            ids += self.word(match.encode("utf-8"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _fill(self, known: dict[str, bytes], pieces: list[str], found: list[bytes | None], blank: str) -> None:
        for cache in (self.heads, self.rest, self.prefixes):
            if len(cache) > self.cache:
                cache.clear()
        for i, ids in enumerate(found):
            if ids is None:
                if (ids := known.get(pieces[i])) is None:
                    ids = known[pieces[i]] = self.piece(blank + pieces[i])
                found[i] = ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        return b"".join(encode_pieces(text, self.heads, self.rest, self._fill))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python process; building it takes about a second."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _column(path: str, of: Callable[[Encoder, str | None], object], kind: str):
    def run(text: pa.Array) -> pa.Array:
        own = encoder(path)
        return pa.array([of(own, t) for t in text.to_pylist()], type=_ARROW[kind])

    return F.arrow_udf(run, kind)


_REPORT = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"
_ARROW = {
    "binary": pa.binary(),
    _REPORT: pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
}


def encode(docs: DataFrame, out: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with its ids as a binary column of little-endian 32-bit integers."""
    path = path or public_tokenizers.path(RANKS)
    return docs.withColumn(out, _column(path, lambda e, t: e.encode(t or ""), "binary")("text"))


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``docs`` with the bytes that a column of ids stands for (null: none)."""
    path = path or public_tokenizers.path(RANKS)

    def run(column: pa.Array) -> pa.Array:
        own = encoder(path)
        return pa.array([own.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in column.to_pylist()], type=pa.binary())

    return docs.withColumn(out, F.arrow_udf(run, "binary")(ids))


def _report(own: Encoder, text: str | None) -> dict:
    ids = own.encode(text or "")
    back = own.decode(np.frombuffer(ids, "<u4").tolist())
    return {
        "n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(),
        "decoded_sha256": hashlib.sha256(back).hexdigest(),
    }


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: number of ids, digest of the ids and of what they decode to."""
    path = path or public_tokenizers.path(RANKS)
    return docs.select("doc_id", _column(path, _report, _REPORT)("text").alias("r")).select("doc_id", "r.*")
