"""Token counts by greedy longest match in linear time.

The vocabulary becomes a trie. Each node also has a failure link and the number of tokens that are popped
when it is followed: where the trie has no arc for the next character, the longest piece at the front of
what was read is a token, and the rest is where the trie would stand had it begun after it. Both are worked out
once, shortest nodes first. A word is then read from left to right, every character once, and
its length in tokens is a sum of popped counts; no piece is ever built. Words are white-space
separated and begin with the vocabulary's word mark; a character with which no piece begins is one unknown token.
Tasks remember the lengths of words they have met (``CACHE`` at most, then they forget them).

Defined cases: null and empty texts have no words; a word of any length is read whole; repeated rows and
ties need no rule; extra columns are not touched."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CACHE = 500_000


def pieces_in(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in skip)]


class LongestMatch:
    """The automaton: node 0 is the root; arcs by (node, character)."""

    def __init__(self, pieces: list[str]):
        self.arc: dict[tuple[int, str], int] = {}
        ends, layers = [False], [[]]
        for piece in pieces:
            node = 0
            for depth, c in enumerate(piece):
                if (child := self.arc.get((node, c))) is None:
                    child = self.arc[node, c] = len(ends)
                    ends.append(False)
                    if depth == len(layers) - 1:
                        layers.append([])
                    layers[depth + 1].append((node, c, child))
                node = child
            ends[node] = True
        self.fail, self.popped = [0] * len(ends), [0] * len(ends)
        for layer in layers[1:]:
            for parent, c, node in layer:
                # a piece, or a lone first character that no piece equals (one unknown token)
                if ends[node] or parent == 0:
                    self.popped[node] = 1
                    continue
                popped, at = self.popped[parent], self.fail[parent]
                while at and (at, c) not in self.arc:
                    popped, at = popped + self.popped[at], self.fail[at]
                self.fail[node] = self.arc.get((at, c), 0)
                self.popped[node] = popped + ((at, c) not in self.arc)

    def count(self, word: str) -> int:
        """Tokens of a word."""
        arc, fail, popped, node, tokens = self.arc.get, self.fail, self.popped, 0, 0
        for c in word:
            while (ahead := arc((node, c))) is None and node:
                tokens += popped[node]
                node = fail[node]
            if ahead is None:
                tokens += 1
            else:
                node = ahead
        while node:
            tokens += popped[node]
            node = fail[node]
        return tokens


class Counter:
    def __init__(self, path: str):
        self.automaton, self.known = LongestMatch(pieces_in(path)), {}

    def count(self, text: str | None) -> tuple[int, int]:
        """Words and tokens of a text."""
        words = text.split() if text else []
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > CACHE:
                self.known.clear()
            for i, n in enumerate(found):
                if n is None:
                    found[i] = self.known[words[i]] = self.automaton.count(MARK + words[i])
        return len(words), sum(found)


_COUNTERS: dict[str, Counter] = {}
_KIND = "struct<n_words:bigint,n_tokens:bigint>"
_ARROW = pa.struct([("n_words", pa.int64()), ("n_tokens", pa.int64())])


def count_tokens(docs: DataFrame, out: str = "tokens", path: str | None = None) -> DataFrame:
    """``docs`` with a column ``out``: words and tokens of the text."""
    path = path or public_tokenizers.path(MODEL)

    def run(text: pa.Array) -> pa.Array:
        own = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path))
        return pa.array([dict(zip(("n_words", "n_tokens"), own.count(t))) for t in text.to_pylist()], _ARROW)

    return docs.withColumn(out, F.arrow_udf(run, _KIND)("text"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: words and tokens."""
    return count_tokens(docs.select("doc_id", "text"), "x").select("doc_id", "x.*")
