"""Token ids of the tokenizers library, for many texts at a time.

Texts repeat their words, so a batch is cut into chunks that the tokenizer treats each for itself. Arrow cuts and numbers
the distinct chunks; only chunks that the task has not met are given to the library, many in one text with an added token
between them: the library cuts there before anything else, and no other text has that token's id. Ids are
put together with numpy. No Python code runs per word of a text."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 400_000  # chunks remembered by a task, about 200 bytes each
SLICE = 8 << 20  # bytes of text that are cut at once, one text at least
_JOINED = 64  # chunks given to the library in one text
_SPACE = "\\x00-\\x20\\x7f-\\xa0\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{206f}\\x{3000}\\x{feff}"  # all white space, and more
_WORD_END = "([A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{17f}])([.,;:!?])"  # a word ends before the mark, whatever follows


class ChunkEncoder:
    """``cut`` makes the chunks of every text (a list array) so that ids of a text are those of its chunks in order."""

    def __init__(self, path: str, cut: Callable[[pa.Array], pa.ListArray]):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))  # tokens wherever their string stands
        self.between = next(iter(added.items()), None)
        self.cut = cut
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.uint32)
        self.stop = np.zeros(1, dtype=np.int64)
        self.used = np.zeros(0, dtype=np.int64)  # by chunk, how many slices had it since the last tidying

    def _gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some chunks and where each chunk's begin and end."""
        size = self.stop[slot + 1] - self.stop[slot]
        stop = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.stop[slot] - stop[:-1], size) + np.arange(stop[-1])], stop

    def _tidy(self) -> None:
        """Forget the chunks that only one slice had; all, if that is not enough."""
        kept = np.flatnonzero(self.used > 1)
        if 2 * len(kept) > CACHE:
            kept = kept[:0]
        names = list(self.known)  # in order of their numbers
        self.known = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.ids, self.stop = self._gather(kept)
        self.used = np.zeros(len(kept), dtype=np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(c.ids, dtype=np.uint32) for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks and their number in each; no chunk holds an added token."""
        if self.between is None:
            ids = self.whole(chunks)
            return np.concatenate(ids), np.array(list(map(len, ids)))
        mark, number = self.between
        joined = [mark.join(chunks[lo:lo + _JOINED]) + mark for lo in range(0, len(chunks), _JOINED)]
        ids = np.concatenate(self.whole(joined))
        own = ids != number
        return ids[own], np.diff(np.cumsum(own)[~own], prepend=0)

    def _slots(self, chunks: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self._tidy()
        found = list(map(self.known.get, chunks))
        if None in found:
            new = [c for c, slot in zip(chunks, found) if slot is None]
            ids, size = self._apart(new)
            self.known.update(zip(new, range(len(self.stop) - 1, len(self.stop) - 1 + len(new))))
            self.ids = np.concatenate([self.ids, ids])
            self.stop = np.concatenate([self.stop, self.stop[-1] + np.cumsum(size)])
            self.used = np.concatenate([self.used, np.zeros(len(new), dtype=np.int64)])
            found = list(map(self.known.__getitem__, chunks))
        slots = np.array(found, dtype=np.int64)
        self.used[slots] += 1
        return slots

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        special = pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False) if self.added else None
        some = special is not None and special.any()
        cut = self.cut(pc.if_else(pa.array(special), pa.scalar(""), texts) if some else texts)
        coded = cut.flatten().dictionary_encode()
        slot = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids, stop = self._gather(slot)
        bound = stop[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        out = [ids[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
        if some:
            for i in np.flatnonzero(special).tolist():
                out[i] = self.whole([texts[i].as_py()])[0]
        return out

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text (null: none), in order."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + SLICE, side="right")))
            yield from self._slice(texts.slice(at, end - at))
            at = end


def between_blanks(texts: pa.Array) -> pa.ListArray:
    """Chunks between ASCII white space and before the mark that ends a word, for tokenizers that drop white space and case.
    ASCII letters become small where no combining mark could meet them."""
    marks = pc.match_substring_regex(texts, r"\p{M}")
    texts = pc.if_else(marks, texts, pc.ascii_lower(texts))
    return pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _WORD_END, r"\1 \2"))


def before_blanks(texts: pa.Array) -> pa.ListArray:
    """Chunks that begin with a blank or line end before another character, or with the mark that ends a word, for
    byte-level tokenizers: no match of their pattern crosses such a place. A text with a null character is one chunk."""
    odd = pc.match_substring(texts, "\0")
    marked = pc.replace_substring_regex(texts, f"([ \n][^{_SPACE}])", "\0\\1")
    marked = pc.replace_substring_regex(marked, _WORD_END, "\\1\0\\2")
    if not pc.any(odd).as_py():
        return pc.split_pattern(marked, "\0")
    cut = pc.split_pattern(marked, "\0").to_pylist()
    return pa.array(
        [[t] if own else c for t, c, own in zip(texts.to_pylist(), cut, odd.to_pylist())], pa.large_list(pa.large_string())
    )
