import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from emberwatch.llm import bpe, token_files, word_pieces

PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = st.text(alphabet="ab the'sé日 \n\t.,01!", max_size=60)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_encodes_as_the_library(library, text):
    own = bpe.encoder(PATH)
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@given(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 5), st.binary(max_size=6), st.binary(max_size=6))
@settings(max_examples=300, deadline=None)
def test_appends_and_edits_equal_a_fresh_table(data, start, size, new, more):
    vocabulary = bpe.encoder(PATH).vocabulary
    start, stop = min(start, len(data)), min(start + size, len(data))
    table = bpe.Prefixes(vocabulary, data)
    table.replace(start, stop, new)
    table.append(more)
    assert table.last == bpe.Prefixes(vocabulary, data[:start] + new + data[stop:] + more).last


def test_edit_refills_a_few_entries_only():
    table = bpe.Prefixes(bpe.encoder(PATH).vocabulary, b"the quick brown fox jumps over the lazy dog " * 100)
    assert table.replace(5, 6, b"x") < 400


def test_report_of_odd_rows(odd_docs, no_docs, library):
    rows = bpe.report(odd_docs).collect()
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in odd_docs.collect())
    for (doc, text), row in zip(texts, sorted(rows, key=lambda r: (r["doc_id"] or 0))):
        ids = library.encode_ordinary(text)
        assert row["n_tokens"] == len(ids), doc
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.report(no_docs).count() == 0


def test_ids_and_back(odd_docs):
    rows = bpe.decode(bpe.encode(odd_docs.select("text"))).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows)


def test_added_tokens_in_a_text_are_the_library_s():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.TOKENIZER)
    library = Tokenizer.from_file(path)
    texts = ["one two", "<|endoftext|>", "end of one.<|endoftext|> Next  text <|endoftext|>\n", "<|endoftext|", None, "two <|endoftext|> one"]
    got = [x.tolist() for x in token_files.LibraryEncoder(path).encode(pa.array(texts))]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_store(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    folder = token_files.write_store(odd_docs.repartition(3), part_bytes=50_000)
    rows = token_files.read_store(spark, folder).orderBy("start").collect()
    given_rows = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in rows] == [r[0] for r in given_rows]
    place = 0
    for row, (_, text) in zip(rows, given_rows):
        want = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert row["start"] == place and np.frombuffer(row["ids"], "<u4").tolist() == want
        place += len(want)
    manifest = spark.read.parquet(f"{folder}/manifest").orderBy("part").collect()
    assert [m["base"] for m in manifest] == [sum(x["n_ids"] for x in manifest[:i]) for i in range(len(manifest))]
    assert {m["width"] for m in manifest} == {2}
    assert token_files.report(no_docs).count() == 0


@given(st.lists(st.text(alphabet="abc▁", min_size=1, max_size=5), min_size=1, max_size=12), st.text(alphabet="abcd▁", max_size=30))
@settings(max_examples=400, deadline=None)
def test_longest_match_counts(pieces, word):
    at = brute = 0
    while at < len(word):
        at += max((len(p) for p in pieces if word.startswith(p, at)), default=1)
        brute += 1
    assert word_pieces.LongestMatch(pieces).count(word) == brute


def test_word_pieces_of_odd_rows(odd_docs, no_docs):
    pieces = set(word_pieces.pieces_in(public_tokenizers.path(word_pieces.MODEL)))
    longest = max(map(len, pieces))

    def count(word):
        at = n = 0
        while at < len(word):
            size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at:at + k] in pieces), 1)
            at, n = at + size, n + 1
        return n

    for row in word_pieces.count_tokens(odd_docs).collect():
        words = (row["text"] or "").split()
        assert row["tokens"]["n_words"] == len(words)
        known = {w: count(word_pieces.MARK + w) for w in set(words)}
        assert row["tokens"]["n_tokens"] == sum(known[w] for w in words)
    assert word_pieces.report(no_docs).count() == 0
