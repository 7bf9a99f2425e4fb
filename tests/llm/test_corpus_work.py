"""Resampling, the filter audit and packing."""

import math
import random
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberwatch.llm import filter_audit, library_ids, packing, resampling


# --- resampling ------------------------------------------------------------------------------------
def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")


def plain_draw(docs, target):
    def features(text):
        w = [x for x in plain_words(text) if x]
        return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    bucket = lambda f: crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    rows = []
    for i, (doc, text) in enumerate(docs):
        n, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, i])
    order = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(order[: 25 * len(order) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling(spark, make_docs, no_docs, odd_rows):
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choice(["Alpha", "beta", "été", "x-1", "Z"]) for _ in range(rnd.randrange(60)))) for i in range(90)]
    target = ["alpha beta alpha", None, "", "Z z z unseen"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    table = make_docs(docs + odd_rows).repartition(5)
    got = Counter(tuple(r) for r in resampling.report(table, bench).collect())
    assert got == plain_draw(docs + odd_rows, target)
    clash = table.withColumnsRenamed({"lang": "row", "source": "position"}).withColumn("score", table["n_chars"])
    assert Counter(tuple(r) for r in resampling.report(clash, bench).collect()) == got
    assert resampling.report(no_docs, bench).count() == 0
    assert resampling.report(make_docs(odd_rows), bench.where("false")).count() == len(odd_rows)


def test_features_are_runs_of_words():
    words = resampling.words_of("One, two-THREE ünd\x00four")
    assert words == [b"one", b"two", b"three", "ünd".encode(), b"four"]
    runs = [*words, *(b" ".join(words[i:i + 2]) for i in range(4)), *(b" ".join(words[i:i + 3]) for i in range(3))]
    assert resampling.buckets_of(words, 3, 997) == [crc32(r) % 997 for r in runs]


# --- filter audit ----------------------------------------------------------------------------------
def plain_audit(rows, labels):
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    parts = defaultdict(list)
    for doc, text, source in rows:
        text = text or ""
        w = text.translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ")
        w = [x for x in w if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": doc is not None and text in first and first[text] < doc,
        }
        good, toxic = (any(x[k] == 1 for x in labels if x[0] == doc and doc is not None) for k in (1, 2))
        parts[source or ""].append((fails, good, toxic))
    out, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                gone = lambda d: any(d[0][y] for y in order[: step - 1])  # noqa: B023, E731
                here = [d for d in docs if d[0][x] and not gone(d)]
                shapley[part, x] += len(here)
                out[part, order, step] = [
                    sum(not gone(d) and not d[0][x] for d in docs), len(here), sum(d[0][x] and gone(d) for d in docs),
                    sum(d[0][x] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in here), sum(d[2] for d in here),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, no_docs):
    rnd = random.Random(6)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [long, long, "word " * 300, "Word " * 300, long + " 50%", long.upper(), "short", "short", "AB #", None, "", " \x0b\x1c ", "a\x1cb " * 300]
    rows = [(i, rnd.choice(texts), rnd.choice(["web", "book", "", None])) for i in range(120)]
    rows += [(None, long, "web"), (None, "alone", "web"), (5, "twice", "book"), (5, "twice", "book"), (700, "twice", "lone"), (701, "x" * 200_000, "lone")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 120, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, words int, fails int").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.report(docs, marks).collect()}
    assert got == plain_audit(rows, labels)
    assert filter_audit.report(no_docs, marks).count() == 0
    assert filter_audit.report(docs, marks.where("false")).where("good_lost + toxic_lost > 0").count() == 0


@given(st.lists(st.integers(0, 10**12), min_size=32, max_size=32))
@settings(max_examples=30, deadline=None)
def test_potential_gives_shapley_values(counts):
    worth = filter_audit.worths(np.array(counts, dtype=np.int64))
    potential = filter_audit.potentials(worth)
    for i, name in enumerate("ABCDE"):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += int(worth[before | 1 << i] - worth[before])
        assert potential[31] - potential[31 ^ 1 << i] == total, name


# --- packing ---------------------------------------------------------------------------------------
def check_packing(rows, size):
    """Sequences are filled without gaps or overlaps."""
    found = defaultdict(list)
    for sequence, offset, length in rows:
        found[sequence].append((offset, length))
    for places in found.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(found)


def expand(runs, counts, size):
    rows = []
    for length, n in counts.items():
        own = runs[runs[:, 0] == length]
        for k in range(n):
            _, first, sequence, per, offset = own[np.searchsorted(own[:, 1], k, side="right") - 1]
            turn, slot = divmod(k - first, per)
            rows.append((sequence + turn, offset + slot * length, length))
    return check_packing(rows, size)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_piece(counts):
    runs = packing.plan(counts, 40)
    used = expand(runs, counts, 40)
    least = -(-sum(k * n for k, n in counts.items()) // 40)
    assert used >= least and (not counts or used <= 2 * least)


@pytest.mark.parametrize("counts, least", [({6: 4, 5: 4, 4: 4, 3: 0, 2: 2}, 7), ({7: 3, 3: 3}, 3), ({10: 5}, 5), ({3: 10, 4: 3}, 5), ({1: 25}, 3)])
def test_plan_is_tight_where_the_least_number_is_known(counts, least):
    counts = {k: n for k, n in counts.items() if n}
    assert expand(packing.plan(counts, 10), counts, 10) == least


def test_fullest_filling_is_the_best_there_is():
    rnd = random.Random(2)
    for _ in range(60):
        counts = {rnd.randint(2, 30): rnd.randint(1, 3) for _ in range(5)}
        slack = packing.Slack(sorted(counts), [counts[k] for k in sorted(counts)], 50)
        taken = {slack.lengths[i]: n for i, n in slack.fullest().items()}
        longest = max(counts)
        sums = {longest}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + (k != longest))}
        assert taken[longest] >= 1 and all(n <= counts[k] for k, n in taken.items())
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= 50)


def test_packing(make_docs, no_docs, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice(["alpha", "Beta's", "12,5", "naïve"]) for _ in range(rnd.randrange(900)))) for i in range(60)]
    docs += [*odd_rows, (70, "a <|endoftext|> b"), (71, "A B c\x1cd é ́f Σας ΟΔΟΣ")]
    got = packing.report(make_docs(docs).repartition(3)).collect()
    want = Counter()
    for doc, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start:start + 4096]
            want[doc, piece, start, len(own), crc32(own.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    used = check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in got], 4096)
    assert used == -(-sum(r["length"] for r in got) // 4096)
    assert packing.report(no_docs).count() == 0


@pytest.mark.parametrize("file, cut", [("word_bpe_49k.json", "between_blanks"), ("byte_bpe_50k.json", "before_blanks")])
def test_chunks_and_whole_texts_have_the_same_ids(monkeypatch, file, cut):
    import pyarrow as pa

    monkeypatch.setattr(library_ids, "SLICE", 400)
    monkeypatch.setattr(library_ids, "CACHE", 300)
    own = library_ids.ChunkEncoder(public_tokenizers.path(file), getattr(library_ids, cut))
    rnd = random.Random(1)
    signs = [*"abSTH '.,;!=*1é\u0301\u0331\u0338\t\n\r\x0b\x1c\x85\xa0\u2003\u3000\u200bﬁΣİ٣😀日", "  ", "'s", "'LL", "\n\n", "word", "<|endoftext|>"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["a\0b c", "\0", "x <|ENDOFTEXT|> y", "Z" * 9000]
    assert [x.tolist() for x in own.encode(pa.array([*texts, None]))] == [x.tolist() for x in own.whole([*texts, ""])]
