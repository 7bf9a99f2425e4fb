"""Decontamination, personal data, toxicity and language."""

import hashlib
import random
import re

import numpy as np
import pytest

from emberwatch.llm import decontaminate, language, pii, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_hits(docs, items, window=10):
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for item, item_text in items:
            w = words(item_text)
            size = min(window, len(w))
            wins = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()
            for i in range(len(own) - size + 1) if w else ():
                if tuple(own[i:i + size]) in wins:
                    hit.update(range(i, i + size))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_hits_equal_brute_force(spark, make_docs, block_words, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice(["a", "b", "Ü9", "c"]) for _ in range(n))
    items = [(i, text(rnd.choice([0, 1, 2, 9, 10, 11, 25]))) for i in range(12)] + [(99, None), (100, "-- !")]
    docs = [(i, text(rnd.randrange(80))) for i in range(60)] + [(70, None), (71, ""), (71, "")]
    docs += [(80, "x " + items[5][1] + " y"), (None, items[3][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate.with_hits, "__defaults__", ("hits", 10, block_words))
    got = sorted(map(tuple, decontaminate.report(make_docs(docs).repartition(3), benchmark).collect()), key=repr)
    assert got == brute_hits(docs, items)


def test_items_without_an_id_count(spark, make_docs):
    passage = " ".join(f"p{i}" for i in range(12))
    benchmark = spark.createDataFrame([(None, passage), (7, "p1 p2")], "item_id bigint, text string")
    docs = make_docs([(1, "start " + passage + " end"), (2, "clean text"), (3, "p1 p2")])
    digest = hashlib.sha256(b"7").hexdigest()
    got = {r[0]: tuple(r)[1:] for r in decontaminate.report(docs, benchmark).collect()}
    assert got[1] == (14, 12, 2, digest, True) and got[3] == (2, 2, 1, digest, True) and got[2][-1] is False
    only = benchmark.where("item_id is null")
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, only).orderBy("doc_id").collect()] == [2, 3]


def test_longest_matches_and_removal(spark, make_docs):
    passage = " ".join(f"p{i}" for i in range(25))
    benchmark = spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string")
    docs = make_docs([(1, "start " + passage + " end"), (2, "clean text"), (3, " ".join(passage.split()[5:16])), (4, None)])
    got = sorted(map(tuple, decontaminate.matches(docs, benchmark).collect()))
    assert got == [(1, "1", 1, 0, 25), (3, "1", 0, 5, 11)]
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4]
    empty = benchmark.where("false")
    assert decontaminate.decontaminate(docs, empty).count() == 4


def test_base_spans_equal_the_patterns():
    rnd = random.Random(7)
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def fits(kind, s):
        digits = re.sub("[^0-9]", "", s)
        return {
            "email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else False,
            "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15,
        }[kind]

    for _ in range(5_000):
        text = "".join(rnd.choice("ab.@-+ 0123 45()") for _ in range(50))
        want = [(m.start(), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, text) if fits(k, m[0])]
        assert pii.base_spans(text) == pii.in_order(want)
    assert [pii.luhn(s) for s in ("4111111111111111", "4111111111111112")] == [True, False]


def test_dynamic_program_finds_the_best_choice():
    rnd = random.Random(2)
    for _ in range(200):
        group = []
        for _ in range(7):
            a = rnd.randrange(8)
            group.append(pii.Candidate(a, a + rnd.randrange(1, 5), rnd.choice(pii.KINDS), [str(rnd.random())]))
        field = pii.Field({f"{c.kind} {c.features[0]}": rnd.uniform(-1, 2) for c in group})
        best = 0.0
        for bits in range(1 << len(group)):
            pick = sorted((c for i, c in enumerate(group) if bits >> i & 1), key=lambda c: c.start)
            if all(a.stop <= b.start for a, b in zip(pick, pick[1:])):
                best = max(best, sum(map(field.score, pick)))
        chosen = set(field.best(group))
        assert sum(max(field.score(c) for c in group if (c.start, c.stop, c.kind) == s) for s in chosen) == pytest.approx(best)
        total, chance = pii._expected(group, np.array([field.score(c) for c in group]))
        assert (chance >= -1e-9).all() and (chance <= 1 + 1e-9).all()


@pytest.fixture(scope="module")
def pii_docs(make_docs):
    rnd, rows = random.Random(4), []
    for i in range(240):
        card = next(c for c in iter(lambda: "4" + "".join(rnd.choice("0123456789") for _ in range(15)), "") if pii.luhn(c))
        rows.append((i, f"zor bim u{i}.k@mail{i % 9}.example.org fen +1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)} "
                        f"lab {rnd.randrange(1, 255)}.{rnd.randrange(255)}.4.{rnd.randrange(255)} dok {card} in 19{i % 90 + 10} or 12,{i % 900 + 100},000"))
    return make_docs(rows)


@pytest.mark.parametrize("text", [
    "joe at example [dot] com", "joe at mail (dot) example (dot) org", "joe at example.com", "joe AT example dot com",
    "joe [at] example.com", "joe( at )example dot com", "joe{ AT}example.com", "no address at all",
])
def test_candidates_do_not_depend_on_far_text(text):
    own = [(c.start, c.stop, c.kind) for c in pii.candidates(text)]
    more = [(c.start, c.stop, c.kind) for c in pii.candidates(text + ". Then, far away, @ and no more")]
    assert own == [c for c in more if c[1] <= len(text)] and bool(own) == text.startswith("joe")


@pytest.mark.parametrize("size", [1, 64, 65, 5_000])
def test_long_names_are_not_cut(size):
    name = "n" * size
    found = [c for c in pii.candidates(f"write to {name} at mail dot org, {name}(at)mail.org") if c.kind == "email"]
    assert {c.start for c in found} == {9, 9 + size + len(" at mail dot org, ")}


def test_field_adds_what_the_patterns_miss(pii_docs, odd_docs, no_docs):
    model = pii.train(pii_docs)
    found = lambda t: [(t[a:b], k) for a, b, k in pii.all_spans(t, model)[1]]
    assert ("u7 at mail3 dot example dot org", "email") in found("zor u7 at mail3 dot example dot org fen")
    assert ("(736) 555-2678", "phone") in found("fen (736) 555-2678 lab")
    assert found("bim in 1987 or 12,345,000 and 3.5 or 2001-2005 at the dot") == []
    for text, (base, every) in ((r["text"], pii.all_spans(r["text"], model)) for r in pii_docs.limit(20).collect()):
        assert set(base) <= set(every) and len(base) == 4, text
    assert pii.report(odd_docs).count() == odd_docs.count() and pii.report(no_docs).count() == 0
    clean = pii.redact(pii_docs, model).first()
    assert "[EMAIL]" in clean["text"] and "555" not in clean["text"] and clean["n_chars"] == len(clean["text"])
    assert pii.redacted("ab+1 cd", [(0, 2, "ip"), (1, 4, "phone")]) == "[IP] cd"


def test_toxicity_learns_and_answers_odd_rows(spark, make_docs, odd_docs, no_docs):
    rnd = random.Random(5)
    text = lambda bad: " ".join([rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(40)] + ["grumblewort"] * bad)
    rows = [(i, text(i % 5 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(7, None), (None, 1)], "doc_id bigint, toxic int")
    docs = make_docs(rows)
    got = toxicity.report(docs, labels).collect()
    assert len(got) == 400 and all((r["predicted"] == 1) == (r["doc_id"] % 5 == 0) for r in got if r["held_out"])
    model = toxicity.train(docs, labels)
    assert toxicity.score(odd_docs, model).where("score is null or score < 0 or score > 1").count() == 0
    kept = toxicity.remove_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id % 5 = 0").count() == 0 and kept.count() == 320
    flat = toxicity.train(docs, labels.where("toxic = 0"))
    assert {round(r["score"], 9) for r in toxicity.score(odd_docs, flat).collect()} == {round(1 / 322, 9)}
    assert toxicity.report(no_docs, labels).count() == 0


def test_language(spark, make_docs, odd_docs, no_docs):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    parts = {"aa": ["kal", "mor", "tin"], "bb": ["schu", "wer", "gel"], "cc": ["éau", "que", "lle"]}
    rnd = random.Random(6)
    rows = [(i, " ".join("".join(rnd.choice(parts[k]) for _ in range(3)) for _ in range(30)), k, None, 0) for i, k in enumerate(list(parts) * 60)]
    docs = spark.createDataFrame(rows, kind)
    got = {r["doc_id"]: r for r in language.report(docs).collect()}
    assert all(got[i]["lang_pred"] == k and got[i]["score"] > 0.8 for i, _, k, *_ in rows if got[i]["held_out"])
    model = language.train(docs)
    odd = language.identify(odd_docs, model).collect()
    assert {r["language"]["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3, 9)} == {"und"}
    assert language.report(no_docs).count() == 0
    assert language.train(no_docs).decide("text") == ("und", 0.0)


def test_filter_answers_every_language_that_was_put_in():
    rnd = np.random.default_rng(1)
    names = [f"l{i:03d}" for i in range(130)]  # more languages than one word has bits
    words_ = np.zeros((3, 1 << 12), dtype=np.uint64)
    own = {i: rnd.integers(1, 1 << 60, 20) for i in range(130)}
    for i, grams in own.items():
        for cell in language.cells_of(grams, 1 << 12):
            np.bitwise_or.at(words_[i // language.WORD_BITS], cell, np.uint64(1 << i % language.WORD_BITS))
    model = language.Filter(names, words_)
    for i, grams in own.items():
        at = language.cells_of(grams, 1 << 12)
        mask = words_[i // language.WORD_BITS]
        assert all((mask[a] & mask[b] & mask[c]) >> np.uint64(i % language.WORD_BITS) & np.uint64(1) for a, b, c in zip(*at))
    assert model.false_rate.shape == (130,) and (model.false_rate < 1e-3).all()
