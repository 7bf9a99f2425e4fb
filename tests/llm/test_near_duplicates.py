"""SimHash, embeddings, the language model and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from emberwatch.llm import embedding_dedup, language_model, simhash


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \t", "One two", "a b c d e f g", "A b C d " * 500):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("leaves", [1, 2, 7])
def test_routes_and_leaves_lose_no_pair(leaves, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    rnd = np.random.default_rng(leaves)
    seeds = rnd.integers(0, 1 << 63, 150, dtype=np.uint64)
    flips = [seeds]
    for k in range(1, 7):
        mask = np.zeros(len(seeds), dtype=np.uint64)
        for _ in range(k):
            mask |= np.uint64(1) << rnd.integers(0, 64, len(seeds)).astype(np.uint64)
        flips.append(seeds ^ mask)
    points = np.unique(np.concatenate(flips))
    close = [(i, j) for i in range(len(points)) for j in np.flatnonzero(simhash.distances(points, points[i]) <= 4).tolist() if i < j]
    tree = simhash.top_tree(points[::3], leaves)
    parts = defaultdict(lambda: [[], []])
    every = np.arange(len(points))
    for leaf, at, home in simhash.route(tree, points, every, np.ones(len(points), dtype=bool), 4):
        parts[leaf][0].append(at)
        parts[leaf][1].append(home)
    assert sum(int(np.concatenate(h).sum()) for _, h in parts.values()) == len(points)  # one home each
    edges = []
    for at, home in parts.values():
        at, home = np.concatenate(at), np.concatenate(home)
        a, b = simhash.leaf_edges(points[at], home)
        edges += zip(at[a].tolist(), at[b].tolist())
    assert components(len(points), edges) == components(len(points), close)


def test_simhash_report_and_removal(make_docs, odd_docs, no_docs):
    rnd = random.Random(8)
    long = " ".join(rnd.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rnd.randrange(50)) for _ in range(400))
    docs = make_docs([(10, long), (3, long + " tail"), (7, long), (5, "quite another text"), (6, None), (2, "")])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.report(docs).collect()}
    assert {d: c for d, (_, c) in got.items()} == {10: 3, 3: 3, 7: 3, 5: 5, 6: 2, 2: 2}
    assert got[10][0] == f"{brute_fingerprint(long):016x}" and got[6][0] == "0" * 16
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]
    odd = simhash.report(odd_docs).collect()
    assert len(odd) == odd_docs.count() and {r["component_id"] for r in odd if r["doc_id"] is None} == {None}
    assert Counter(r["doc_id"] for r in simhash.deduplicate(odd_docs).collect())[5] == 0  # a copy of 4
    assert simhash.report(no_docs).count() == 0 and simhash.deduplicate(no_docs).count() == 0


def test_graph_finds_what_a_scan_finds():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(60, 32))
    points = np.concatenate([centres[rnd.integers(0, 60, 1500)] + rnd.normal(size=(1500, 32)) * 0.08, rnd.normal(size=(500, 32))])
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    ids, _ = embedding_dedup.Graph(unit).near(unit[::7].astype(np.float32), 20)
    best = np.argsort(-(unit[::7] @ unit.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), best.tolist())]) > 0.95
    true = set(zip(*(x.tolist() for x in np.nonzero(unit @ unit.T >= 0.95))))
    for grouped in (0.95, 0.99, 2.0):  # also where groups are tighter than links, or single points
        shard = embedding_dedup.Shard(unit, 0.95, embedding_dedup.Shard(unit, grouped).dump())
        row, place = embedding_dedup.links_of(shard, unit, 0.95, beam=8, own=True)
        found = list(zip(row.tolist(), place.tolist()))
        assert len(found) == len(set(found)) and set(found) <= true and len(found) >= 0.999 * len(true)


@pytest.mark.parametrize("own", [True, False])
def test_audit_sees_lost_pairs_of_small_groups(own):
    rnd = np.random.default_rng(5)
    hot = rnd.normal(size=32) + rnd.normal(size=(600, 32)) * 0.02
    first = rnd.normal(size=(1000, 32))
    unit = np.concatenate([hot, first, first + rnd.normal(size=first.shape) * 0.01])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    shard = embedding_dedup.Shard(unit, 2.0)  # single points
    low = shard.graph.layers[-1]
    low.links[low.nodes[low.links] >= 1600] = -1  # a bad graph: no way leads to the second of a pair
    # another shard's block: few of its queries have a link here, and none that is audited
    queries = unit if own else np.concatenate([rnd.normal(size=(1500, 32)), unit[1601:1605], rnd.normal(size=(1500, 32))])
    queries = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    row, place = embedding_dedup.links_of(shard, queries, 0.98, beam=48, own=own)
    true = set(zip(*(x.tolist() for x in np.nonzero(queries @ unit.T >= 0.98))))
    assert set(zip(row.tolist(), place.tolist())) == true


@pytest.mark.parametrize("size", [500, 3000])
def test_beam_does_not_widen_with_unrelated_vectors(size, monkeypatch):
    rnd = np.random.default_rng(11)
    first = rnd.normal(size=(size, 64))
    unit = np.concatenate([first, first[::10] + rnd.normal(size=first[::10].shape) * 0.15])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    shard, beams, near = embedding_dedup.Shard(unit), [], embedding_dedup.Graph.near
    monkeypatch.setattr(embedding_dedup.Graph, "near", lambda self, asked, beam: beams.append(beam) or near(self, asked, beam))
    row, place = embedding_dedup.links_of(shard, unit, own=True)
    true = set(zip(*(x.tolist() for x in np.nonzero(unit @ unit.T >= 0.98))))
    assert set(zip(row.tolist(), place.tolist())) == true and len(true) > 1.1 * len(unit)
    assert set(beams) == {embedding_dedup.BEAM}


def test_leader_that_no_way_leads_to_keeps_its_links():
    rnd = np.random.default_rng(13)
    first = rnd.normal(size=(2000, 32))
    unit = np.concatenate([first, first[:1] + rnd.normal(size=(1, 32)) * 0.01])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    shard = embedding_dedup.Shard(unit, 2.0)  # single points
    low = shard.graph.layers[-1]
    low.links[low.nodes[low.links] == 2000] = -1
    row, place = embedding_dedup.links_of(shard, unit, own=True)
    assert {(0, 2000), (2000, 0)} <= set(zip(row.tolist(), place.tolist())) and len(row) == 2003


@pytest.mark.parametrize("shard", [16_384, 40])
def test_embedding_components(spark, shard):
    rnd = np.random.default_rng(9)
    centres = rnd.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rnd.normal(size=16) * 0.12).astype(np.float32).tolist(), i % 3) for i in range(300)]
    rows += [(400, rows[5][1], 2), (401, rows[5][1], 2), (402, rows[5][1], None)]
    bad = [(500, None, 1), (501, [0.0] * 16, 1), (502, [1.0, None] * 8, 1), (503, [float("nan")] * 16, 1), (504, [], 1), (505, [1.0], 1)]
    df = spark.createDataFrame(rows + bad + [(None, [float("inf")] * 16, 1)], "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, shard_size=shard).collect()}
    ids, label = [r[0] for r in rows], [r[2] for r in rows]
    e = np.array([r[1] for r in rows], dtype=float)
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if label[i] is not None and label[i] == label[j] and u[i] @ u[j] >= 0.98]
    n = Counter(x for p in pairs for x in p)
    for i, c in enumerate(components(len(rows), pairs)):
        r = got[ids[i]]
        assert (r["n_links"], r["component_id"], r["kept"]) == (n[i], ids[c], ids[c] == ids[i])
    assert all((got[b[0]]["n_links"], got[b[0]]["component_id"]) == (0, b[0]) for b in bad)
    assert got[None]["kept"] is False
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_packed_numbers_come_back():
    rnd = np.random.default_rng(3)
    for values in ([], [0], [0, 0], [2**64 - 1], [5, 300, 5], rnd.integers(0, 2**63, 1000).tolist()):
        numbers = np.array(values, dtype=np.uint64)
        assert language_model.unpack(language_model.pack(numbers)).tolist() == values
        ordered = np.sort(numbers)
        assert language_model.unpack_sorted(language_model.pack_sorted(ordered)).tolist() == ordered.tolist()
    assert [language_model.key_bits(n) for n in (0, 1 << 20, 1 << 30, 1 << 50)] == [40, 45, 55, 63]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(make_docs, odd_docs, no_docs, order, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_CHARS", 600)
    monkeypatch.setattr(language_model, "SLICE_TOKENS", 30)
    rnd = random.Random(order)
    docs = [(i, " ".join(rnd.choice("the A cat dog sat on".split()) for _ in range(rnd.randrange(12)))) for i in range(80)]
    docs += [(90, None), (91, "never seen words"), (7, docs[7][1])]
    from pyspark.sql import functions as F

    table = make_docs(docs).repartition(3)
    got = {(r["doc_id"], r["learn"]): r for r in language_model.score(table, F.col("doc_id") % 4 != 0, order).collect()}
    c = [Counter() for _ in range(order + 1)]
    tokens = [(i, (t or "").lower().split() + ["</s>"]) for i, t in docs]
    for i, t in tokens:
        s = ["<s>", *t]
        for n in range(1, order + 1) if i % 4 else ():
            c[n].update(tuple(s[k:k + n]) for k in range(len(s) - n + 1))
    total, kinds = sum(v for k, v in c[1].items() if k != ("<s>",)), len(c[1]) - 1

    def p(context, w):
        if not context:
            return (c[1][w,] + 0.1) / (total + 0.1 * (kinds + 1))
        k = language_model.K
        return (c[len(context) + 1][(*context, w)] + k * p(context[1:], w)) / (c[len(context)][context] + k)

    for i, t in tokens:
        r, s = got[i, i % 4 != 0], ["<s>", *t]
        assert r["score"] == pytest.approx(sum(math.log10(p(tuple(s[max(0, k - order + 1):k]), s[k])) for k in range(1, len(s))))
        assert r["base_score"] == pytest.approx(sum(math.log10(p((), w)) for w in t))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[1][w,] > 0 for w in t), total)
    for word in ("cat", "</s>", "never"):  # a context's probabilities sum to one
        vocabulary = [w for (w,) in c[1] if w != "<s>"] + ["unseen"]
        if order > 1 and word != "</s>":
            assert sum(p((word,), w) for w in vocabulary) == pytest.approx(1)
    assert language_model.report(odd_docs).where("score is null").count() == 0
    assert language_model.report(no_docs).count() == 0
    flat = language_model.score(odd_docs, F.lit(False)).collect()
    assert {(r["score"], r["base_score"], r["train_tokens"]) for r in flat} == {(0.0, 0.0, 0)}


def test_language_model_query_looks_back_two_words(make_docs):
    import zlib

    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10][:60]
    docs = [(i, ("red is warm", "blue is cold")[k % 2]) for k, i in enumerate(train)] + [(out[0], "red is warm"), (out[1], "red is cold")]
    got = {r["doc_id"]: r["score"] for r in language_model.report(make_docs(docs)).collect()}
    assert got[out[0]] > got[out[1]] + 1  # the last word alone would make them equal


def test_stages_carry_columns_of_any_name(spark, make_docs):
    from emberwatch.llm import decontaminate, toxicity

    docs = make_docs([(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, "quite another thing here"), (4, None)])
    names = ["_row", "_hits", "_toxic", "own", "x", "_HITS_", "component_id", "bits", "r", "leaf"]
    for n, name in enumerate(names):
        docs = docs.withColumn(name, docs["doc_id"] * 100 + n)
    bench = spark.createDataFrame([(1, "quite another thing here")], "item_id bigint, text string")
    marks = spark.createDataFrame([(1, 0), (3, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, marks, toxicity.learnable())
    for kept, ids in (
        (simhash.deduplicate(docs), {1, 3, 4}), (decontaminate.decontaminate(docs, bench), {1, 2, 4}),
        (toxicity.remove_toxic(docs, model, 2.0), {1, 2, 3, 4}),
    ):
        rows = kept.collect()
        assert kept.columns == docs.columns and {r["doc_id"] for r in rows} == ids
        assert all(r[name] == r["doc_id"] * 100 + n for r in rows for n, name in enumerate(names))


def test_pipeline_keeps_clean_documents(spark, tmp_path, make_docs):
    import corpus_pipeline

    rnd = random.Random(1)
    clean = lambda: " ".join("".join(rnd.choice(["ka", "lo", "mi", "ne", "ru"]) for _ in range(4)) for _ in range(60))
    docs = [(i, clean() + (" grumblewort" * 2 if i % 6 == 0 else "")) for i in range(240)]
    docs += [(300, docs[1][1]), (301, docs[1][1] + " end"), (302, "q " + docs[2][1]), (303, None), (304, "write to a.b@c.example.org please")]
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(docs[5][1].split()[10:30]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = {i for i in range(0, 240, 6)} | {5, 300, 301, 302}
    assert kept == {d for d, _ in docs} - gone
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"]
