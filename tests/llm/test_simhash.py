from __future__ import annotations

import os
import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from lodestrata.llm import session, simhash
from lodestrata.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = {p: p for p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(set(prints))
    for a in known:
        for b in known:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    least: dict[int, int] = {}
    # only rows with an id join groups
    named = {p for (d, _), p in zip(rows, prints) if d is not None}
    root = {p: p for p in named}
    for a in named:
        for b in named:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[top(p)] = min(least.get(top(p), d), d)
    return sorted(((d, f"{p:016x}", least[top(p)] if p in named else None) for (d, _), p in zip(rows, prints)), key=repr)


def test_against_brute_force(spark):
    draw = random.Random(3)
    base = [f"Word{k}" for k in range(400)]
    rows = []
    for k in range(150):
        words = list(base) if k % 3 else [f"o{draw.randrange(9)}" for _ in range(draw.randrange(6))]
        for _ in range(draw.randrange(4)):
            if words:
                words[draw.randrange(len(words))] = f"n{draw.randrange(50)}"
        rows.append((k * 7 % 151, " ".join(words)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute(rows)
    assert sorted((tuple(r) for r in got), key=repr) == expected and len({r[2] for r in expected}) < len({r[1] for r in expected})


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE", 3)
    rows = [(k, " ".join(f"w{j}" for j in range(300)) + " tail" * (k % 5) + f" x{k}") for k in range(40)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_a_tree_finds_what_a_scan_finds():
    draw = random.Random(1)
    values = list({draw.getrandbits(64) & 0xFF00FF for _ in range(500)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.nodes[k] for k in tree.search(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(10, 40)] + [(70, 70), (300, 301), (301, 302), (302, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 5 for k in (5, *range(10, 40))}, **{k: 300 for k in (300, 301, 302)}}


def test_hard_rows(hard, none):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(hard).collect()), key=repr) == brute(rows)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.distinct(hard)
    assert kept.columns == hard.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({r[2] for r in brute(rows) if r[2] is not None})


def sets_of(rows):
    return {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, t in rows if (w := t.lower().split()) is not None}


def test_similar_documents_against_all_pairs(spark, monkeypatch):
    draw = random.Random(8)
    rows = []
    for g in range(25):
        base = [f"g{g}w{k}" for k in range(draw.choice([5, 30, 120, 300]))]
        for _ in range(6):
            words = list(base)
            for at in draw.sample(range(len(words)), draw.randrange(1 + len(words) // 25 + 1)):
                words[at] = f"n{draw.randrange(10**6)}"
            rows.append((len(rows) * 7 % 151, " ".join(words)))
    sets = sets_of(rows)
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = {d: d for d in sets}
    for _ in range(len(sets)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.distinct(docs, 5).collect()} == set(root.values())
    thin = {r[0]: r[2] for r in brute(rows)}
    assert any(thin[a] != thin[b] for a, b in pairs)
    for shard in (512, 2):
        monkeypatch.setattr(simhash, "SHARD", shard)
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == root


def test_links_of_similar_sets_come_from_the_tree(monkeypatch):
    draw = np.random.default_rng(5)
    sets = []
    for size in (4, 8, 40, 400):
        base = draw.integers(0, 1 << 64, size=size, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[:keep], draw.integers(0, 1 << 64, size=size // 8, dtype=np.uint64)])) for keep in (size, size - size // 8, size // 2) for _ in range(3)]
    similar = {(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}

    def groups(links):
        root = list(range(len(sets)))
        for _ in sets:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    def found(queries):
        rows = [(1, k < queries, queries == len(sets), k, x.tobytes(), simhash.set_fingerprint(x)) for k, x in enumerate(sets)]
        frame = pa.RecordBatch.from_pylist([dict(zip(("block", "indexed", "inner", "node", "members", "fingerprint"), r)) for r in rows])
        return {tuple(r.values()) for out in simhash._similar(iter([frame.slice(0, 7), frame.slice(7)]), 80) for r in out.to_pylist()}

    assert similar and found(len(sets)) <= similar and groups(found(len(sets))) == groups(similar)
    assert found(20) <= {(a, b) for a, b in similar if a >= 20 > b} and {a for a, _ in found(20)} == {a for a, b in similar if a >= 20 > b}
    monkeypatch.setattr(simhash.BKTree, "search", lambda self, value, radius: iter(()))
    assert found(len(sets)) == set()


def test_the_radius_of_a_stage_holds_pairs_at_its_similarity():
    draw = np.random.default_rng(6)
    far = []
    for size in (4, 5, 8, 12, 20, 28, 100, 1000):
        for _ in range(200):
            values = draw.integers(0, 1 << 64, size=size + 2 * size, dtype=np.uint64)
            own = size // 4
            cut = int(draw.integers(0, own + 1))
            a, b, other = values[: size + cut], np.concatenate([values[:size], values[size + cut : size + own]]), values[2 * size :]
            assert 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
            x, y, z = (int.from_bytes(simhash.set_fingerprint(np.unique(v)), "little") for v in (a, b, other))
            assert (x ^ y).bit_count() <= simhash.STAGE_RADIUS
            far.append((x ^ z).bit_count())
            assert x & (1 << 64) - 1 == sum(1 << k for k in range(64) if 2 * sum(int(v) >> k & 1 for v in a) > len(a)) or size > 28
    assert sum(d <= simhash.STAGE_RADIUS for d in far) <= 1


def test_the_stage_keeps_no_pair_of_similar_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = sets_of([(r["doc_id"], r["text"] or "") for r in corpus_pipeline.near_dedup(spark, docs, "").collect()])
    assert not [(a, b) for a in kept for b in kept if a < b and 5 * len(kept[a] & kept[b]) >= 4 * len(kept[a] | kept[b])]


def test_similar_documents_hard_rows(hard, none):
    kept = simhash.distinct(hard, 5)
    assert kept.columns == hard.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 5, 7, 8]
    assert simhash.similar_documents(none).count() == 0


def test_hubs_and_hot_buckets_dealt_over_tasks(spark, monkeypatch):
    edges = [(1, k) for k in range(2, 60)] + [(59, k) for k in range(60, 90)] + [(100, 101), (None, 4), (5, None)]
    plain = sorted(components(spark.createDataFrame(edges, "a long, b long")).collect())
    rows = [(k, " ".join(f"w{j}" for j in range(40 + k % 3))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = sorted(simhash.near_duplicates(docs).collect())
    monkeypatch.setattr(session, "HOT_ROWS", 3)
    assert sorted(components(spark.createDataFrame(edges, "a long, b long")).collect()) == plain
    assert len(plain) == 91 and {c for n, c in plain if n < 100} == {1}
    assert sorted(simhash.near_duplicates(docs).collect()) == groups
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_of_a_scope_are_deleted_and_kept_ones_stay(spark):
    rows = spark.range(5)
    with session.scratch(spark):
        passing = session.table(rows, "passing")
        with session.scratch(spark):
            inner = session.kept(passing.where("id > 2"), "inner")
    folder = os.path.dirname(passing.inputFiles()[0])
    assert not os.path.exists(folder.removeprefix("file://").removeprefix("file:")) and inner.count() == 2
    session.drop(inner)
    assert not os.path.exists(os.path.dirname(inner.inputFiles()[0]).removeprefix("file://").removeprefix("file:"))


def test_the_driver_gives_native_memory_back_with_each_table(spark, monkeypatch):
    told, trim = [], session.trim
    monkeypatch.setattr(session, "trim", lambda s: told.append(trim(s)))
    session.table(spark.range(5), "trimmed")
    assert len(told) == 1 and "native heap" in told[0]
