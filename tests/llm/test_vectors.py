from __future__ import annotations

import numpy as np

from lodestrata.llm import vectors


def brute(rows, least=0.93):
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None and i is not None for i, v, lab in rows]
    links = [[] for _ in rows]
    for a, (_, v, lab) in enumerate(rows):
        for b, (_, w, other) in enumerate(rows):
            if a != b and ok[a] and ok[b] and lab == other and len(v) == len(w):
                x, y = np.array(v, dtype=np.float32).astype(float), np.array(w, dtype=np.float32).astype(float)
                if x / np.linalg.norm(x) @ (y / np.linalg.norm(y)) >= least:
                    links[a].append(b)
    out = []
    for a, (i, *_) in enumerate(rows):
        seen, waiting = {a}, [a]
        while waiting:
            for b in links[waiting.pop()]:
                if b not in seen:
                    seen.add(b)
                    waiting.append(b)
        head = min(rows[b][0] for b in seen) if i is not None else None
        out.append((i, len(links[a]), head, i is not None and head == i))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(12, 64))
    rows = []
    for k in range(300):
        v = centres[draw.integers(12)] + draw.normal(size=64) * draw.choice([0.0, 0.1, 0.2, 0.35])
        rows.append((k, [float(np.float32(x)) for x in v], int(draw.integers(3))))
    rows += [(300, None, 1), (301, [0.0] * 64, 1), (302, [float("nan")] + [1.0] * 63, 1), (303, [float("inf")] + [1.0] * 63, 1), (304, [None] + [1.0] * 63, 1), (305, rows[0][1], None), (None, rows[0][1], rows[0][2]), (306, [], 1)]
    rows += [(307, [1.0, 2.0, 3.0], 1), (308, [2.0, 4.0, 6.0], 1), (309, [1e-30] * 64, 1), (310, [1e30] * 64, 1), (5, rows[5][1], rows[5][2])]
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, label int, node int, bucket string")
    got = vectors.near_duplicates(frame)
    assert sorted((tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr) == brute(rows)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    draw = np.random.default_rng(1)
    rows = [(k, [float(np.float32(x)) for x in np.ones(16) + draw.normal(size=16) * 0.05], 1) for k in range(60)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_recall_at_the_threshold():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(5000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = draw.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1)[:, None]
    a, b = vectors.buckets(x), vectors.buckets(y)
    met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
    assert met.mean() > 0.995


def test_the_transform_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(vectors.hadamard(vectors.hadamard(x)), x)
