"""Embedding near-dedup: cross-polytope hashing with multiprobe buckets and verified pairs.

Equal vectors of a label are first made one class, so copies cost nothing. A class's unit vector is turned by random
signs and fast Hadamard transforms, three times; its hash is the largest coordinate and that coordinate's sign. A table joins two such
hashes to a bucket. A class lives in one bucket of each table and also looks into the likeliest next ones. Whoever
meets in a bucket is compared by its cosine in double precision.

What is dealt to buckets is light: a class's number and no vector, unless the vectors are too many to broadcast. A pair is counted only in the first of the
buckets it can meet in, so a block gives each class's number of links and a forest that joins what its pairs join, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import blocks
from .components import components
from .session import batches, join_ones, table
from .words import U64, mix

TABLES, PROBES, BLOCK, SEED = 9, 1, 512, 20
SLICE = 1 << 15  # pairs whose vectors are held side by side
_CLASSES = "node long, n long, vector binary, buckets array<long>"
_FOUND = "forest boolean, a long, b long"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the row length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def buckets(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """For each row and table its bucket and the `probes` likeliest next ones: unsigned numbers, rows x tables x (1 + probes)."""
    n, d = vectors.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :d] = vectors
    signs = np.random.default_rng([seed, size]).choice([-1.0, 1.0], (tables, 2, 3, size))
    found = np.zeros((n, tables, 1 + probes), dtype=U64)
    deep = min(size, probes + 1)
    for t in range(tables):
        corner, loss = [], []
        for k in range(2):
            y = x
            for turn in range(3):
                y = hadamard(y * signs[t, k, turn])
            top = np.argsort(-np.abs(y), axis=1)[:, :deep]
            at = np.take_along_axis(y, top, axis=1)
            corner.append(2 * top + (at < 0))
            loss.append(np.abs(at[:, :1]) - np.abs(at))
        total = (loss[0][:, :, None] + loss[1][:, None, :]).reshape(n, -1)
        first = np.argsort(total, axis=1, kind="stable")[:, : 1 + probes]
        a = np.take_along_axis(corner[0], first // deep, axis=1).astype(U64)
        b = np.take_along_axis(corner[1], first % deep, axis=1).astype(U64)
        found[:, t, : first.shape[1]] = a * U64(2 * size) + b + U64(1)
        found[:, t] += U64(t) << U64(40)
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # so that squares of very large or small components stay in range
    return x / np.linalg.norm(x, axis=1)[:, None]


def _hashed(frames: Iterator[pa.RecordBatch], tables: int, probes: int) -> Iterator[pa.RecordBatch]:
    """Each class with its unit vector and its buckets: table by table its own, then those it looks into."""
    for frame in frames:
        nodes, labels, counts = (np.array(frame.column(c).to_pylist(), dtype=np.int64) for c in ("node", "label_key", "n"))
        lists = frame.column("vector")
        sizes = np.array([len(v.values) for v in lists], dtype=np.int64)
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            x = _unit(np.array([lists[int(k)].values.to_numpy(zero_copy_only=False) for k in at], dtype=np.float64))
            found = buckets(x, tables, probes)
            found = mix(found + mix(labels[at].view(U64) + U64(d))[:, None, None]).view(np.int64)
            width = tables * (1 + probes)
            lists_ = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(counts[at]), pa.array([row.tobytes() for row in x], pa.binary()), lists_], ["node", "n", "vector", "buckets"])


def _counted(own: np.ndarray, a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Which of the pairs (a, b) this bucket counts, by rows of own: classes x tables x buckets, each class's own bucket first.

    A pair can meet where one of the two looks into, or lives in, the other's own bucket. Of such tables the first counts, and there
    of two buckets the one with the lesser number. Tables are gone through in order, each with the pairs that didn't meet before.
    """
    counted, left = np.zeros(len(a), bool), np.arange(len(a))
    for table in range(own.shape[1]):
        x, y = own[a[left], table], own[b[left], table]
        mine, yours = (x[:, :1] == y).any(axis=1), (y[:, :1] == x).any(axis=1)
        home = np.where(mine & yours, np.minimum(x[:, 0], y[:, 0]), np.where(mine, x[:, 0], y[:, 0]))
        counted[left[(mine | yours) & (home == bucket)]] = True
        left = left[~(mine | yours)]
        if not len(left):
            break
    return counted


def _block(frame: dict[str, np.ndarray], least: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block: (node, how many it has here), and a forest of (node, least node of its tree)."""
    node, n, home, first = (frame[c] for c in ("node", "n", "home", "indexed"))
    x = np.frombuffer(b"".join(frame["vector"]), dtype=np.float64).reshape(len(node), -1)
    own = frame["buckets"].reshape(len(node), -1, 1 + probes)
    bucket, inner = frame["bucket"][0], bool(frame["inner"].all())
    at = np.flatnonzero(home)
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    pairs = []
    for k in range(0, len(node), 1024):
        q, h = np.nonzero(x[k : k + 1024] @ x[at].T >= least - 1e-9)
        q, h = q + k, at[h]
        # Each pair once: within a shard by number, between two shards from the second; only own buckets are indexed.
        both = home[q]
        keep = (q != h) & (~both | (q > h)) if inner else (first[q] != first[h]) & (~both | ~first[q])
        q, h = q[keep], h[keep]
        keep = _counted(own, q, h, bucket)
        q, h = q[keep], h[keep]
        for m in range(0, len(q), SLICE):
            some, others = q[m : m + SLICE], h[m : m + SLICE]
            keep = np.einsum("ij,ij->i", x[some], x[others]) >= least
            pairs.append(np.stack([some[keep], others[keep]]))
    a, b = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
    np.add.at(links, a, n[b])
    np.add.at(links, b, n[a])
    while len(a):
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == was).all():
            break
    linked, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(node)))
    return np.stack([node[linked], links[linked]]), np.stack([node[moved], node[root[moved]]])


def _compared(frames: Iterator[pa.RecordBatch], least: float, probes: int) -> Iterator[pa.RecordBatch]:
    """Rows by block: gather a block, then compare. What a batch's blocks give leaves as one batch."""
    names, held, block = ("bucket", "node", "n", "home", "indexed", "inner"), [], None

    def closed() -> tuple[np.ndarray, np.ndarray]:
        rows = {c: np.concatenate([h[c] for h in held]) for c in (*names, "buckets")} | {"vector": [v for h in held for v in h["vector"]]}
        held.clear()
        return _block(rows, least, probes)

    def batch(done: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        counts, forest = (np.concatenate(x, axis=1).astype(np.int64) for x in zip(*done))
        kind = np.repeat([False, True], [counts.shape[1], forest.shape[1]])
        both = np.concatenate([counts, forest], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(both[0]), pa.array(both[1])], ["forest", "a", "b"])

    for frame in frames:
        if not frame.num_rows:
            continue
        ids, done = frame.column("block").to_numpy(zero_copy_only=False), []
        columns = {c: frame.column(c).to_numpy(zero_copy_only=False) for c in names}
        columns |= {"vector": frame.column("vector").to_pylist(), "buckets": frame.column("buckets").flatten().to_numpy().reshape(frame.num_rows, -1)}
        cut = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for low, high in zip(cut, cut[1:]):
            if held and ids[low] != block:
                done.append(closed())
            block = ids[low]
            held.append({c: v[low:high] for c, v in columns.items()})
        if done:
            yield batch(done)
    if held:
        yield batch([closed()])


def near_duplicates(embeddings: DataFrame, least: float = 0.93, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """Link vectors of one label whose cosine is `least` or more, as far as the tables find them, and group them.

    One row per row of `embeddings` (vec_id, embedding, label): vec_id, n_links, component_id, kept. A vector that is
    null, zero or empty or holds a null or non-finite component, or whose label or vec_id is null, links with nothing; neither
    do vectors of different lengths. Rows that repeat a vector are linked to one another. An empty table gives no rows.
    """
    batches(embeddings.sparkSession)
    e = embeddings
    plain = F.transform(e["embedding"].cast("array<double>"), lambda v: v + F.lit(0.0))  # no negative zero
    rows = e.select(e["vec_id"].cast("long").alias("vec_id"), e["label"].alias("label"), plain.alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda v: v != 0)
    # 128 bits stand for a label and vector, so that vectors are shuffled once, to find one of each class.
    mark = F.struct(F.xxhash64("label", "vector").alias("x"), F.xxhash64(F.lit(SEED), "label", "vector").alias("y"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("mark", mark)
    classes = rows.where("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    hashed = classes.select("node", "n", "vector", F.xxhash64("label").alias("label_key")).mapInArrow(lambda frames: _hashed(frames, tables, probes), _CLASSES)
    hashed = table(hashed, "hashed")
    homes = F.filter("buckets", lambda x, k: k % (1 + probes) == 0)
    # A class may have a bucket twice, as its own and as one it looks into.
    light = hashed.select("node", F.explode(F.array_distinct("buckets")).alias("bucket"), homes.alias("homes")).select("node", "bucket", F.array_contains("homes", F.col("bucket")).alias("home"))
    near = blocks(light, "bucket", "node", BLOCK, "_n > 1 and _homes > 0")
    near = join_ones(near, hashed, "node", F.octet_length("vector") + F.size("buckets") * 8 + 32)
    near = near.select("block", "bucket", "node", "n", "home", "indexed", "inner", "vector", "buckets").repartition("block").sortWithinPartitions("block", F.desc("indexed"), "node")
    found = table(near.mapInArrow(lambda frames: _compared(frames, least, probes), _FOUND), "links")
    degrees = found.where("not forest").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    groups = components(found.where("forest").select("a", "b"))
    ids = rows.where("usable").groupBy("mark").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    heads = ids.join(degrees, "node", "left").join(groups, "node", "left").select("mark", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("head"))
    single = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("usable").select("vec_id", "mark").join(heads, "mark").select("vec_id", F.col("links").alias("n_links"), F.col("head").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
