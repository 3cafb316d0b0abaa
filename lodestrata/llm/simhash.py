"""SimHash near-dedup: fingerprints of word shingles, linked by BK-trees.

Fingerprints are first made distinct, so copies are one. Two of them within the radius agree wholly on some of the
blocks their bits are cut into: with two blocks more than the radius, on two at least. Each pair of blocks is a key; fingerprints of equal
key form a shard, and each shard is a BK-tree whose children are keyed by their integer Hamming distance to the parent.
A search follows only the edges within the radius. The trees are built where their queries are instead of being
broadcast: what a broadcast would hold grows with the corpus. A shard too large for one task is several trees, each met by a part of the shard at a time (see buckets.py).

Stages ask for a Jaccard similarity of longer shingles instead. Its pairs are found by the same means, with longer fingerprints of the shingle sets and a radius wide
enough for that similarity, and then checked by the sets themselves. At that radius blocks of bits no longer part the fingerprints, so the shards are made by least
values of the sets: see similar_documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import blocks
from .components import components
from .session import batches, table
from .words import Words, as_strings, mix, ragged, slices

SHINGLE, SEED, RADIUS, TREE = 3, 42, 2, 4096
# For stages: words a shingle, and the least Jaccard similarity in hundredths; bands of least values and values a band; sets a shard.
STAGE_SHINGLE, STAGE_PERCENT, BANDS, ROWS, SHARD = 5, 80, 64, 6, 512
# 64-bit words of a stage's fingerprint, and its radius. At a similarity of 0.8 a bit differs with a probability of at most 0.1875, for sets of four and five (0.162 for all
# others), so a pair is further apart with 4e-10 at most; unrelated pairs are within the radius with 6e-7. With one word 65 % of those would be.
STAGE_WORDS, STAGE_RADIUS = 4, 89


def shingled(texts: pa.Array, shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 values of the shingles of all rows (one of all words where those are fewer), and where each row's begin: row r has first[r]:first[r + 1]."""
    words = Words(texts, lower=True)
    n = len(texts)
    if not len(words.start):
        return np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
    # All words of the slice, one space after each, so that a shingle is one stretch of bytes.
    size = words.end - words.start
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    solid = np.zeros(len(words.data) + 1, dtype=np.int8)
    np.add.at(solid, words.start, 1)
    np.add.at(solid, words.end, -1)
    joined = np.full(int(ends[-1]) + 1, 32, dtype=np.uint8)
    keep = np.ones(len(joined), dtype=bool)
    keep[ends] = False
    joined[keep] = words.data[np.cumsum(solid[:-1]) > 0]
    body = joined.tobytes()
    counts = np.diff(words.first)
    shingles = np.where(counts > 0, np.maximum(1, counts - shingle + 1), 0)
    first = np.concatenate([[0], np.cumsum(shingles)])
    row = np.repeat(np.arange(n), shingles)
    begin = words.first[:-1][row] + np.arange(len(row)) - first[:-1][row]
    last = np.minimum(begin + shingle, words.first[1:][row]) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(body[a:b], seed) for a, b in zip(starts[begin].tolist(), ends[last].tolist())], dtype=np.uint64), first


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half of the shingles' XXH64 values. No word: zero."""
    result = np.zeros(len(texts), dtype=np.uint64)
    hashes, first = shingled(texts, shingle, seed)
    for r in np.flatnonzero(np.diff(first)).tolist():
        own = hashes[first[r] : first[r + 1]]
        bits = np.zeros(64, dtype=np.int64)
        for low in range(0, len(own), 200):
            bits += np.add.reduce(np.unpackbits(own[low : low + 200].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        result[r] = np.packbits(2 * bits > len(own), bitorder="little").view(np.uint64)[0]
    return result


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of each row."""
    batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = as_strings(frame.column("text"))
            found = [fingerprints(texts.slice(low, high - low)) for low, high in slices(texts)]
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], ["doc_id", "fingerprint"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


class BKTree:
    """Distinct fingerprints; the children of a node by their Hamming distance to it."""

    def __init__(self):
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.nodes.append(value)
        self.children.append({})
        new, at = len(self.nodes) - 1, 0
        while new:
            distance = (value ^ self.nodes[at]).bit_count()
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = new
                return
            at = below

    def search(self, value: int, radius: int) -> Iterator[int]:
        """The numbers of the nodes within the radius."""
        waiting = [0] if self.nodes else []
        while waiting:
            at = waiting.pop()
            distance = (value ^ self.nodes[at]).bit_count()
            if distance <= radius:
                yield at
            below = self.children[at]
            if len(below) > 2 * radius:
                for edge in range(distance - radius, distance + radius + 1):
                    if edge in below:
                        waiting.append(below[edge])
            else:
                for edge, node in below.items():
                    if abs(edge - distance) <= radius:
                        waiting.append(node)


def _links(frames: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """For each block a forest of links that joins whatever its links join."""
    block, tree, own, root = None, None, [], {}
    for frame in frames:
        out = []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for b, value, indexed, inner, node in zip(*(frame.column(c).to_pylist() for c in ("block", "fingerprint", "indexed", "inner", "node"))):
            if b != block:
                block, tree, own, root = b, BKTree(), [], {}
            near = {}
            for at in tree.search(value, radius) if inner or not indexed else ():
                near.setdefault(top(own[at]), own[at])
            out += [(node, x) for x in near.values()]
            least = min(near, default=node)
            for x in near:
                root[x] = least
            if indexed:
                root[node] = least
                root.setdefault(least, least)
                tree.add(value)
                own.append(node)
        columns = list(zip(*out)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Link documents whose fingerprints differ in at most `radius` bits, and find the groups they form.

    One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable). Null
    and empty texts have fingerprint zero and are linked like any other. Rows with a null doc_id get the component of
    their fingerprint, null if no other row is in it; they link no others. Repeated rows are kept; an empty table gives none.
    """
    spark = docs.sparkSession
    found = table(fingerprinted(docs), "fingerprints")
    nodes = found.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    parts = radius + 2
    cuts = [64 * k // parts for k in range(parts + 1)]
    part = [F.shiftrightunsigned("fingerprint", cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1) for k in range(parts)]
    keys = F.array(*[F.struct(F.lit(a * parts + b).alias("which"), part[a].alias("x"), part[b].alias("y")) for a, b in combinations(range(parts), 2)])
    rows = nodes.withColumn("bucket", F.explode(keys)).withColumn("bucket", F.xxhash64("bucket"))
    batches(spark)
    links = blocks(rows, "bucket", "fingerprint", TREE).select("block", "fingerprint", "indexed", "inner", "node").mapInArrow(lambda frames: _links(frames, radius), "a long, b long")
    groups = components(links)
    heads = nodes.join(groups, nodes["node"] == groups["node"], "left").select("fingerprint", F.coalesce("component", nodes["node"]).alias("component_id"))
    return found.join(heads, "fingerprint", "left").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each row its set of shingles as sorted distinct hashes, and a hash of that set: zero without a word."""
    sets = []
    for low, high in slices(texts):
        hashes, first = shingled(texts.slice(low, high - low), shingle)
        sets += [np.unique(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) if len(x) else 0 for x in sets], dtype=np.uint64), sets


def set_fingerprint(values: np.ndarray) -> bytes:
    """STAGE_WORDS * 64 bits: a bit is set if it is set in over half of the set's hashes, each drawn out to as many bits. The first 64 are the hashes' own."""
    bits = np.zeros(STAGE_WORDS * 64, dtype=np.int64)
    for low in range(0, len(values), 200):
        own = values[low : low + 200]
        drawn = np.stack([own] + [mix(own + np.uint64(k)) for k in range(1, STAGE_WORDS)], axis=1)
        bits += np.add.reduce(np.unpackbits(drawn.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * bits > len(values), bitorder="little").tobytes()


def _band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set, none of them empty: each key hashes ROWS least values of the set under random orders."""
    draw = np.random.default_rng(SEED)
    factors, terms = (draw.integers(0, 1 << 64, size=BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    factors |= np.uint64(1)
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
    begin = 0
    while begin < len(sets):
        end = max(begin + 1, int(np.searchsorted(first, first[begin] + 16384, side="right")) - 1)
        values, at = np.concatenate(sets[begin:end]), first[begin:end] - first[begin]
        for k in range(BANDS * ROWS):
            least = mix(np.minimum.reduceat(values * factors[k] + terms[k], at))
            keys[begin:end, k // ROWS] = mix(keys[begin:end, k // ROWS] + least)
        begin = end
    return keys + np.arange(BANDS, dtype=np.uint64)


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles: the hash of its set as a signed long, keys) of each row."""
    batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            marks, sets = shingle_sets(as_strings(frame.column("text")), shingle)
            full = [r for r, x in enumerate(sets) if len(x)]
            keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
            if full:
                keys[full] = _band_keys([sets[r] for r in full])
            offsets = np.concatenate([[0], np.cumsum([BANDS if len(x) else 0 for x in sets])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array(marks.view(np.int64)), keys], ["doc_id", "shingles", "keys"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, shingles long, keys array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles, members: the set's hashes, fingerprint: the set's) of each row."""
    batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            marks, sets = shingle_sets(as_strings(frame.column("text")), shingle)
            columns = [pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([set_fingerprint(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array(marks.view(np.int64)), *columns], ["doc_id", "shingles", "members", "fingerprint"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, shingles long, members binary, fingerprint binary")


class Shard:
    """The sets of a block: the sizes of their intersections with one more set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        self.known, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.has = np.zeros(len(self.known), dtype=bool)

    def similar(self, values: np.ndarray, among: list[int], percent: int) -> list[int]:
        """The numbers among `among` of the sets whose Jaccard similarity to `values` is `percent` or more; in whole numbers, so exact."""
        if not among:
            return []
        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        at = at[self.known[at] == values]
        self.has[at] = True
        sizes = self.sizes[among]
        both = np.add.reduceat(self.has[ragged(self.codes, self.starts[among], sizes)], np.cumsum(sizes) - sizes, dtype=np.int64)
        self.has[at] = False
        return [among[k] for k in np.flatnonzero(100 * both >= percent * (sizes + len(values) - both)).tolist()]


def _similar(frames: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each block links that join whatever the links of all its similar pairs join: those that its BK-tree finds within the radius, and the sets confirm."""
    block, nodes, prints, sets, shard, tree, root, out, inside = None, [], [], [], None, None, {}, [], True

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def look(node: int, value: int, values: np.ndarray) -> None:
        near = {}
        for at in shard.similar(values, sorted(tree.search(value, STAGE_RADIUS)), percent):
            near.setdefault(top(nodes[at]), nodes[at])
        out.extend((node, x) for x in near.values())
        least = min(near, default=node)
        for x in near:
            root[x] = least
        if node in root:
            root[node] = least

    def close() -> None:
        nonlocal shard, tree
        if sets and shard is None:
            shard, tree = Shard(sets), BKTree()
            root.update((x, x) for x in nodes)
            for node, value, values in zip(nodes, prints, sets):
                if inside:
                    look(node, value, values)
                tree.add(value)

    def drained() -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    for frame in frames:
        for b, indexed, inner, node, members, value in zip(*(frame.column(c).to_pylist() for c in ("block", "indexed", "inner", "node", "members", "fingerprint"))):
            if b != block:
                close()
                block, nodes, prints, sets, shard, tree, root, inside = b, [], [], [], None, None, {}, inner
            value, values = int.from_bytes(value, "little"), np.frombuffer(members, dtype=np.uint64)
            if indexed:
                nodes.append(node)
                prints.append(value)
                sets.append(values)
            else:
                close()
                if shard is not None:
                    look(node, value, values)
        yield drained()
    close()
    yield drained()


def similar_documents(docs: DataFrame, shingle: int = STAGE_SHINGLE, percent: int = STAGE_PERCENT) -> DataFrame:
    """Link documents whose sets of `shingle`-word shingles have a Jaccard similarity of `percent` in a hundred or more, and find the groups they form.

    One row per row of `docs`: doc_id, shingles (a hash of the set), component_id, as in near_duplicates. Documents without a word are
    one another's copies. Sets that share the key of a band, by whatever chain, are a cluster, the bucket of shards. Each shard is a BK-tree of
    its sets' fingerprints, and each set is searched for in all trees of its cluster; what a tree finds within the radius is compared exactly. A pair at a
    similarity of 0.8 shares no key with a probability of (1 - 0.8**ROWS)**BANDS = 4e-9, and is beyond the radius with 4e-10 at most, less for those above; nothing else
    loses a pair.
    """
    found = table(_signed(docs, shingle), "shingles")
    nodes = table(found.where("doc_id is not null").groupBy("shingles").agg(F.min("doc_id").alias("node")), "sets")
    named = found.select("doc_id", "shingles", "keys").join(nodes, (found["shingles"] == nodes["shingles"]) & (found["doc_id"] == nodes["node"])).select(nodes["shingles"], "node", "keys")
    keyed = named.dropDuplicates(["shingles"]).select("node", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    clusters = components(keyed.join(heads, "key").select(F.col("node").alias("a"), F.col("head").alias("b")).where("a <> b").distinct())
    clusters = table(nodes.join(clusters, "node").select("node", "shingles", "component"), "clusters")
    wanted = docs.join(clusters.select(F.col("node").alias("_lodestrata_node")).distinct(), docs["doc_id"].cast("long") == F.col("_lodestrata_node"), "left_semi")
    members = _sets(wanted, shingle).select("shingles", "members", "fingerprint").join(clusters, "shingles").dropDuplicates(["shingles"])
    members = table(members.select("node", "shingles", "component", "members", "fingerprint"), "members")
    batches(docs.sparkSession)
    links = blocks(members, "component", "shingles", SHARD).select("block", "indexed", "inner", "node", "members", "fingerprint").mapInArrow(lambda frames: _similar(frames, percent), "a long, b long")
    groups = components(links)
    heads = nodes.join(groups, nodes["node"] == groups["node"], "left").select("shingles", F.coalesce("component", nodes["node"]).alias("component_id"))
    return found.select("doc_id", "shingles").join(heads, "shingles", "left").select("doc_id", "shingles", "component_id")


def distinct(docs: DataFrame, shingle: int | None = None, percent: int = STAGE_PERCENT) -> DataFrame:
    """One row of each group: that of the least doc_id; of rows that share it, the least by text, then by the other columns in order.

    Groups are those of near_duplicates, or with `shingle` those of similar_documents. Rows with a null doc_id are in no group; of
    those with one text, the least one stays. All columns must be of types that can be ordered. An empty table gives no rows.
    """
    found = near_duplicates(docs) if shingle is None else similar_documents(docs, shingle, percent)
    heads = found.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("_lodestrata_n")).withColumnRenamed("doc_id", "_lodestrata_id")
    rows = docs.join(heads, docs["doc_id"].cast("long") == heads["_lodestrata_id"])
    least = F.min(F.struct("text", *[c for c in docs.columns if c != "text"])).alias("_lodestrata_least")
    several = rows.where("_lodestrata_n > 1").groupBy("_lodestrata_id").agg(least).select("_lodestrata_least.*")
    kept = rows.where("_lodestrata_n = 1").select(docs.columns).unionByName(several.select(docs.columns))
    nameless = docs.where("doc_id is null").groupBy(F.col("text").alias("_lodestrata_text")).agg(least).select("_lodestrata_least.*")
    return kept.unionByName(nameless.select(docs.columns))
