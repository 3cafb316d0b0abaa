from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import codecs, hashing, scalars
from lodestrata.functions.chunking import SIZES, boundaries, chunk
from lodestrata.operators import gc, integrity, policy, search, sync, versions
from lodestrata.sources.catalog import checked_format


def pseudo_random(size: int, seed: int) -> bytes:
    out, s = bytearray(), seed
    for _ in range(size):
        s = (s * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append((s >> 33) & 255)
    return bytes(out)


BIG = pseudo_random(512 << 10, 7)


def h(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def root_of(chunks: list[bytes]) -> bytes:
    level = [h(b"\0" + c) for c in chunks]
    if not level:
        return h(b"\2")
    while len(level) > 1:
        level = [h(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("size, start", [(0, "af1349b9f5f9a1a6"), (1, "2d3adedff11b61f1"), (1024, "42214739f095a406"), (1025, "d00278ae47eb27b3"), (2049, "5f4d72f40d7a5f82")])
def test_blake3_of_the_published_vectors(size, start):
    assert hashing.blake3(bytes(k % 251 for k in range(size))).hex().startswith(start)


def test_a_fixed_manifest_keeps_its_identity():
    name = lambda b: "blake3:" + hashing.blake3(b).hex()
    manifest = {
        "manifest_version": 1, "object_id": "ignored", "created_at": "2026-01-01T00:00:00Z",
        "original": {"size_bytes": 2048, "sha256": "0123456789abcdef", "content_type": "text/plain"},
        "storage": {"route": "blob", "fidelity": "exact", "codec": "zstd", "codec_params": {"level": 0}, "stored_size_bytes": 1024, "reconstructs_original": True},
        "chunking": {"algo": "fastcdc", "chunks": [name(b"chunk-a"), name(b"chunk-b")], "merkle_root": name(b"root")},
        "quality": {"metric": None, "score": None}, "tenant": "acme", "policy_snapshot": "default@v1",
    }
    assert name(hashing.manifest_json(manifest).encode()) == "blake3:f1a48ba73f5bacdb5593f30b4a588fa29ae867c79fdc382fdb2fa5f76d0a5a3e"
    manifest["chunking"]["merkle_root"] = None
    assert "merkle_root" not in json.loads(hashing.manifest_json(manifest))["chunking"]


def test_merkle_roots_and_proofs(spark):
    sizes = [0, 1, 2, 3, 4, 5, 7, 8, 16, 17, 31]
    lists = {n: [h(bytes([k])) for k in range(n)] for n in sizes}
    rows = spark.createDataFrame([(n, [bytearray(c) for c in lists[n]]) for n in sizes], "n int, chunks array<binary>")
    rows = rows.withColumn("root", hashing.merkle_root(F.col("chunks")))
    assert {r["n"]: bytes(r["root"]) for r in rows.collect()} == {n: root_of(lists[n]) for n in sizes}
    proofs = rows.where("n > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("steps", hashing.merkle_proof(F.col("chunks"), F.col("at")))
    own, other = F.get("chunks", F.col("at")), F.unhex(F.sha2(F.lit("other"), 256))
    checked = proofs.select(hashing.merkle_verify(own, F.col("steps"), F.col("root")).alias("good"), hashing.merkle_verify(other, F.col("steps"), F.col("root")).alias("bad")).collect()
    assert all(r["good"] and not r["bad"] for r in checked) and len(checked) == sum(sizes)
    assert rows.select(hashing.merkle_proof(F.col("chunks"), F.col("n")).alias("x")).where("x is not null").count() == 0


@pytest.mark.parametrize("size", [0, 1, 1000, 16 << 10, 300_000])
def test_chunks_join_to_the_object(size):
    data = BIG[:size]
    ends = boundaries(data)
    assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == size
    lengths = [b - a for a, b in zip([0, *ends], ends)]
    assert all(SIZES[0] <= x <= SIZES[2] for x in lengths[:-1]) and all(x <= SIZES[2] for x in lengths)


def test_an_edit_changes_few_chunks():
    edited = BIG[:250_000] + bytes(b ^ 255 for b in BIG[250_000:250_100]) + BIG[250_100:]
    cut = lambda d: [d[a:b] for a, b in zip([0, *boundaries(d)], boundaries(d))]
    before, after = cut(BIG), cut(edited)
    assert len(set(before) & set(after)) >= len(before) - 2 and len(before) > 3


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000))
def test_small_chunks_reassemble(data):
    ends = boundaries(data, 64, 128, 512)
    assert b"".join(data[a:b] for a, b in zip([0, *ends], ends)) == data


def test_chunk_operator_and_verification(spark):
    objects = spark.createDataFrame([("a", bytearray(BIG[:100_000])), ("b", bytearray(b"")), ("c", None)], "object_id string, data binary")
    rows = chunk(objects, 1024, 4096, 16384)
    assert {r["object_id"] for r in rows.collect()} == {"a"}
    back = integrity.reassembled(rows).collect()
    assert bytes(back[0]["data"]) == BIG[:100_000]
    lists = rows.groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("chunks"))
    manifests = lists.select("object_id", F.lit(hashlib.sha256(BIG[:100_000]).hexdigest()).alias("sha256"), F.lit("exact").alias("fidelity"), "chunks")
    empty = spark.createDataFrame([("b", hashlib.sha256(b"").hexdigest(), "exact", [])], manifests.schema)
    ok = lambda chunks: {r["object_id"]: r["ok"] for r in integrity.verified(manifests.union(empty), chunks).collect()}
    assert ok(rows.select("hash", "data")) == {"a": True, "b": True}
    assert ok(rows.where("pos > 0").select("hash", "data")) == {"a": False, "b": True}


def test_codecs(spark):
    rows = spark.createDataFrame([(bytearray(b"a" * 500_000),), (None,)], "x binary")
    for level in (1, 19):
        packed = rows.withColumn("p", codecs.encode(F.col("x"), "zstd", level)).withColumn("u", codecs.decode(F.col("p"), "zstd"))
        assert packed.where("x is not null and octet_length(p) < 50000 and u = x").count() == 1
    with pytest.raises(ValueError):
        codecs.encode(F.col("x"), "jxl")
    key = F.lit("0123456789abcdef0123456789abcdef")
    assert rows.limit(1).select(codecs.opened(codecs.sealed(F.lit("secret"), key), key).cast("string").alias("s")).first()["s"] == "secret"


def test_ranges_tags_and_locks(spark):
    cases = [("bytes=0-9", 100, (0, 9)), ("bytes=10-", 100, (10, 99)), ("bytes=-20", 100, (80, 99)), ("bytes=200-300", 100, None), ("bytes=5-3", 100, None), ("garbage", 100, None), ("bytes=0-9", 0, None), ("bytes=-200", 100, (0, 99)), ("bytes=0-999", 100, (0, 99))]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, header string, total long")
    got = {r["k"]: r["x"] and tuple(r["x"]) for r in rows.select("k", scalars.byte_range(F.col("header"), F.col("total")).alias("x")).collect()}
    assert got == {k: c[2] for k, c in enumerate(cases)}
    locks = spark.createDataFrame([("2026-01-01T00:00:01Z",), ("2026-01-01T00:00:00Z",), ("nonsense",), (None,)], "until string")
    assert [r[0] for r in locks.select(scalars.locked(F.col("until"), F.lit(1767225600).cast("long"))).collect()] == [True, False, False, False]


def test_presigned_links(spark):
    row = spark.createDataFrame([("s3cret", "pot", "key", 100)], "secret string, pot string, key string, exp long")
    args = [F.col(c) for c in ("secret", "pot", "key", "exp")]
    signed = row.withColumn("sig", scalars.presigned(*args))
    valid = lambda now, sig: signed.select(scalars.presign_valid(*args, sig, F.lit(now))).first()[0]
    assert valid(100, F.col("sig")) and not valid(101, F.col("sig")) and not valid(100, F.lit("00"))


def test_names_fit_a_file_name(spark):
    name = st.text(st.characters(exclude_categories=["Cs"]), max_size=180)
    pairs: list[tuple[str, str]] = []

    @settings(max_examples=128, deadline=None, database=None)
    @given(name, name)
    def draw(pot, key):
        pairs.append((pot[:60], key))

    draw()
    pairs += [("p", ""), ("p" * 50, "k" * 74), ("p" * 50, "k" * 75)]
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(pairs)], "n int, pot string, key string")
    got = {r["n"]: (r["k"], r["p"]) for r in rows.select("n", scalars.valid_key(F.col("pot"), F.col("key")).alias("k"), scalars.valid_pot(F.col("pot")).alias("p")).collect()}
    for k, (pot, key) in enumerate(pairs):
        fits = key != "" and len(pot.encode().hex()) + len(key.encode().hex()) + 6 <= 255
        assert got[k] == (fits, pot not in ("", ".", "..") and "/" not in pot and "\\" not in pot)


def test_set_and_bag_differences(spark):
    row = spark.createDataFrame([(["a", "a", "b"], ["b", "c", "c", "d"])], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = row.select(sync.added(a, b), sync.added(b, a), sync.shared(a, b), sync.bag_delta(a, b), sync.bag_delta(b, a)).first()
    assert tuple(got) == (2, 1, 1, ["c", "c", "d"], ["a", "a"])


def test_sweeps_take_two_passes_and_pardon(spark):
    stored = spark.createDataFrame([(k,) for k in range(4)], "chunk long")
    live = spark.createDataFrame([(0,)], "chunk long")
    none = spark.createDataFrame([], "chunk long, condemned_at long")
    state = lambda s: {r["chunk"]: (r["condemned_at"], r["state"]) for r in s.collect()}
    first = gc.swept(stored, live, none, 1000, 10)
    assert state(first) == {0: (None, "live"), **{k: (1000, "condemned") for k in (1, 2, 3)}}
    held = first.where("condemned_at is not null")
    assert state(gc.swept(stored, live, held, 1005, 10))[1] == (1000, "waiting")
    assert state(gc.swept(stored, live, held, 1010, 10))[1] == (1000, "erased")
    assert state(gc.swept(stored, live.union(spark.createDataFrame([(2,)], "chunk long")), held, 1011, 10))[2] == (None, "live")


def test_versions_edge_cases(spark):
    log = spark.createDataFrame([("p", "a", 1, 10), ("p", "a", 2, 11), ("p", "b", 1, 12)], "pot string, key string, seq long, object_id long")
    rows = lambda f: sorted(tuple(r) for r in f.select("pot", "key", "seq", "object_id").collect())
    pair = lambda *p: spark.createDataFrame([p], "pot string, key string, to_pot string, to_key string")
    assert rows(versions.moved(log, pair("p", "a", "p", "a"))) == rows(log)
    assert rows(versions.moved(log, pair("p", "a", "p", "b"))) == [("p", "b", 1, 10), ("p", "b", 2, 11)]
    assert rows(versions.copied(log, pair("p", "a", "p", "b"))) == sorted([*rows(log), ("p", "b", 2, 11)])
    assert rows(versions.trimmed(log, 0)) == rows(log) and rows(versions.trimmed(log, 1)) == [("p", "a", 2, 11), ("p", "b", 1, 12)]
    empty = log.limit(0)
    assert versions.current(empty).count() == 0


def test_search_ranks_within_the_tenant(spark):
    rows = spark.createDataFrame([("t1", "x", [1.0, 0.0]), ("t1", "y", [0.0, 1.0]), ("t2", "z", [1.0, 0.0]), ("t1", "w", [0.0, 0.0])], "tenant string, object_id string, vector array<float>")
    assert [r["object_id"] for r in search.top_k(rows, [0.9, 0.1], 2, "t1").collect()] == ["x", "y"]
    new = search.upserted(rows, spark.createDataFrame([("t1", "x", [0.0, 1.0])], rows.schema))
    assert new.count() == 4 and search.top_k(new, [0.9, 0.1], 1, "t1").first()["score"] < 0.2
    assert search.top_k(rows, [1.0, 0.0], 10, "t1").where("object_id = 'w'").first()["score"] == 0.0


def test_a_newer_format_is_refused(spark):
    stamp = lambda *v: spark.createDataFrame([(x,) for x in v], "version int")
    assert checked_format(stamp(), 1).first()[0] == 1 and checked_format(stamp(1), 2).first()[0] == 1
    with pytest.raises(Exception, match="newer"):
        checked_format(stamp(9), 1).collect()


def test_unknown_keys_are_anonymous(spark):
    requests = spark.createDataFrame([(1, "ghost", "open", "read"), (2, None, "open", "write"), (3, "ro", "shut", "read"), (4, "ro", "shut", "write")], "request_id int, access_key string, pot string, action string")
    keys = spark.createDataFrame([("ro", True, [])], "access_key string, read_only boolean, pots array<string>")
    pots = spark.createDataFrame([("open", True)], "pot string, public_read boolean")
    assert {r[0]: r[1] for r in policy.decisions(requests, keys, pots).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_statuses_and_upload_ids(spark):
    names = [None, "InvalidKey", "InvalidPart", "BadBucket", "Upload", "Locked", "TooLarge", "Forbidden", "MissingChunk"]
    rows = spark.createDataFrame([(n,) for n in names], "e string")
    assert [r[0] for r in rows.select(scalars.status_of(F.col("e"))).collect()] == [200, 400, 400, 400, 400, 409, 413, 403, 500]
    made = spark.range(1).select(scalars.upload_id(F.lit("p"), F.lit("k"), F.lit(5), F.lit(0))).first()[0]
    assert made == hashlib.sha256(b"p/k/5/0").hexdigest()


def test_embeddings_replace_by_object(spark):
    objects = spark.createDataFrame([("t", "a", bytearray(b"\1\2")), ("t", "b", None)], "tenant string, object_id string, data binary")
    got = {r["object_id"]: list(r["vector"]) for r in search.understood(objects, search.length_and_sum).collect()}
    assert got == {"a": [2.0, 3.0], "b": [0.0, 0.0]}
