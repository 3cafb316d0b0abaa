"""The catalog queries: name -> Spark callable, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import hashing, scalars
from lodestrata.functions.chunking import chunk
from lodestrata.operators import access, gc, integrity, listing, multipart, policy, search, sync, versions
from lodestrata.plans import maintenance
from lodestrata.sources import catalog
from lodestrata.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LOG = """log AS (
    SELECT c_mktsegment AS pot, CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS object_id, o_orderdate AS created_at,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
CURRENT = LOG + """, current AS (
    SELECT pot, key, max(seq) AS seq, arg_max(object_id, seq) AS object_id, arg_max(created_at, seq) AS created_at FROM log GROUP BY pot, key)"""
SIZES = "sizes AS (SELECT l_orderkey AS object_id, CAST(sum(p_size) AS BIGINT) AS size FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"
LINES = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
LISTS = LOG + f""", lists AS (
    SELECT pot, key, seq, log.object_id, coalesce(chunks, []) AS chunks FROM log LEFT JOIN (
        SELECT l_orderkey AS object_id, list(p_brand ORDER BY {LINES}) AS chunks FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) c ON log.object_id = c.object_id
), steps AS (
    SELECT * FROM (SELECT *, lag(chunks) OVER (PARTITION BY pot, key ORDER BY seq) AS before FROM lists) WHERE before IS NOT NULL)"""
LEAVES = """leaves AS (
    SELECT conv_id, list(sha256(unhex('00' || sha256(text))) ORDER BY turn) AS h, count(*) AS n FROM conversations GROUP BY conv_id)"""
TREE = LEAVES + """, levels(conv_id, n, depth, h) AS (
    SELECT conv_id, n, 0, h FROM leaves UNION ALL
    SELECT conv_id, n, depth + 1, [CASE WHEN 2 * i + 2 <= len(h) THEN sha256(unhex('01' || h[2 * i + 1] || h[2 * i + 2])) ELSE h[2 * i + 1] END for i in range(0, (len(h) + 1) // 2)]
    FROM levels WHERE len(h) > 1)"""


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# Listings and statistics


@query(
    "storage_stats",
    f"""WITH {CURRENT}, {SIZES}
    SELECT (SELECT count(DISTINCT pot) FROM log) AS buckets, count(*) AS objects, CAST(coalesce(sum(size), 0) AS BIGINT) AS logical_bytes,
        (SELECT CAST(sum(p_size) AS BIGINT) FROM part) AS physical_bytes, (SELECT count(*) FROM part) AS unique_chunks
    FROM current LEFT JOIN sizes USING (object_id)""",
)
def storage_stats(spark, sf_dir):
    stored = catalog.stored(spark, sf_dir)
    return listing.storage_stats(catalog.pointer_log(spark, sf_dir), listing.object_sizes(catalog.chunk_rows(spark, sf_dir), stored), stored)


@query(
    "savings_by_pot",
    f"""WITH {CURRENT}, held AS (SELECT pot, object_id, l_partkey AS chunk FROM current JOIN lineitem ON l_orderkey = object_id),
    logical AS (SELECT pot, CAST(sum(p_size) AS BIGINT) AS logical_bytes FROM held JOIN part ON chunk = p_partkey GROUP BY pot),
    physical AS (SELECT pot, CAST(sum(p_size) AS BIGINT) AS physical_bytes FROM (SELECT DISTINCT pot, chunk FROM held) JOIN part ON chunk = p_partkey GROUP BY pot)
    SELECT pot, logical_bytes, physical_bytes, round(greatest(0, 100.0 - 100.0 * physical_bytes / logical_bytes), 4) AS savings FROM logical JOIN physical USING (pot)""",
)
def savings_by_pot(spark, sf_dir):
    now = versions.current(catalog.pointer_log(spark, sf_dir)).select("pot", "object_id")
    # One pass over the lines: counts by pot and chunk carry both sums.
    counts = catalog.chunk_rows(spark, sf_dir).select("object_id", "chunk").join(now, "object_id").groupBy("pot", "chunk").agg(F.count("*").alias("n"))
    sums = counts.join(catalog.stored(spark, sf_dir), "chunk").groupBy("pot").agg(F.sum(F.col("n") * F.col("size")).alias("logical_bytes"), F.sum("size").alias("physical_bytes"))
    return sums.withColumn("savings", F.round(listing.savings(F.col("physical_bytes"), F.col("logical_bytes")), 4))


@query("pot_listing", f"WITH {LOG} SELECT pot, count(DISTINCT key) AS n_keys FROM log GROUP BY pot")
def pot_listing(spark, sf_dir):
    return listing.pot_listing(catalog.pointer_log(spark, sf_dir))


@query(
    "object_listing",
    f"""WITH {LOG}, {SIZES}, keys AS (SELECT pot, key, arg_max(object_id, seq) AS object_id, count(*) AS versions FROM log GROUP BY pot, key)
    SELECT pot, key, coalesce(size, 0) AS size, versions FROM keys LEFT JOIN sizes USING (object_id)""",
)
def object_listing(spark, sf_dir):
    return listing.object_listing(catalog.pointer_log(spark, sf_dir), listing.object_sizes(catalog.chunk_rows(spark, sf_dir), catalog.stored(spark, sf_dir)))


@query("pots_union_sorted", "SELECT DISTINCT pot FROM (SELECT c_mktsegment AS pot FROM customer UNION ALL SELECT n_name FROM nation) ORDER BY pot")
def pots_union_sorted(spark, sf_dir):
    return listing.all_pots(catalog.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("pot")), catalog.read(spark, sf_dir, "nation").select(F.col("n_name").alias("pot")))


@query(
    "folder_rollup",
    """SELECT split_part(rest, '/', 1) AS folder, count(*) AS n_keys FROM (SELECT substr(source || '/' || lang || '/' || doc_id, 5) AS rest FROM documents WHERE starts_with(source, 'src1'))
    WHERE contains(rest, '/') GROUP BY 1""",
)
def folder_rollup(spark, sf_dir):
    keys = catalog.read(spark, sf_dir, "documents", "source", "lang", "doc_id").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("key"))
    return listing.folders(keys, "src1")


@query("key_contains_filter", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.com/en')")
def key_contains_filter(spark, sf_dir):
    return listing.named(catalog.read(spark, sf_dir, "pages", "page_id", "url"), "Example.COM/en", "url")


@query("sort_files", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def sort_files(spark, sf_dir):
    return catalog.read(spark, sf_dir, "documents", "doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


_TYPES = ("image/png", "video/mp4", "audio/ogg", "text/html", "application/json", "application/pdf", "application/octet-stream")


@query(
    "content_classes",
    """SELECT ['image', 'video', 'audio', 'text', 'text', 'pdf', 'other'][page_id % 7 + 1] AS kind, count(*) AS n FROM pages GROUP BY 1""",
)
def content_classes(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, _TYPES)), (F.col("page_id") % 7).cast("int"))
    return catalog.read(spark, sf_dir, "pages", "page_id").groupBy(scalars.content_class(kind).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "human_sizes",
    """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.1f MB', floor(n * 10 / 1048576.0 + 0.5) / 10) END AS shown
    FROM (SELECT doc_id, strlen(text) AS n FROM documents)""",
)
def human_sizes(spark, sf_dir):
    return catalog.read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", scalars.human_bytes(F.octet_length("text")).alias("shown"))


# Versions


@query("current_version", f"WITH {CURRENT} SELECT pot, key, seq, object_id FROM current")
def current_version(spark, sf_dir):
    return versions.current(catalog.pointer_log(spark, sf_dir))


@query("version_history", f"WITH {LOG} SELECT pot, key, object_id, row_number() OVER (PARTITION BY pot, key ORDER BY seq) AS version FROM log")
def version_history(spark, sf_dir):
    return versions.history(catalog.pointer_log(spark, sf_dir)).select("pot", "key", "object_id", "version")


@query(
    "history_skips_corrupt",
    f"""WITH {LOG}, texts AS (SELECT pot, key, seq, CASE WHEN object_id % 5 = 0 THEN 'blake3:this-is-not-a-valid-hash' ELSE 'sha256:' || sha256(CAST(object_id AS VARCHAR)) END AS object_id FROM log)
    SELECT pot, key, max(seq) AS seq, arg_max(object_id, seq) AS object_id FROM texts WHERE object_id LIKE 'sha256:%' GROUP BY pot, key""",
)
def history_skips_corrupt(spark, sf_dir):
    address = F.when(F.col("object_id") % 5 == 0, "blake3:this-is-not-a-valid-hash").otherwise(hashing.address(F.col("object_id").cast("string")))
    return versions.current(versions.readable(catalog.pointer_log(spark, sf_dir).withColumn("object_id", address)))


@query("trim_versions", f"WITH {LOG} SELECT pot, key, seq, object_id FROM (SELECT *, row_number() OVER (PARTITION BY pot, key ORDER BY seq DESC) AS r FROM log) WHERE r <= 3")
def trim_versions(spark, sf_dir):
    return versions.trimmed(catalog.pointer_log(spark, sf_dir).drop("created_at"), 3).select("pot", "key", "seq", "object_id")


@query(
    "rollback_append",
    f"""WITH {CURRENT} SELECT pot, key, seq, object_id FROM log UNION ALL
    SELECT log.pot, log.key, current.seq + 1, log.object_id FROM log JOIN current USING (pot, key) WHERE log.seq = 1 AND log.object_id % 3 = 0""",
)
def rollback_append(spark, sf_dir):
    log = catalog.pointer_log(spark, sf_dir)
    back = log.where((F.col("seq") == 1) & (F.col("object_id") % 3 == 0)).select("pot", "key", "object_id")
    return versions.restored(log, back, log)


@query(
    "copy_pointer",
    f"""WITH {CURRENT} SELECT pot, key, seq, object_id FROM log UNION ALL
    SELECT 'ARCHIVE', key, 1, object_id FROM current WHERE pot = 'BUILDING'""",
)
def copy_pointer(spark, sf_dir):
    log = catalog.pointer_log(spark, sf_dir)
    pairs = log.where("pot = 'BUILDING'").select("pot", "key", F.lit("ARCHIVE").alias("to_pot"), F.col("key").alias("to_key")).distinct()
    return versions.copied(log, pairs)


@query(
    "move_key",
    f"""WITH {LOG}, pairs AS (SELECT DISTINCT pot, key, pot AS to_pot, CAST(CAST(key AS BIGINT) + 1 AS VARCHAR) AS to_key FROM log WHERE pot = 'MACHINERY' AND CAST(key AS BIGINT) % 10 = 0)
    SELECT pot, key, seq, object_id FROM log WHERE (pot, key) NOT IN (SELECT (pot, key) FROM pairs) AND (pot, key) NOT IN (SELECT (to_pot, to_key) FROM pairs)
    UNION ALL SELECT to_pot, to_key, seq, object_id FROM log JOIN pairs USING (pot, key)""",
)
def move_key(spark, sf_dir):
    log = catalog.pointer_log(spark, sf_dir)
    pairs = log.where((F.col("pot") == "MACHINERY") & (F.col("key").cast("long") % 10 == 0)).select("pot", "key", F.col("pot").alias("to_pot"), (F.col("key").cast("long") + 1).cast("string").alias("to_key")).distinct()
    return versions.moved(log, pairs)


@query("rename_pot", f"WITH {LOG} SELECT CASE pot WHEN 'BUILDING' THEN 'HOUSES' ELSE pot END AS pot, key, seq, object_id FROM log")
def rename_pot(spark, sf_dir):
    return versions.renamed_pot(catalog.pointer_log(spark, sf_dir).drop("created_at"), "BUILDING", "HOUSES").select("pot", "key", "seq", "object_id")


@query(
    "delete_tombstone",
    f"""WITH {LOG}, ops AS (SELECT *, CASE WHEN object_id % 7 = 0 THEN 'delete' ELSE 'put' END AS op FROM log),
    dead AS (SELECT *, max(seq) FILTER (op = 'delete') OVER (PARTITION BY pot, key) AS d FROM ops)
    SELECT pot, key, seq, object_id FROM dead WHERE (d IS NULL OR seq > d) AND op <> 'delete'""",
)
def delete_tombstone(spark, sf_dir):
    log = catalog.pointer_log(spark, sf_dir).withColumn("op", F.when(F.col("object_id") % 7 == 0, "delete").otherwise("put"))
    return versions.live(log).select("pot", "key", "seq", "object_id")


@query(
    "object_head",
    f"""WITH {CURRENT}, {SIZES}, lists AS (SELECT l_orderkey AS object_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY {LINES}) AS chunks, count(*) AS n_chunks FROM lineitem GROUP BY l_orderkey)
    SELECT pot, key, object_id, coalesce(size, 0) AS size_bytes, coalesce(n_chunks, 0) AS n_chunks, coalesce(chunks, '') AS chunks FROM current LEFT JOIN sizes USING (object_id) LEFT JOIN lists USING (object_id)""",
)
def object_head(spark, sf_dir):
    rows = catalog.chunk_rows(spark, sf_dir).withColumn("l_partkey", F.col("chunk")).join(catalog.stored(spark, sf_dir), "chunk")
    heads = rows.groupBy("object_id").agg(F.sum("size").alias("size_bytes"), F.count("*").alias("n_chunks"), F.array_join(catalog.ordered(F.col("chunk").cast("string")), ",").alias("chunks"))
    now = versions.current(catalog.pointer_log(spark, sf_dir)).drop("seq")
    return now.join(heads, "object_id", "left").select("pot", "key", "object_id", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("chunks", F.lit("")).alias("chunks"))


@query("dangling_pointers", f"WITH {CURRENT} SELECT pot, key, seq, object_id FROM current WHERE object_id NOT IN (SELECT l_orderkey FROM lineitem)")
def dangling_pointers(spark, sf_dir):
    return versions.dangling(catalog.pointer_log(spark, sf_dir), catalog.chunk_rows(spark, sf_dir).select("object_id")).select("pot", "key", "seq", "object_id")


# Diffs and sync


@query(
    "diff_consecutive",
    f"""WITH {LISTS} SELECT pot, key, seq, len(list_filter(list_distinct(chunks), lambda x: NOT list_contains(before, x))) AS added,
    len(list_filter(list_distinct(before), lambda x: NOT list_contains(chunks, x))) AS removed, len(list_filter(list_distinct(chunks), lambda x: list_contains(before, x))) AS shared FROM steps""",
)
def diff_consecutive(spark, sf_dir):
    steps = sync.consecutive(catalog.brand_lists(spark, sf_dir))
    a, b = F.col("before"), F.col("chunks")
    return steps.select("pot", "key", "seq", sync.added(a, b).alias("added"), sync.added(b, a).alias("removed"), sync.shared(a, b).alias("shared"))


@query(
    "delta_bag",
    f"""WITH {LISTS} SELECT pot, key, seq, coalesce(list_aggregate(list_filter(chunks, lambda x: NOT list_contains(before, x)), 'string_agg', ','), '') AS add,
    coalesce(list_aggregate(list_filter(before, lambda x: NOT list_contains(chunks, x)), 'string_agg', ','), '') AS remove FROM steps""",
)
def delta_bag(spark, sf_dir):
    steps = sync.consecutive(catalog.brand_lists(spark, sf_dir))
    a, b = F.col("before"), F.col("chunks")
    return steps.select("pot", "key", "seq", F.array_join(sync.bag_delta(a, b), ",").alias("add"), F.array_join(sync.bag_delta(b, a), ",").alias("remove"))


@query("missing_chunks", "SELECT l_orderkey AS object_id, l_partkey AS chunk, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) GROUP BY ALL")
def missing_chunks(spark, sf_dir):
    have = catalog.stored(spark, sf_dir).where("chunk % 3 = 0")
    return sync.missing(catalog.chunk_rows(spark, sf_dir).select("object_id", "chunk"), have).groupBy("object_id", "chunk").agg(F.count("*").alias("n"))


@query(
    "sync_plan",
    f"""SELECT l_orderkey AS object_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY {LINES}) AS to_send, count(*) AS n_send FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) GROUP BY l_orderkey""",
)
def sync_plan(spark, sf_dir):
    have = catalog.stored(spark, sf_dir).where("chunk % 3 = 0")
    rows = sync.missing(catalog.chunk_rows(spark, sf_dir), have).withColumn("l_partkey", F.col("chunk"))
    return rows.groupBy("object_id").agg(F.array_join(catalog.ordered(F.col("chunk").cast("string")), ",").alias("to_send"), F.count("*").alias("n_send"))


@query("import_admissible", "SELECT l_orderkey AS object_id FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey % 3 = 0)")
def import_admissible(spark, sf_dir):
    return sync.importable(catalog.chunk_rows(spark, sf_dir).select("object_id", "chunk"), catalog.stored(spark, sf_dir).where("chunk % 3 = 0"))


# Content: addresses, trees, chunks


@query("dedup_exact", "SELECT 'sha256:' || sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_exact(spark, sf_dir):
    rows = catalog.read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", hashing.address(F.col("text")).alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


@query(
    "dedup_ratio_by_source",
    """SELECT source, CAST(sum(n) AS BIGINT) AS logical_bytes, CAST(sum(n / k) AS BIGINT) AS physical_bytes FROM (
    SELECT source, sha256(text) AS h, strlen(any_value(text)) * count(*) AS n, count(*) AS k FROM documents GROUP BY source, sha256(text)) GROUP BY source""",
)
def dedup_ratio_by_source(spark, sf_dir):
    rows = catalog.read(spark, sf_dir, "documents", "source", "text").select("source", F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("n"))
    once = rows.groupBy("source", "h").agg(F.max("n").alias("n"), F.count("*").alias("k"))
    return once.groupBy("source").agg(F.sum(F.col("n") * F.col("k")).alias("logical_bytes"), F.sum("n").alias("physical_bytes"))


@query("content_address", "SELECT doc_id, 'sha256:' || sha256(text) AS hash, substr(sha256(text), 1, 2) AS shard, substr(sha256(text), 1, 6) || '…' || substr(sha256(text), -4) AS short FROM documents")
def content_address(spark, sf_dir):
    hashed = catalog.read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", hashing.address(F.col("text")).alias("hash"))
    return hashed.select("doc_id", "hash", scalars.shard(F.col("hash")).alias("shard"), scalars.short_hash(F.col("hash")).alias("short"))


@query("merkle_root", f"WITH RECURSIVE {TREE} SELECT conv_id, n AS n_chunks, h[1] AS root FROM levels WHERE len(h) = 1")
def merkle_root(spark, sf_dir):
    return catalog.turns(spark, sf_dir).select("conv_id", F.size("chunks").cast("long").alias("n_chunks"), F.lower(F.hex(hashing.merkle_root(F.col("chunks")))).alias("root"))


@query("empty_root", "SELECT o_orderkey AS object_id, sha256(unhex('02')) AS root FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def empty_root(spark, sf_dir):
    orders = catalog.read(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("object_id"))
    bare = orders.join(catalog.chunk_rows(spark, sf_dir).select("object_id").distinct(), "object_id", "left_anti")
    return bare.select("object_id", F.lower(F.hex(hashing.merkle_root(F.array().cast("array<binary>")))).alias("root"))


@query(
    "merkle_proof_len",
    f"""WITH RECURSIVE {TREE}, places AS (SELECT conv_id, unnest(range(0, n)) AS i FROM leaves)
    SELECT p.conv_id, p.i AS index, count(*) FILTER (len(l.h) > 1 AND ((p.i >> l.depth) % 2 = 1 OR (p.i >> l.depth) + 1 < len(l.h))) AS steps
    FROM places p JOIN levels l USING (conv_id) GROUP BY p.conv_id, p.i""",
)
def merkle_proof_len(spark, sf_dir):
    rows = catalog.turns(spark, sf_dir).withColumn("index", F.explode(F.sequence(F.lit(0), F.size("chunks") - 1)))
    return rows.select("conv_id", F.col("index").cast("long").alias("index"), F.size(hashing.merkle_proof(F.col("chunks"), F.col("index"))).cast("long").alias("steps"))


@query("merkle_verify_all", "SELECT conv_id, count(*) AS verified, 0 AS forged FROM conversations GROUP BY conv_id")
def merkle_verify_all(spark, sf_dir):
    """Every turn's proof leads to the root, and no proof does from another turn's chunk."""
    rows = catalog.turns(spark, sf_dir).withColumn("root", hashing.merkle_root(F.col("chunks"))).withColumn("index", F.explode(F.sequence(F.lit(0), F.size("chunks") - 1)))
    rows = rows.withColumn("steps", hashing.merkle_proof(F.col("chunks"), F.col("index")))
    own, forged = F.get("chunks", F.col("index")), F.unhex(F.sha2(F.lit("forged"), 256))
    ok = [hashing.merkle_verify(c, F.col("steps"), F.col("root")).alias(n) for c, n in ((own, "good"), (forged, "bad"))]
    return rows.select("conv_id", *ok).groupBy("conv_id").agg(F.count_if("good").alias("verified"), F.count_if("bad").cast("int").alias("forged"))


CUT = (256, 1024, 4096)


@query("chunk_reassembly", "SELECT CAST(doc_id AS VARCHAR) AS object_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents WHERE strlen(text) > 0")
def chunk_reassembly(spark, sf_dir):
    whole = integrity.reassembled(chunk(catalog.document_objects(spark, sf_dir), *CUT))
    return whole.select("object_id", F.sha2("data", 256).alias("sha256"), F.octet_length("data").cast("long").alias("size_bytes"))


@query("chunk_bounds", f"SELECT CAST(doc_id AS VARCHAR) AS object_id, CAST(strlen(text) AS BIGINT) AS covered, true AS in_bounds FROM documents WHERE strlen(text) > 0")
def chunk_bounds(spark, sf_dir):
    """Chunks follow one another without gaps; all but the last keep to the least and largest size."""
    rows = chunk(catalog.document_objects(spark, sf_dir), *CUT, keep_data=False)
    by = rows.groupBy("object_id").agg(F.sum("length").alias("covered"), F.max("pos").alias("last"), F.collect_list(F.struct("pos", "length")).alias("x"))
    good = F.forall("x", lambda c: (c["length"] <= CUT[2]) & ((c["pos"] == F.col("last")) | (c["length"] >= CUT[0])))
    return by.select("object_id", "covered", good.alias("in_bounds"))


@query("chunk_dedup_stats")
def chunk_dedup_stats(spark, sf_dir):
    rows = chunk(catalog.document_objects(spark, sf_dir), *CUT, keep_data=False)
    once = rows.groupBy("hash").agg(F.max("length").alias("length"), F.count("*").alias("n"))
    return once.agg(F.sum(F.col("length") * F.col("n")).alias("logical_bytes"), F.sum("length").alias("physical_bytes"), F.count("*").alias("unique_chunks"), F.sum("n").alias("chunks"))


@query("ingest_manifests", "SELECT CAST(doc_id AS VARCHAR) AS object_id, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents")
def ingest_manifests(spark, sf_dir):
    objects = catalog.document_objects(spark, sf_dir)
    return maintenance.manifests(maintenance.ingested(objects, *CUT, keep_data=False), objects).select("object_id", "size_bytes", "sha256")


@query(
    "verify_objects",
    "SELECT CAST(conv_id AS VARCHAR) AS object_id, bool_and(conv_id % 5 <> 0 OR turn <> 1) AND conv_id % 7 <> 0 AS ok FROM conversations GROUP BY conv_id",
)
def verify_objects(spark, sf_dir):
    """Conversations as objects of one chunk a turn; every fifth has a chunk corrupted, every seventh a wrong digest."""
    rows = catalog.read(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("data", F.encode(F.concat_ws("/", "conv_id", "turn", "text"), "UTF-8")).withColumn("hash", hashing.address(F.col("data")))
    lists = rows.groupBy(F.col("conv_id").cast("string").alias("object_id")).agg(F.max("conv_id").alias("c"), F.array_sort(F.collect_list(F.struct("turn", "hash", "data"))).alias("x"))
    whole = F.aggregate("x", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["data"]))
    manifests = lists.select("object_id", F.when(F.col("c") % 7 == 0, "wrong").otherwise(F.sha2(whole, 256)).alias("sha256"), F.lit("exact").alias("fidelity"), F.transform("x", lambda p: p["hash"]).alias("chunks"))
    spoiled = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), F.lit("spoiled").cast("binary")).otherwise(F.col("data"))
    return integrity.verified(manifests, rows.select("hash", spoiled.alias("data")))


@query("object_roots", f"WITH RECURSIVE {TREE} SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'declared' ELSE h[1] END AS root FROM levels WHERE len(h) = 1")
def object_roots(spark, sf_dir):
    declared = F.when(F.col("conv_id") % 2 == 0, "declared")
    return catalog.turns(spark, sf_dir).select("conv_id", hashing.object_root(declared, F.col("chunks")).alias("root"))


@query(
    "import_checks",
    """SELECT CAST(conv_id AS VARCHAR) AS object_id, bool_and(conv_id % 4 <> 0 OR turn <> 1) AS whole, conv_id % 3 <> 0 AS root, conv_id % 5 <> 0 AS same_id FROM conversations GROUP BY conv_id""",
)
def import_checks(spark, sf_dir):
    """Conversations as objects to import: some lack a chunk, some declare another root, some another id."""
    rows = catalog.read(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("hash", hashing.address(F.concat_ws("/", "conv_id", "turn", "text")))
    lists = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "hash"))), lambda x: x["hash"]).alias("chunks"))
    root = F.lower(F.hex(hashing.merkle_root(F.transform("chunks", hashing.raw))))
    text, c = F.col("conv_id").cast("string"), F.col("conv_id")
    manifests = lists.select(text.alias("object_id"), F.when(c % 5 == 0, "other").otherwise(text).alias("declared_id"), "chunks", F.when(c % 3 == 0, "other").otherwise(root).alias("merkle_root"))
    return sync.import_checks(manifests, rows.where("conv_id % 4 <> 0 or turn <> 1"))


@query("understood_objects", "SELECT CAST(doc_id AS VARCHAR) AS object_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def understood_objects(spark, sf_dir):
    objects = catalog.document_objects(spark, sf_dir).withColumnRenamed("pot", "tenant")
    return search.understood(objects, search.length_and_sum).select("object_id", F.get("vector", 0).cast("long").alias("n_bytes"))


@query("ingest_size_cap", "SELECT count(*) AS objects, CAST(sum(strlen(text)) AS BIGINT) AS stored_bytes FROM documents WHERE strlen(text) BETWEEN 1 AND 5000")
def ingest_size_cap(spark, sf_dir):
    rows = maintenance.ingested(catalog.document_objects(spark, sf_dir), *CUT, keep_data=False, most_bytes=5000)
    return rows.agg(F.countDistinct("object_id").alias("objects"), F.sum("length").alias("stored_bytes"))


# Garbage collection and lifecycle

GC = f"""WITH {CURRENT}, kept AS (SELECT * FROM log WHERE CAST(key AS BIGINT) % 10 = 0 AND seq = (SELECT max(l.seq) FROM log l WHERE l.pot = log.pot AND l.key = log.key)),
    live AS (SELECT DISTINCT l_partkey AS chunk FROM lineitem WHERE l_orderkey IN (SELECT object_id FROM kept)),
    earlier AS (SELECT p_partkey AS chunk, CASE WHEN p_partkey % 2 = 0 THEN 1000 ELSE 1005 END AS condemned_at FROM part WHERE p_partkey % 4 < 3),"""
_NOW, _GRACE = 1011, 10


def _gc_tables(spark, sf_dir):
    log = catalog.pointer_log(spark, sf_dir).where(F.col("key").cast("long") % 10 == 0)
    now = versions.current(log)
    return now, catalog.chunk_rows(spark, sf_dir).select("object_id", "chunk"), catalog.stored(spark, sf_dir)


@query("gc_mark", f"{GC} x AS (SELECT 1) SELECT chunk FROM live")
def gc_mark(spark, sf_dir):
    log, rows, _ = _gc_tables(spark, sf_dir)
    return gc.reachable(log, rows)


@query(
    "gc_mark_history",
    f"WITH {LOG} SELECT DISTINCT l_partkey AS chunk FROM lineitem JOIN log ON l_orderkey = object_id WHERE CAST(key AS BIGINT) % 10 = 0 UNION SELECT p_partkey FROM part WHERE p_partkey % 100 = 1",
)
def gc_mark_history(spark, sf_dir):
    """Older versions keep chunks alive, and so do pins."""
    log = catalog.pointer_log(spark, sf_dir).where(F.col("key").cast("long") % 10 == 0)
    return gc.reachable(log, catalog.chunk_rows(spark, sf_dir).select("object_id", "chunk"), catalog.stored(spark, sf_dir).where("chunk % 100 = 1"))


@query("gc_first_sweep", f"{GC} x AS (SELECT 1) SELECT count(*) FILTER (chunk IS NOT NULL) AS live, count(*) FILTER (chunk IS NULL) AS condemned, 0::BIGINT AS erased FROM part LEFT JOIN live ON p_partkey = chunk")
def gc_first_sweep(spark, sf_dir):
    log, rows, stored = _gc_tables(spark, sf_dir)
    nothing = spark.createDataFrame([], "chunk long, condemned_at long")
    return gc.sweep_counts(gc.swept(stored, gc.reachable(log, rows), nothing, _NOW, 0))


_SWEEP = f"""SELECT p_partkey AS chunk, CAST(CASE WHEN live.chunk IS NOT NULL THEN NULL ELSE coalesce(condemned_at, {_NOW}) END AS BIGINT) AS condemned_at,
    CASE WHEN live.chunk IS NOT NULL THEN 'live' WHEN condemned_at IS NULL THEN 'condemned' WHEN {_NOW} - condemned_at >= {_GRACE} THEN 'erased' ELSE 'waiting' END AS state
    FROM part LEFT JOIN live ON p_partkey = live.chunk LEFT JOIN earlier ON p_partkey = earlier.chunk"""


def _earlier(spark, sf_dir):
    return catalog.stored(spark, sf_dir).where("chunk % 4 < 3").select("chunk", F.when(F.col("chunk") % 2 == 0, 1000).otherwise(1005).cast("long").alias("condemned_at"))


@query("gc_after_grace", f"{GC} x AS (SELECT 1) {_SWEEP}")
def gc_after_grace(spark, sf_dir):
    log, rows, stored = _gc_tables(spark, sf_dir)
    return gc.swept(stored, gc.reachable(log, rows), _earlier(spark, sf_dir), _NOW, _GRACE)


@query("gc_resurrect", f"{GC} x AS (SELECT 1) SELECT chunk FROM live JOIN earlier USING (chunk)")
def gc_resurrect(spark, sf_dir):
    """Condemned chunks that a version reaches again are pardoned."""
    log, rows, _ = _gc_tables(spark, sf_dir)
    return _earlier(spark, sf_dir).select("chunk").join(gc.reachable(log, rows), "chunk", "left_semi")


@query("lifecycle_expire", f"WITH {CURRENT} SELECT pot, key, object_id FROM current WHERE epoch(TIMESTAMP '2001-08-01') - epoch(created_at) > 365 * 86400")
def lifecycle_expire(spark, sf_dir):
    return gc.expired(catalog.pointer_log(spark, sf_dir), F.lit(365), F.lit("2001-08-01").cast("timestamp")).select("pot", "key", "object_id")


@query(
    "lifecycle_trim",
    f"""WITH {CURRENT}, gone AS (SELECT pot, key FROM current WHERE epoch(TIMESTAMP '2001-08-01') - epoch(created_at) > 365 * 86400)
    SELECT pot, key, seq, object_id FROM (SELECT *, row_number() OVER (PARTITION BY pot, key ORDER BY seq DESC) AS r FROM log WHERE (pot, key) NOT IN (SELECT (pot, key) FROM gone)) WHERE r <= 2""",
)
def lifecycle_trim(spark, sf_dir):
    return gc.lifecycle(catalog.pointer_log(spark, sf_dir), 365, 2, F.lit("2001-08-01").cast("timestamp")).select("pot", "key", "seq", "object_id")


@query(
    "maintenance_run",
    f"""{GC} gone AS (SELECT pot, key FROM current WHERE epoch(TIMESTAMP '2001-08-01') - epoch(created_at) > 365 * 86400),
    rest AS (SELECT object_id FROM (SELECT *, row_number() OVER (PARTITION BY pot, key ORDER BY seq DESC) AS r FROM log WHERE (pot, key) NOT IN (SELECT (pot, key) FROM gone)) WHERE r <= 2),
    held AS (SELECT DISTINCT l_partkey AS chunk FROM lineitem WHERE l_orderkey IN (SELECT object_id FROM rest))
    {_SWEEP.replace("live.chunk", "held.chunk").replace("LEFT JOIN live", "LEFT JOIN held")}""",
)
def maintenance_run(spark, sf_dir):
    log, rows, stored = catalog.pointer_log(spark, sf_dir), catalog.chunk_rows(spark, sf_dir).select("object_id", "chunk"), catalog.stored(spark, sf_dir)
    return maintenance.maintained(log, rows, stored, _earlier(spark, sf_dir), 365, 2, F.lit("2001-08-01").cast("timestamp"), _NOW, _GRACE)


# Policy and access

_CONFIG = "('BUILDING', true, 'none', NULL, 'perceptual', true), ('MACHINERY', false, NULL, 19, NULL, false), ('FURNITURE', NULL, NULL, NULL, NULL, NULL)"


def _configs(spark):
    return spark.sql(f"SELECT * FROM VALUES {_CONFIG} AS t(pot, public_read, codec, zstd_level, fidelity, route_by_content_type)").select("pot", "public_read", F.col("codec").cast("string").alias("codec"), F.col("zstd_level").cast("int").alias("zstd_level"), F.col("fidelity").cast("string").alias("fidelity"), "route_by_content_type")


@query(
    "effective_policy",
    f"""WITH cfg(pot, public_read, codec, zstd_level, fidelity, routed) AS (VALUES {_CONFIG})
    SELECT c_custkey, coalesce(codec, 'zstd') AS codec, coalesce(zstd_level, 3) AS zstd_level, CASE WHEN fidelity = 'perceptual' THEN 'perceptual' ELSE 'exact' END AS fidelity,
        CASE WHEN coalesce(routed, false) AND c_custkey % 2 = 0 THEN 'image' ELSE 'blob' END AS route FROM customer LEFT JOIN cfg ON c_mktsegment = pot""",
)
def effective_policy(spark, sf_dir):
    rows = catalog.read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").withColumnRenamed("c_mktsegment", "pot").join(_configs(spark), "pot", "left")
    kind = F.when(F.col("c_custkey") % 2 == 0, "image/png").otherwise("text/plain")
    return rows.select("c_custkey", *policy.effective(F.col("codec"), F.col("zstd_level"), F.col("fidelity"), F.col("route_by_content_type"), kind))


@query(
    "authorize_matrix",
    f"""WITH cfg(pot, public_read, codec, zstd_level, fidelity, routed) AS (VALUES {_CONFIG}),
    keys(access_key, read_only, pots) AS (VALUES ('k0', false, CAST([] AS VARCHAR[])), ('k1', true, []), ('k2', false, ['BUILDING', 'AUTOMOBILE']), ('k3', true, ['MACHINERY'])),
    req AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 5 < 4 THEN 'k' || (c_custkey % 5) END AS access_key, c_mktsegment AS pot, CASE WHEN c_custkey % 3 = 0 THEN 'write' ELSE 'read' END AS action FROM customer)
    SELECT request_id, CASE WHEN read_only IS NOT NULL THEN NOT (read_only AND action <> 'read') AND (len(pots) = 0 OR list_contains(pots, pot)) ELSE action = 'read' AND coalesce(public_read, false) END AS allowed
    FROM req LEFT JOIN keys USING (access_key) LEFT JOIN cfg USING (pot)""",
)
def authorize_matrix(spark, sf_dir):
    keys = spark.createDataFrame([("k0", False, []), ("k1", True, []), ("k2", False, ["BUILDING", "AUTOMOBILE"]), ("k3", True, ["MACHINERY"])], "access_key string, read_only boolean, pots array<string>")
    c = catalog.read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    number = F.col("c_custkey") % 5
    requests = c.select(F.col("c_custkey").alias("request_id"), F.when(number < 4, F.concat(F.lit("k"), number.cast("string"))).alias("access_key"), F.col("c_mktsegment").alias("pot"), F.when(F.col("c_custkey") % 3 == 0, "write").otherwise("read").alias("action"))
    return policy.decisions(requests, keys, _configs(spark))


@query(
    "lock_check",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN false WHEN 1 THEN false ELSE quality = 1 END AS locked FROM labels""",
)
def lock_check(spark, sf_dir):
    """No lock, an unreadable lock, and locks that end at or a second after now."""
    until = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, "not a time").when(F.col("quality") == 1, "2026-01-01T00:00:01Z").otherwise("2026-01-01T00:00:00Z")
    now = F.unix_timestamp(F.lit("2026-01-01T00:00:00Z").cast("timestamp"))
    return catalog.read(spark, sf_dir, "labels", "doc_id", "quality").select("doc_id", scalars.locked(until, now).alias("locked"))


_HOOKS = [("h0", []), ("h1", ["*"]), ("h2", ["purchase"]), ("h3", ["signup", "error"]), ("h4", ["none"])]


def _hooks(spark):
    return spark.createDataFrame([(i, f"https://example.org/{i}", e) for i, e in _HOOKS], "id string, url string, events array<string>")


@query(
    "webhook_fanout",
    """WITH hooks(id, kinds) AS (VALUES ('h0', CAST([] AS VARCHAR[])), ('h1', ['*']), ('h2', ['purchase']), ('h3', ['signup', 'error']), ('h4', ['none']))
    SELECT id, event_type, count(*) AS n FROM events JOIN hooks ON len(kinds) = 0 OR list_contains(kinds, event_type) OR list_contains(kinds, '*') GROUP BY ALL""",
)
def webhook_fanout(spark, sf_dir):
    return policy.deliveries(catalog.read(spark, sf_dir, "events", "event_type"), _hooks(spark), "event_type").groupBy("id", "event_type").agg(F.count("*").alias("n"))


@query(
    "auto_tags",
    """SELECT doc_id, CAST(quality AS VARCHAR) AS auto0, CAST(toxic AS VARCHAR) AS auto1, 'kept' AS own, CASE WHEN doc_id % 2 = 0 THEN 'mine' ELSE 'suggested' END AS note FROM labels""",
)
def auto_tags(spark, sf_dir):
    rows = catalog.read(spark, sf_dir, "labels", "doc_id", "quality", "toxic").select(
        "doc_id", F.create_map(F.lit("own"), F.lit("kept"), F.lit("auto:0"), F.lit("old")).alias("tags"), F.when(F.col("doc_id") % 2 == 0, "mine").alias("note"),
        F.array(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("suggested"), F.lit("suggested").alias("suggested_note"),
    )
    return policy.auto_tagged(rows).select("doc_id", F.col("tags")["auto:0"].alias("auto0"), F.col("tags")["auto:1"].alias("auto1"), F.col("tags")["own"].alias("own"), "note")


@query(
    "byte_ranges",
    """WITH r(i, a, b) AS (VALUES (0, 0, 9), (1, 10, NULL), (2, NULL, 20), (3, 5, 3), (4, 1000000000, NULL)), d AS (SELECT doc_id, strlen(text) AS n, doc_id % 6 AS i FROM documents),
    x AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN greatest(0, n - b) ELSE a END AS s, CASE WHEN a IS NULL OR b IS NULL THEN n - 1 ELSE least(b, n - 1) END AS e FROM d JOIN r USING (i))
    SELECT doc_id, s AS first, e AS last FROM x WHERE s <= e AND s < n""",
)
def byte_ranges(spark, sf_dir):
    headers = F.array(*map(F.lit, ("bytes=0-9", "bytes=10-", "bytes=-20", "bytes=5-3", "bytes=1000000000-", "garbage")))
    rows = catalog.read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", scalars.byte_range(F.get(headers, (F.col("doc_id") % 6).cast("int")), F.octet_length("text").cast("long")).alias("x"))
    return rows.where("x is not null").select("doc_id", "x.first", "x.last")


@query(
    "etag_match",
    """SELECT doc_id, doc_id % 4 <> 3 AS matches, CASE WHEN doc_id % 2 = 0 THEN 'public, max-age=31536000, immutable' ELSE 'public, max-age=60, must-revalidate' END AS cache FROM documents""",
)
def etag_match(spark, sf_dir):
    tagged = catalog.read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", scalars.etag(hashing.address(F.col("text"))).alias("tag"))
    n = F.col("doc_id") % 4
    header = F.when(n == 0, "*").when(n == 1, F.col("tag")).when(n == 2, F.concat(F.lit('"other", '), F.col("tag"), F.lit(" "))).otherwise('"other"')
    return tagged.select("doc_id", scalars.etag_matches(header, F.col("tag")).alias("matches"), scalars.cache_control(F.col("doc_id") % 2 == 0).alias("cache"))


@query(
    "request_parsing",
    """SELECT conv_id, turn, role AS method, CAST(turn AS VARCHAR) AS part, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, turn + 1 AS second_part FROM conversations""",
)
def request_parsing(spark, sf_dir):
    rows = catalog.read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    q = scalars.query_map(F.concat(F.lit("method=old&method="), "role", F.lit("&uploads&partNumber="), F.col("turn").cast("string")))
    body = F.concat(F.lit("<Part><PartNumber>"), F.col("turn").cast("string"), F.lit("</PartNumber></Part><Part><PartNumber> "), (F.col("turn") + 1).cast("string"), F.lit(" </PartNumber></Part>"))
    rows = rows.withColumn("q", q).withColumn("p", scalars.part_numbers(body))
    return rows.select("conv_id", "turn", F.col("q")["method"].alias("method"), F.col("q")["partNumber"].alias("part"), scalars.xml_escaped(F.col("text")).alias("escaped"), F.get("p", 1).cast("long").alias("second_part"))


@query("error_statuses", "SELECT conv_id, turn, [200, 400, 400, 400, 400, 500, 409, 413, 403][turn % 9 + 1] AS status FROM conversations")
def error_statuses(spark, sf_dir):
    names = F.array(*map(F.lit, (None, "InvalidKey", "InvalidPart", "BadBucket", "Upload", "Dangling", "Locked", "TooLarge", "Forbidden")))
    return catalog.read(spark, sf_dir, "conversations", "conv_id", "turn").select("conv_id", "turn", scalars.status_of(F.get(names, (F.col("turn") % 9).cast("int"))).alias("status"))


@query("valid_names", "SELECT page_id, strlen(url) > 0 AND 2 * strlen('pages') + 2 * strlen(url) + 6 <= 255 AS key_ok, NOT contains(url, '/') AND NOT contains(url, chr(92)) AND url NOT IN ('', '.', '..') AS pot_ok FROM pages")
def valid_names(spark, sf_dir):
    rows = catalog.read(spark, sf_dir, "pages", "page_id", "url")
    return rows.select("page_id", scalars.valid_key(F.lit("pages"), F.col("url")).alias("key_ok"), scalars.valid_pot(F.col("url")).alias("pot_ok"))


_KEYS = [("a", "sa", True, []), ("b", "sb", False, []), ("c", "sc", False, ["BUILDING"]), ("d", "sd", False, [])]


def _access_keys(spark):
    return spark.createDataFrame([(*k, "2026-01-01T00:00:00Z") for k in _KEYS], "access_key string, secret_key string, read_only boolean, pots array<string>, created_at string")


@query(
    "key_listing",
    """SELECT * FROM (VALUES ('a', true, 0, false), ('b', false, 0, true), ('c', false, 1, false), ('d', false, 0, true)) t(access_key, read_only, n_pots, owner)""",
)
def key_listing(spark, sf_dir):
    return access.redacted(_access_keys(spark)).select("access_key", "read_only", F.size("pots").alias("n_pots"), "owner")


@query("signing_secret", "SELECT 'sb' AS secret")
def signing_secret(spark, sf_dir):
    return access.signing_secret(_access_keys(spark))


@query("presigned_links", "SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 2 = 0 AS valid FROM documents")
def presigned_links(spark, sf_dir):
    """Links of documents: every third has run out, every other has a forged signature."""
    rows = catalog.read(spark, sf_dir, "documents", "doc_id", "source").crossJoin(F.broadcast(access.signing_secret(_access_keys(spark))))
    expires, key = F.when(F.col("doc_id") % 3 == 0, 99).otherwise(100), F.col("doc_id").cast("string")
    given = scalars.presigned(F.col("secret"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, key).otherwise("forged"), expires)
    return rows.select("doc_id", scalars.presign_valid(F.col("secret"), F.col("source"), key, expires, given, F.lit(100)).alias("valid"))


@query(
    "webhook_ids",
    """SELECT page_id, substr(sha256(url || ':' || (1700000000 + page_id)), 1, 16) AS id FROM pages""",
)
def webhook_ids(spark, sf_dir):
    return catalog.read(spark, sf_dir, "pages", "page_id", "url").select("page_id", access.webhook_id(F.col("url"), F.col("page_id") + 1700000000).alias("id"))


@query(
    "metrics_lines",
    """SELECT name, 'catalog_' || name || ' ' || value AS line FROM (SELECT 'unique_chunks' AS name, count(*) AS value FROM part UNION ALL SELECT 'physical_bytes', CAST(sum(p_size) AS BIGINT) FROM part)""",
)
def metrics_lines(spark, sf_dir):
    return access.metrics(catalog.stored(spark, sf_dir).agg(F.count("*").alias("unique_chunks"), F.sum("size").alias("physical_bytes")))


@query(
    "annotation_upsert",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS note, quality = 1 AS favorite FROM labels WHERE doc_id % 7 <> 0 OR doc_id % 5 = 0""",
)
def annotation_upsert(spark, sf_dir):
    rows = catalog.read(spark, sf_dir, "labels", "doc_id", "quality").select("doc_id", F.lit("old").alias("note"), (F.col("quality") == 1).alias("favorite"))
    return versions.upserted(rows.where("doc_id % 7 <> 0"), rows.where("doc_id % 5 = 0").withColumn("note", F.lit("new")), "doc_id")


@query(
    "annotation_defaults",
    """SELECT d.doc_id, coalesce(quality = 1, false) AS favorite, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, '') AS note FROM documents d LEFT JOIN labels USING (doc_id)""",
)
def annotation_defaults(spark, sf_dir):
    notes = catalog.read(spark, sf_dir, "labels", "doc_id", "quality", "toxic").select("doc_id", (F.col("quality") == 1).alias("favorite"), F.when(F.col("toxic") == 1, "toxic").alias("note"))
    return versions.with_default(catalog.read(spark, sf_dir, "documents", "doc_id"), notes, "doc_id", {"favorite": F.lit(False), "note": F.lit("")})


@query("droppable_pots", f"WITH {LOG} SELECT n_name AS pot FROM nation WHERE n_name NOT IN (SELECT pot FROM log)")
def droppable_pots(spark, sf_dir):
    return versions.droppable_pots(catalog.read(spark, sf_dir, "nation").select(F.col("n_name").alias("pot")), catalog.pointer_log(spark, sf_dir))


@query("has_chunks", "SELECT item_id, 'sha256:' || sha256(text) IN (SELECT 'sha256:' || sha256(text) FROM documents) AS there FROM benchmark UNION ALL SELECT -1, true")
def has_chunks(spark, sf_dir):
    have = catalog.read(spark, sf_dir, "documents", "text").select(hashing.address(F.col("text")).alias("hash")).distinct().withColumn("_there", F.lit(True))
    wanted = catalog.read(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", hashing.address(F.col("text")).alias("hash"))
    first = catalog.read(spark, sf_dir, "documents", "doc_id", "text").where("doc_id = 0").select(F.lit(-1).cast("long").alias("item_id"), hashing.address(F.col("text")).alias("hash"))
    return wanted.unionByName(first).join(have, "hash", "left").select("item_id", F.col("_there").isNotNull().alias("there"))


@query(
    "chunk_offsets",
    f"""SELECT object_id, chunk, CAST(coalesce(sum(size) OVER (PARTITION BY object_id ORDER BY {LINES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM (SELECT l_orderkey AS object_id, l_partkey AS chunk, p_size AS size, {LINES} FROM lineitem JOIN part ON l_partkey = p_partkey)""",
)
def chunk_offsets(spark, sf_dir):
    rows = catalog.chunk_rows(spark, sf_dir).withColumn("l_partkey", F.col("chunk")).join(catalog.stored(spark, sf_dir), "chunk")
    return listing.chunk_offsets(rows, *catalog.LINE_ORDER).select("object_id", "chunk", "offset")


# Search


def _vectors(spark, sf_dir):
    e = catalog.read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("label").cast("string").alias("tenant"), F.col("vec_id").alias("object_id"), F.col("embedding").alias("vector"))


_QUERY = [1.0 if k % 3 == 0 else -0.5 for k in range(64)]
_Q = "[" + ", ".join(map(str, _QUERY)) + "]::DOUBLE[]"
_SCORE = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q})"


@query("topk_cosine", f"SELECT vec_id AS object_id, round({_SCORE}, 6) AS score FROM embeddings ORDER BY {_SCORE} DESC, vec_id LIMIT 10")
def topk_cosine(spark, sf_dir):
    return search.top_k(_vectors(spark, sf_dir), _QUERY).withColumn("score", F.round("score", 6))


@query("tenant_scoped_search", f"SELECT vec_id AS object_id, round({_SCORE}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_SCORE} DESC, vec_id LIMIT 10")
def tenant_scoped_search(spark, sf_dir):
    return search.top_k(_vectors(spark, sf_dir), _QUERY, tenant="3").withColumn("score", F.round("score", 6))


@query(
    "similar_to",
    """WITH q AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score FROM embeddings JOIN q USING (label))
    SELECT vec_id AS object_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10""",
)
def similar_to(spark, sf_dir):
    return search.similar(_vectors(spark, sf_dir), 7).withColumn("score", F.round("score", 6))


@query(
    "search_enriched",
    f"""WITH hits AS (SELECT vec_id AS object_id, round({_SCORE}, 6) AS score FROM embeddings ORDER BY {_SCORE} DESC, vec_id LIMIT 50)
    SELECT object_id, score, source AS pot, lang || '/' || doc_id AS key FROM hits LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) ON doc_id = object_id""",
)
def search_enriched(spark, sf_dir):
    hits = search.top_k(_vectors(spark, sf_dir), _QUERY, 50).withColumn("score", F.round("score", 6))
    d = catalog.read(spark, sf_dir, "documents", "doc_id", "source", "lang").where("doc_id % 2 = 0")
    places = d.select(F.col("doc_id").alias("object_id"), F.lit(0).alias("seq"), F.col("source").alias("pot"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("key"))
    return search.enriched(hits, versions.first_location(places))


@query(
    "hits_by_pot",
    f"""WITH hits AS (SELECT vec_id AS object_id, {_SCORE} AS score FROM embeddings ORDER BY {_SCORE} DESC, vec_id LIMIT 50)
    SELECT coalesce(source, 'unknown') AS pot, count(*) AS n, string_agg(CAST(object_id AS VARCHAR), ',' ORDER BY score DESC, object_id) AS objects
    FROM hits LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) ON doc_id = object_id GROUP BY 1""",
)
def hits_by_pot(spark, sf_dir):
    d = catalog.read(spark, sf_dir, "documents", "doc_id", "source").where("doc_id % 2 = 0").select(F.col("doc_id").alias("object_id"), F.col("source").alias("pot"))
    found = listing.hits_by_pot(search.enriched(search.top_k(_vectors(spark, sf_dir), _QUERY, 50), d))
    return found.withColumn("objects", F.array_join(F.transform("objects", lambda x: x.cast("string")), ","))


# Multipart


@query(
    "multipart_complete",
    """SELECT CAST(conv_id AS VARCHAR) AS upload_id, count(*) AS n_parts, true AS ok, CAST(sum(strlen(text)) AS BIGINT) AS size, sha256(string_agg(text, '' ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id""",
)
def multipart_complete(spark, sf_dir):
    rows = catalog.read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    found = rows.select(F.col("conv_id").cast("string").alias("upload_id"), F.col("turn").cast("int").alias("part_number"), F.lit(1).alias("seq"), F.encode("text", "UTF-8").alias("data"))
    stale = found.where("part_number = 1").withColumn("seq", F.lit(0)).withColumn("data", F.lit("stale").cast("binary"))
    return multipart.completed(multipart.parts(found.unionByName(stale)))


@query(
    "multipart_ordered",
    """WITH o AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, 0 AS pos, last AS turn FROM o UNION ALL SELECT conv_id, 1, 0 FROM o UNION ALL SELECT conv_id, 2, 0 FROM o UNION ALL SELECT conv_id, 3, 99 FROM o WHERE conv_id % 4 = 0)
    SELECT CAST(conv_id AS VARCHAR) AS upload_id, count(*) AS n_parts, bool_and(text IS NOT NULL) AS ok, CASE WHEN bool_and(text IS NOT NULL) THEN sha256(string_agg(text, '' ORDER BY pos)) END AS sha256
    FROM w LEFT JOIN conversations USING (conv_id, turn) GROUP BY conv_id""",
)
def multipart_ordered(spark, sf_dir):
    """A client's own order: the last part first, the first one twice, and sometimes a part that was never sent."""
    rows = catalog.read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    found = rows.select(F.col("conv_id").cast("string").alias("upload_id"), F.col("turn").cast("int").alias("part_number"), F.encode("text", "UTF-8").alias("data"))
    last = rows.groupBy("conv_id").agg(F.max("turn").cast("int").alias("last"))
    order = F.concat(F.array("last", F.lit(0), F.lit(0)), F.when(F.col("conv_id") % 4 == 0, F.array(F.lit(99))).otherwise(F.array().cast("array<int>")))
    return multipart.completed(found, last.select(F.col("conv_id").cast("string").alias("upload_id"), order.alias("order"))).drop("size")


# Streams


@query("stream_event_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_event_counts(spark, sf_dir):
    return streams.finished(streams.daily_counts(streams.event_stream(spark, sf_dir)))


@query("stream_current_pointer", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) <> 'error' AS live FROM events WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY user_id")
def stream_current_pointer(spark, sf_dir):
    return streams.finished(streams.pointers(streams.event_stream(spark, sf_dir)))


@query("stream_uploads", "SELECT CAST(user_id AS VARCHAR) AS upload_id, count(*) FILTER (event_type <> 'error') AS n_parts FROM events GROUP BY user_id")
def stream_uploads(spark, sf_dir):
    """Users as uploads: each event but an error is a part; all end complete."""
    rows = streams.event_stream(spark, sf_dir).where("event_type <> 'error'")
    parts = rows.select(F.col("user_id").cast("string").alias("upload_id"), F.col("event_id").alias("seq"), F.lit("part").alias("op"), F.col("event_id").alias("part_number"), F.lit(1).cast("long").alias("size"))
    ends = streams.event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("upload_id"), F.lit(1 << 40).cast("long").alias("seq"), F.lit("complete").alias("op"), F.lit(0).cast("long").alias("part_number"), F.lit(0).cast("long").alias("size"))
    done = streams.finished(streams.uploads(parts.unionByName(ends)), "append")
    return done.groupBy("upload_id").agg(F.max("n_parts").alias("n_parts"))


@query(
    "stream_fanout",
    """WITH hooks(id, kinds) AS (VALUES ('h0', CAST([] AS VARCHAR[])), ('h1', ['*']), ('h2', ['purchase']), ('h3', ['signup', 'error']), ('h4', ['none']))
    SELECT id, event_id FROM events JOIN hooks ON len(kinds) = 0 OR list_contains(kinds, event_type) OR list_contains(kinds, '*')""",
)
def stream_fanout(spark, sf_dir):
    return streams.finished(streams.fan_out(streams.event_stream(spark, sf_dir).select("event_id", "event_type"), _hooks(spark)).select("id", "event_id"), "append")


_SEEN = "o AS (SELECT CAST(user_id AS VARCHAR) AS hash, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_type <> 'error' AS live, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS r FROM events)"


@query(
    "stream_gc_timer",
    f"""WITH RECURSIVE {_SEEN}, s(hash, r, since, erased_at) AS (
        SELECT hash, r, CASE WHEN live THEN -1 ELSE sec END, NULL::BIGINT FROM o WHERE r = 1 UNION ALL
        SELECT o.hash, o.r, CASE WHEN live THEN -1 WHEN since < 0 THEN sec WHEN sec - since >= 3600 THEN -1 ELSE since END, CASE WHEN NOT live AND since >= 0 AND sec - since >= 3600 THEN sec END
        FROM s JOIN o ON o.hash = s.hash AND o.r = s.r + 1)
    SELECT hash, erased_at FROM s WHERE erased_at IS NOT NULL""",
)
def stream_gc_timer(spark, sf_dir):
    """Users as chunks: an error is a sweep that finds the chunk dead, any other event one that finds it live."""
    rows = streams.event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("hash"), F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("live"))
    return streams.finished(streams.collected(rows, 3600), "append")


@query(
    "stream_gc_expiry",
    """WITH o AS (SELECT CAST(user_id AS VARCHAR) AS hash, epoch_ms(ts) AS ms, event_type <> 'error' AS live FROM events), alive AS (SELECT hash, max(ms) FILTER (live) AS last FROM o GROUP BY hash),
    dead AS (SELECT o.hash, min(ms) AS since FROM o JOIN alive USING (hash) WHERE NOT live AND (last IS NULL OR ms > last) GROUP BY o.hash)
    SELECT hash, (since + 3600000) // 1000 AS erased_at FROM dead WHERE since + 3600000 < (SELECT max(ms) FROM o)""",
)
def stream_gc_expiry(spark, sf_dir):
    """The same by timers: a chunk last seen dead goes when the clock passes its grace time, without being seen again."""
    at = F.col("ts")
    rows = streams.event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("hash"), at.alias("at"), F.unix_millis(at).alias("ms"), (F.col("event_type") != "error").alias("live"))
    return streams.finished(streams.expiring(rows, 3600), "append")


@query(
    "stream_understanding",
    """SELECT CAST(user_id AS VARCHAR) AS object_id, CAST(strlen(arg_max(props, event_id)) AS BIGINT) AS n_bytes, arg_max(event_type, event_id) AS auto0,
        arg_max(CAST(event_id AS VARCHAR), event_id) FILTER (event_id % 2 = 0) AS auto1 FROM events GROUP BY user_id""",
)
def stream_understanding(spark, sf_dir):
    """Users as objects, events as writes of one or two tags: the last vector counts, and tags are merged."""
    event = streams.event_stream(spark, sf_dir)
    tags = F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.col("event_id").cast("string"))).otherwise(F.array("event_type"))
    writes = event.select(F.col("event_id").alias("seq"), F.lit("t").alias("tenant"), F.col("user_id").cast("string").alias("object_id"), F.encode("props", "UTF-8").alias("data"), tags.alias("tags"))
    found = spark.read.parquet(streams.understanding(writes, search.length_and_sum, streams.folder(spark)))
    return found.select("object_id", F.get("vector", 0).cast("long").alias("n_bytes"), F.col("tags")["auto:0"].alias("auto0"), F.col("tags")["auto:1"].alias("auto1"))


from lodestrata import store_queries  # noqa: E402, F401  more queries, which use the tables above
