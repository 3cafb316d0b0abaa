"""Catalog queries of stored manifests, chunks, pots and requests; see queries.py."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrata.functions import codecs, hashing, requests, scalars
from lodestrata.operators import gc, listing, manifests, store
from lodestrata.queries import _GRACE, _NOW, GC, LOG, _earlier, _gc_tables, query
from lodestrata.sources import catalog
from lodestrata.streaming import events as streams


def _manifests(spark, sf_dir):
    """A manifest for each document, one chunk each; every other has a Merkle root."""
    d = catalog.read(spark, sf_dir, "documents", "doc_id", "source", "text").withColumn("text", F.coalesce("text", F.lit("")))
    digest = F.sha2("text", 256)
    return d.select(
        "doc_id", F.lit(1).alias("manifest_version"), F.lit(None).cast("string").alias("object_id"), F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.struct(F.octet_length("text").cast("long").alias("size_bytes"), digest.alias("sha256"), F.lit("text/plain").alias("content_type")).alias("original"),
        F.struct(F.lit("blob").alias("route"), F.lit("exact").alias("fidelity"), F.lit("zstd").alias("codec"), F.lit('{"level":3}').alias("codec_params"), F.octet_length("text").cast("long").alias("stored_size_bytes"), F.lit(True).alias("reconstructs_original")).alias("storage"),
        F.struct(F.lit("fastcdc").alias("algo"), F.array(F.concat(F.lit("sha256:"), digest)).alias("chunks"), F.when(F.col("doc_id") % 2 == 0, digest).alias("merkle_root")).alias("chunking"),
        F.struct(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("score")).alias("quality"), F.col("source").alias("tenant"), F.lit("default").alias("policy_snapshot"),
    )


_ID = """'sha256:' || sha256('{"chunking":{"algo":"fastcdc","chunks":["sha256:' || h || '"]' || CASE WHEN doc_id % 2 = 0 THEN ',"merkle_root":"' || h || '"' ELSE '' END ||
    '},"created_at":"2024-01-01T00:00:00Z","manifest_version":' || v || ',"original":{"content_type":"text/plain","sha256":"' || h || '","size_bytes":' || n ||
    '},"policy_snapshot":"default","quality":{"metric":null,"score":null},"storage":{"codec":"zstd","codec_params":{"level":3},"fidelity":"exact","reconstructs_original":true,"route":"blob","stored_size_bytes":' || n ||
    '},"tenant":"' || source || '"}')"""
_DOCS = "d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n, 1 AS v FROM documents)"


@query("manifest_identity", f"WITH {_DOCS} SELECT doc_id, {_ID} AS object_id FROM d")
def manifest_identity(spark, sf_dir):
    """Canonical JSON with sorted keys, hashed."""
    return manifests.identified(_manifests(spark, sf_dir)).select("doc_id", "object_id")


@query(
    "manifest_read",
    f"WITH {_DOCS} SELECT {_ID} AS object_id, CASE WHEN doc_id % 7 = 0 THEN 'corrupt' WHEN doc_id % 5 = 0 THEN 'newer' WHEN doc_id % 3 = 0 THEN 'integrity' ELSE 'ok' END AS status, count(*) AS n FROM d GROUP BY ALL",
)
def manifest_read(spark, sf_dir):
    """Stored manifests, some cut short, some of a newer version (judged before their id), some tampered with."""
    good = manifests.identified(_manifests(spark, sf_dir))
    k = F.col("doc_id")
    changed = good.withColumn("manifest_version", F.when(k % 5 == 0, 2).otherwise(F.col("manifest_version"))).withColumn("tenant", F.when(k % 3 == 0, "other").otherwise(F.col("tenant")))
    json = F.to_json(F.struct("manifest_version", "object_id", "created_at", "original", "storage", "chunking", "quality", "tenant", "policy_snapshot"), {"ignoreNullFields": "false"})
    stored = changed.select("object_id", F.when(k % 7 == 0, F.lit("{")).otherwise(json).alias("json"))
    return manifests.read(stored).groupBy("object_id", "status").agg(F.count("*").alias("n"))


@query("manifest_by_id", f"WITH {_DOCS} SELECT {_ID} AS object_id, source AS tenant, n AS size_bytes, 'ok' AS status FROM d WHERE doc_id = 3")
def manifest_by_id(spark, sf_dir):
    known = manifests.identified(_manifests(spark, sf_dir))
    asked = known.where("doc_id = 3").first()["object_id"]
    return manifests.by_id(manifests.stored_json(known), asked).select("object_id", "tenant", F.col("original.size_bytes").alias("size_bytes"), "status").distinct()


@query("manifest_put", f"WITH {_DOCS} SELECT DISTINCT {_ID} AS object_id FROM d WHERE {_ID} NOT IN (SELECT {_ID} FROM d WHERE doc_id % 4 = 0)")
def manifest_put(spark, sf_dir):
    """A quarter of the manifests is stored already."""
    rows = _manifests(spark, sf_dir)
    return manifests.put(manifests.stored_json(manifests.identified(rows.where("doc_id % 4 = 0"))), rows).select("object_id")


@query(
    "commit_order",
    f"""WITH {_DOCS}, ids AS (SELECT doc_id, source, lang, {_ID} AS object_id FROM d) SELECT source AS pot, lang || '/' || doc_id AS key, 1::BIGINT AS seq, object_id FROM ids WHERE object_id IN (SELECT object_id FROM ids WHERE doc_id % 4 = 0)""",
)
def commit_order(spark, sf_dir):
    """Pointers of objects whose manifest isn't stored are not written."""
    ids = manifests.identified(_manifests(spark, sf_dir)).join(catalog.read(spark, sf_dir, "documents", "doc_id", "lang"), "doc_id")
    writes = ids.select(F.col("tenant").alias("pot"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("key"), "object_id")
    log, locations = spark.createDataFrame([], "pot string, key string, seq long, object_id string"), spark.createDataFrame([], "object_id string, seq long, pot string, key string")
    return manifests.committed(log, locations, ids.where("doc_id % 4 = 0"), writes)[0].withColumn("seq", F.col("seq").cast("long"))


@query(
    "locations_ordered",
    """WITH l AS (SELECT DISTINCT 'sha256:' || sha256(coalesce(text, '')) AS object_id, source AS pot, lang AS key, source = 'src1' AS old FROM documents)
    SELECT object_id, string_agg(pot || '/' || key, ',' ORDER BY CASE WHEN old THEN 0 ELSE 1 END, pot, key) AS places FROM l GROUP BY object_id""",
)
def locations_ordered(spark, sf_dir):
    """Places of one source are recorded first; the others are appended after them, each once."""
    rows = catalog.read(spark, sf_dir, "documents", "source", "lang", "text").select(hashing.address(F.coalesce("text", F.lit(""))).alias("object_id"), F.col("source").alias("pot"), F.col("lang").alias("key"))
    nothing = spark.createDataFrame([], "object_id string, seq long, pot string, key string")
    found = manifests.located(manifests.located(nothing, rows.where("pot = 'src1'")), rows)
    return manifests.places(found).select("object_id", F.array_join("places", ",").alias("places"))


@query("manifest_head", f"WITH {_DOCS} SELECT source AS pot, CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 6 <> 0 THEN 'text/plain' END AS content_type, CASE WHEN doc_id % 6 <> 0 THEN n END AS size, CASE WHEN doc_id % 6 <> 0 THEN 'zstd' END AS codec, CASE WHEN doc_id % 6 <> 0 THEN 1 END AS n_chunks FROM d")
def manifest_head(spark, sf_dir):
    """Heads of current versions; every sixth manifest is missing."""
    known = manifests.identified(_manifests(spark, sf_dir).withColumn("created_at", F.col("doc_id").cast("string")))
    log = known.select(F.col("tenant").alias("pot"), F.col("doc_id").cast("string").alias("key"), F.lit(1).alias("seq"), "object_id")
    return manifests.head(log, known.where("doc_id % 6 <> 0")).drop("object_id")


@query("codec_roundtrip", "SELECT doc_id AS object_id, true AS ok, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, true AS smaller FROM documents")
def codec_roundtrip(spark, sf_dir):
    """Encode, store under the hash of the encoded bytes, check, decode, join, and compare with the digest of the original; `smaller` for texts of over 1000 bytes."""
    d = catalog.read(spark, sf_dir, "documents", "doc_id", "text").withColumn("data", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    packed = d.select(F.col("doc_id").alias("object_id"), F.sha2("data", 256).alias("sha256"), F.octet_length("data").alias("was"), codecs.encode(F.col("data"), "zstd").alias("data")).withColumn("hash", hashing.address(F.col("data")))
    found = store.fetched(packed.select("object_id", "sha256", F.array("hash").alias("chunks")), packed.select("hash", "data"), "zstd")
    small = packed.select("object_id", ((F.col("was") <= 1000) | (F.octet_length("data") < F.col("was"))).alias("smaller"))
    return found.join(small, "object_id")


@query("chunk_point_read", "SELECT 'sha256:' || sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size, true AS ok FROM documents WHERE doc_id = 1")
def chunk_point_read(spark, sf_dir):
    """Texts laid out by the first byte of their hash; one of them is read."""
    chunks = catalog.read(spark, sf_dir, "documents", "text").where("text is not null").select(hashing.address(F.col("text")).alias("hash"), F.encode("text", "UTF-8").alias("data")).dropDuplicates(["hash"])
    path = f"{streams.folder(spark)}/chunks"
    store.laid_out(chunks, path)
    asked = catalog.read(spark, sf_dir, "documents", "doc_id", "text").where("doc_id = 1").select(hashing.address(F.col("text"))).first()[0]
    return store.by_hash(spark.read.schema("hash string, data binary, shard string").parquet(path), asked).select("hash", F.octet_length("data").cast("long").alias("size"), "ok")


@query("put_chunk_bytes", "SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS stored_as, doc_id % 3 <> 0 AS accepted FROM documents")
def put_chunk_bytes(spark, sf_dir):
    """Every third text is sent under a wrong hash."""
    d = catalog.read(spark, sf_dir, "documents", "doc_id", "text").withColumn("data", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rows = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "sha256:00").otherwise(hashing.address(F.col("data"))).alias("hash"), "data")
    return store.put_bytes(rows).select("doc_id", "stored_as", "accepted")


_POTS = "SELECT n_name AS pot, n_nationkey % 2 = 0 AS public_read, CAST(n_nationkey AS INT) AS max_versions FROM nation"


def _pots(spark, sf_dir):
    return catalog.read(spark, sf_dir, "nation", "n_name", "n_nationkey").select(F.col("n_name").alias("pot"), (F.col("n_nationkey") % 2 == 0).alias("public_read"), F.col("n_nationkey").cast("int").alias("max_versions"))


@query("create_pots", f"WITH p AS ({_POTS}) SELECT * FROM p UNION ALL SELECT DISTINCT c_mktsegment, false, NULL::INT FROM customer WHERE c_mktsegment NOT IN (SELECT pot FROM p)")
def create_pots(spark, sf_dir):
    """Segments and nations as new names, with an empty one: nations are there and stay as they are."""
    names = catalog.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("pot")).unionByName(_pots(spark, sf_dir).select("pot")).unionByName(spark.createDataFrame([("",)], "pot string"))
    return store.created_pots(_pots(spark, sf_dir), names).drop("route_by_content_type")


@query("toggle_visibility", f"SELECT pot, CASE WHEN starts_with(pot, 'I') THEN NOT public_read ELSE public_read END AS public_read, max_versions FROM ({_POTS})")
def toggle_visibility(spark, sf_dir):
    return store.visible(_pots(spark, sf_dir), F.col("pot").startswith("I"), ~F.col("public_read"))


@query("pinned_count", "SELECT count(DISTINCT l_partkey) AS pinned FROM lineitem WHERE l_quantity > 40")
def pinned_count(spark, sf_dir):
    return store.pinned(catalog.read(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 40").select(F.col("l_partkey").alias("chunk")))


@query("page_import", "SELECT page_id, 'sha256:' || sha256(html) AS object_id, 'web' AS pot, url AS key, CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'application/octet-stream' END AS content_type, CAST(strlen(html) AS BIGINT) AS size_bytes, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL")
def page_import(spark, sf_dir):
    """Landed pages as objects; every other came without a content type."""
    pages = catalog.read(spark, sf_dir, "pages", "page_id", "url", "html")
    rows = pages.select(F.concat_ws("\n", F.col("page_id").cast("string"), "url").alias("key"), F.encode("html", "UTF-8").alias("data"), F.when(F.col("page_id") % 2 == 0, "text/html").alias("content_type"))
    found = store.imported(rows, "web")
    return found.withColumn("page_id", F.substring_index("key", "\n", 1).cast("long")).withColumn("key", F.substring_index("key", "\n", -1))


@query("export_selection", "SELECT key, entry, n FROM (VALUES ('9', 1::BIGINT), ('2', 2), ('5', 4)) v(key, entry) JOIN (SELECT CAST(doc_id AS VARCHAR) AS key, strlen(text) AS n FROM documents) USING (key)")
def export_selection(spark, sf_dir):
    objects = catalog.read(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("key"), F.octet_length("text").cast("long").alias("n"))
    return store.selected(objects, "9, 2,nowhere,5")


def _files(spark, sf_dir):
    return listing.object_listing(catalog.pointer_log(spark, sf_dir), listing.object_sizes(catalog.chunk_rows(spark, sf_dir), catalog.stored(spark, sf_dir))).select("key", "size", "versions")


@query("files_by_versions", f"WITH {LOG} SELECT key, count(*) AS versions FROM log GROUP BY pot, key ORDER BY versions DESC, key LIMIT 25")
def files_by_versions(spark, sf_dir):
    return store.sorted_files(_files(spark, sf_dir), "versions", descending=True).limit(25).select("key", "versions")


@query("files_by_key", f"WITH {LOG} SELECT key, count(*) AS versions FROM log GROUP BY pot, key ORDER BY key LIMIT 25")
def files_by_key(spark, sf_dir):
    return store.sorted_files(_files(spark, sf_dir)).limit(25).select("key", "versions")


@query("folders_by_name", "SELECT lang AS folder, count(*) AS n_keys FROM documents WHERE source = 'src1' AND lang IS NOT NULL GROUP BY lang ORDER BY folder")
def folders_by_name(spark, sf_dir):
    keys = catalog.read(spark, sf_dir, "documents", "source", "lang", "doc_id").where("lang is not null").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("key"))
    return listing.folders(keys, "src1/").orderBy("folder")


@query("health", f"WITH {LOG} SELECT count(DISTINCT (pot, key)) AS objects, 25::BIGINT AS n_keys, 'ok' AS status FROM log")
def health(spark, sf_dir):
    return store.health(catalog.pointer_log(spark, sf_dir).agg(F.countDistinct("pot", "key").alias("objects")), catalog.read(spark, sf_dir, "nation"))


# Requests


@query("uri_coding", "SELECT conv_id, turn, url_encode(text) AS encoded, text AS decoded FROM conversations")
def uri_coding(spark, sf_dir):
    rows = catalog.read(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("encoded", requests.uri_encoded(F.col("text")))
    return rows.select("conv_id", "turn", "encoded", requests.uri_decoded(F.col("encoded")).alias("decoded"))


@query("canonical_queries", "SELECT page_id, 'a=' || url_encode(url) || '&b=&page=' || page_id AS query FROM pages")
def canonical_queries(spark, sf_dir):
    rows = catalog.read(spark, sf_dir, "pages", "page_id", "url")
    given = F.concat(F.lit("page="), F.col("page_id").cast("string"), F.lit("&&b&a="), requests.uri_encoded(F.col("url"), keep_slash=True))
    return rows.select("page_id", requests.canonical_query(given).alias("query"))


@query("basic_credentials", "SELECT page_id, 'Basic ' || base64(encode('u' || page_id || ':' || url)) AS header, 'u' || page_id AS user, url AS password FROM pages")
def basic_credentials(spark, sf_dir):
    rows = catalog.read(spark, sf_dir, "pages", "page_id", "url")
    rows = rows.withColumn("header", requests.basic_header(F.concat(F.lit("u"), F.col("page_id").cast("string")), F.col("url")))
    return rows.withColumn("c", requests.basic_credentials(F.col("header"))).select("page_id", "header", "c.user", "c.password")


@query("path_pots", "SELECT doc_id, source AS pot FROM documents")
def path_pots(spark, sf_dir):
    rows = catalog.read(spark, sf_dir, "documents", "doc_id", "source", "lang")
    return rows.select("doc_id", requests.path_pot(F.concat(F.lit("//"), F.col("source"), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/x"))).alias("pot"))


@query("bucket_xml", "SELECT n_name AS pot, '<Bucket><Name>' || replace(replace(n_name || '&<', '&', '&amp;'), '<', '&lt;') || '</Name><CreationDate>2024</CreationDate></Bucket>' AS xml FROM nation")
def bucket_xml(spark, sf_dir):
    rows = catalog.read(spark, sf_dir, "nation", "n_name")
    return rows.select(F.col("n_name").alias("pot"), requests.listing_xml(F.concat("n_name", F.lit("&<")), F.lit("2024")).alias("xml"))


@query("part_number_lists", "SELECT conv_id, turn, CAST(turn AS VARCHAR) || ',4294967295' AS numbers FROM conversations")
def part_number_lists(spark, sf_dir):
    """Numbers past 32 bits are skipped."""
    body = F.concat(F.lit("<PartNumber>"), F.col("turn").cast("string"), F.lit("</PartNumber><PartNumber>99999999999999999999</PartNumber><PartNumber>4294967296</PartNumber><PartNumber>4294967295</PartNumber>"))
    return catalog.read(spark, sf_dir, "conversations", "conv_id", "turn").select("conv_id", "turn", F.array_join(F.transform(scalars.part_numbers(body), lambda x: x.cast("string")), ",").alias("numbers"))


@query("event_props", "SELECT event_id, json_keys(props) IS NOT NULL AS parsed, len(json_keys(props)) AS n FROM events")
def event_props(spark, sf_dir):
    """JSON text as a map."""
    rows = catalog.read(spark, sf_dir, "events", "event_id", "props").withColumn("p", F.from_json("props", "map<string,string>"))
    return rows.select("event_id", F.col("p").isNotNull().alias("parsed"), F.size("p").cast("long").alias("n"))


# Later sweeps


@query(
    "gc_later_sweep",
    f"""{GC} x AS (SELECT 1) SELECT count(*) FILTER (live.chunk IS NOT NULL) AS live, count(*) FILTER (live.chunk IS NULL AND condemned_at IS NULL) AS condemned,
    count(*) FILTER (live.chunk IS NULL AND {_NOW} - condemned_at >= {_GRACE}) AS erased FROM part LEFT JOIN live ON p_partkey = live.chunk LEFT JOIN earlier ON p_partkey = earlier.chunk""",
)
def gc_later_sweep(spark, sf_dir):
    """Chunks that an earlier sweep condemned and whose grace still runs are counted as neither condemned nor erased."""
    log, rows, stored = _gc_tables(spark, sf_dir)
    return gc.sweep_counts(gc.swept(stored, gc.reachable(log, rows), _earlier(spark, sf_dir), _NOW, _GRACE))
