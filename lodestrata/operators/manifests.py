"""Manifests: their identity, how stored ones are read and checked, and how new ones are put and committed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.hashing import address
from lodestrata.model import MANIFEST, MANIFEST_VERSION
from lodestrata.operators.versions import appended, current

_JSON = {"ignoreNullFields": "false"}


def canonical(root: bool) -> str:
    """A manifest's struct with its fields in order of name, as SQL; without the id, and without the Merkle root unless `root`."""
    chunking = "'algo', chunking.algo, 'chunks', chunking.chunks" + (", 'merkle_root', chunking.merkle_root" if root else "")
    return f"""named_struct('chunking', named_struct({chunking}), 'created_at', created_at, 'manifest_version', manifest_version,
        'original', named_struct('content_type', original.content_type, 'sha256', original.sha256, 'size_bytes', original.size_bytes),
        'policy_snapshot', policy_snapshot, 'quality', named_struct('metric', quality.metric, 'score', quality.score),
        'storage', named_struct('codec', storage.codec, 'codec_params', try_parse_json(storage.codec_params), 'fidelity', storage.fidelity,
            'reconstructs_original', storage.reconstructs_original, 'route', storage.route, 'stored_size_bytes', storage.stored_size_bytes), 'tenant', tenant)"""


def canonical_json() -> Column:
    """Compact JSON with sorted keys of a row of the MANIFEST schema: what its id is the hash of. An absent Merkle root is left out; other nulls are written."""
    with_root, without = (F.to_json(F.expr(canonical(x)), _JSON) for x in (True, False))
    return F.when(F.col("chunking.merkle_root").isNotNull(), with_root).otherwise(without)


def identified(manifests: DataFrame) -> DataFrame:
    """The manifests with their object_id, whatever it was before."""
    return manifests.withColumn("object_id", address(canonical_json()))


def stored_json(manifests: DataFrame) -> DataFrame:
    """(object_id, json): manifests as they are stored."""
    columns = [c.strip().split()[0] for c in ("manifest_version", "object_id", "created_at", "original", "storage", "chunking", "quality", "tenant", "policy_snapshot")]
    return manifests.select("object_id", F.to_json(F.struct(*columns), _JSON).alias("json"))


def read(stored: DataFrame, known: int = MANIFEST_VERSION) -> DataFrame:
    """Stored manifests (object_id, json) parsed, with status: `ok`, `corrupt` (no manifest), `newer` (of a version past `known`, judged
    before its id), or `integrity` (its content isn't what the id it is stored under says)."""
    parsed = stored.select(F.col("object_id").alias("asked"), F.from_json("json", MANIFEST).alias("m")).select("asked", "m.*")
    same = address(canonical_json()) == F.col("asked")
    status = F.when(F.col("manifest_version").isNull(), "corrupt").when(F.col("manifest_version") > known, "newer").when(~same, "integrity").otherwise("ok")
    return parsed.withColumn("status", status).drop("object_id").withColumnRenamed("asked", "object_id")


def by_id(stored: DataFrame, object_id: str, known: int = MANIFEST_VERSION) -> DataFrame:
    """One manifest; no row if there is none. The filter comes before parsing, so it reaches the scan."""
    return read(stored.where(F.col("object_id") == object_id), known)


def put(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(object_id, json) of new manifests that aren't stored yet, each once."""
    return stored_json(identified(new)).dropDuplicates(["object_id"]).join(stored.select("object_id"), "object_id", "left_anti")


def committed(log: DataFrame, locations: DataFrame, stored: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pointer log and locations after writes (pot, key, object_id). Only writes whose manifest is stored are committed: manifests come first."""
    ready = writes.join(stored.select("object_id").distinct(), "object_id", "left_semi").select("pot", "key", "object_id")
    return appended(log, ready), located(locations, ready)


def located(locations: DataFrame, new: DataFrame) -> DataFrame:
    """Locations (object_id, seq, pot, key) with new (pot, key, object_id) appended in that order, unless they are there."""
    from pyspark.sql import Window

    fresh = new.select("object_id", "pot", "key").distinct().join(locations.select("object_id", "pot", "key"), ["object_id", "pot", "key"], "left_anti")
    last = locations.groupBy("object_id").agg(F.max("seq").alias("_last"))
    number = F.row_number().over(Window.partitionBy("object_id").orderBy("pot", "key"))
    added = fresh.join(last, "object_id", "left").withColumn("seq", (F.coalesce("_last", F.lit(0)) + number).cast("long"))
    return locations.select("object_id", "seq", "pot", "key").unionByName(added.select("object_id", "seq", "pot", "key"))


def places(locations: DataFrame) -> DataFrame:
    """(object_id, places): all of an object's locations in order, as pot/key."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "pot", "key"))), lambda x: F.concat_ws("/", x["pot"], x["key"]))
    return locations.groupBy("object_id").agg(listed.alias("places"))


def head(log: DataFrame, manifests: DataFrame) -> DataFrame:
    """pot, key, object_id, content_type, size, codec and number of chunks of each key's current version; nulls where its manifest is missing."""
    told = manifests.select("object_id", F.col("original.content_type").alias("content_type"), F.col("original.size_bytes").alias("size"), F.col("storage.codec").alias("codec"), F.size("chunking.chunks").alias("n_chunks"))
    return current(log).select("pot", "key", "object_id").join(told, "object_id", "left")
