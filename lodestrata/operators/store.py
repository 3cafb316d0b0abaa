"""The chunk store and the pots: point reads, checked writes, pots and their settings, selections to export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.codecs import decode
from lodestrata.functions.hashing import address
from lodestrata.functions.scalars import shard
from lodestrata.operators.integrity import joined

SEPARATOR = ","


def laid_out(chunks: DataFrame, path: str) -> None:
    """Write chunks (hash, data, ...) in a folder for each first byte of their hash, so that a point read lists one folder."""
    chunks.withColumn("shard", shard(F.col("hash"))).repartition("shard").write.partitionBy("shard").parquet(path)


def by_hash(store: DataFrame, hash_text: str) -> DataFrame:
    """hash, data and ok of one stored chunk: is the data what the hash says? No row if there is none. `store` has the column shard."""
    digits = hash_text.rsplit(":", 1)[-1]
    found = store.where((F.col("shard") == digits[:2]) & (F.col("hash") == hash_text)).limit(1)
    return found.select("hash", "data", (address(F.col("data")) == F.col("hash")).alias("ok"))


def put_bytes(rows: DataFrame) -> DataFrame:
    """Chunks sent under a declared hash (hash, data): stored_as, what they are stored as, and accepted. Data of another hash is stored too, as an orphan, but refused."""
    stored_as = address(F.col("data"))
    return rows.withColumn("stored_as", stored_as).withColumn("accepted", F.col("stored_as") == F.col("hash"))


def fetched(manifests: DataFrame, chunks: DataFrame, codec: str = "none") -> DataFrame:
    """object_id, ok, size: each stored chunk checked against its address, then decoded and joined in order, and the whole checked against the manifest's digest."""
    wanted = manifests.select("object_id", F.posexplode("chunks").alias("pos", "hash"))
    good = chunks.where(address(F.col("data")) == F.col("hash")).dropDuplicates(["hash"]).select("hash", decode(F.col("data"), codec).alias("data"))
    rows = wanted.join(good, "hash", "left").groupBy("object_id").agg(F.bool_and(F.col("data").isNotNull()).alias("whole"), joined().alias("data"))
    found = manifests.join(rows, "object_id", "left")
    data = F.when(F.size("chunks") > 0, F.col("data")).otherwise(F.lit("").cast("binary"))
    ok = F.coalesce("whole", F.lit(True)) & F.coalesce(F.sha2(data, 256) == F.col("sha256"), F.lit(False))
    return found.select("object_id", ok.alias("ok"), F.when(F.coalesce("whole", F.lit(True)), F.octet_length(data)).cast("long").alias("size"))


def created_pots(pots: DataFrame, names: DataFrame) -> DataFrame:
    """Pots (pot, config...) with new names added under the default configuration; one that is there stays as it is, and an empty name is refused."""
    fresh = names.where(F.coalesce("pot", F.lit("")) != "").select("pot").distinct().join(pots.select("pot"), "pot", "left_anti")
    return pots.unionByName(fresh.withColumns({"public_read": F.lit(False), "route_by_content_type": F.lit(False)}), allowMissingColumns=True)


def visible(pots: DataFrame, chosen: Column, public: Column) -> DataFrame:
    """Set public_read of the chosen pots; nothing else of their settings changes."""
    return pots.withColumn("public_read", F.when(chosen, public).otherwise(F.col("public_read")))


def pinned(pins: DataFrame) -> DataFrame:
    """How many chunks are pinned: pins are a set, so two uploads of one chunk pin it once."""
    return pins.agg(F.countDistinct("chunk").alias("pinned"))


def imported(pages: DataFrame, pot: str) -> DataFrame:
    """Landed pages (key, data, content_type) as objects to ingest; without a content type they are plain bytes. Nulls, failed fetches, are left out."""
    kind = F.coalesce("content_type", F.lit("application/octet-stream"))
    return pages.where("data is not null").select(address(F.col("data")).alias("object_id"), F.lit(pot).alias("pot"), "key", kind.alias("content_type"), F.octet_length("data").cast("long").alias("size_bytes"), F.sha2("data", 256).alias("sha256"))


def selected(objects: DataFrame, names: str) -> DataFrame:
    """Objects (key, ...) of a comma list of keys, in its order, as an archive would hold them; keys that aren't there are skipped."""
    listed = F.array(*[F.lit(x.strip()) for x in names.split(SEPARATOR) if x.strip()] or [F.lit("")])
    return objects.withColumn("entry", F.array_position(listed, F.col("key"))).where("entry > 0").orderBy("entry")


def sorted_files(files: DataFrame, by: str = "key", descending: bool = False) -> DataFrame:
    """Files (key, size, versions) by one of these columns, equal ones by key."""
    if by not in ("key", "size", "versions"):
        raise ValueError(f"files aren't sorted by {by}")
    return files.orderBy(F.desc(by) if descending else F.asc(by), "key")


def health(stats: DataFrame, keys: DataFrame) -> DataFrame:
    """The statistics of a store with status: ready if its keys can be read."""
    return stats.crossJoin(F.broadcast(keys.agg(F.count("*").alias("n_keys")))).withColumn("status", F.lit("ok"))


def leftovers(spark, folder: str, prefix: str = "tmp-") -> DataFrame:
    """path and length of temporary files that a crash left below the folder: what a sweep would remove. Hidden files are never read, so they are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.where(F.element_at(F.split("path", "/"), -1).startswith(prefix))
