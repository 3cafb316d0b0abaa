"""Composite plans: ingest, and the periodic maintenance run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.chunking import chunk
from lodestrata.functions.hashing import merkle_root, raw
from lodestrata.operators.gc import lifecycle, reachable, swept


def ingested(objects: DataFrame, least: int, average: int, largest: int, keep_data: bool = True, most_bytes: int | None = None) -> DataFrame:
    """Chunk rows of (object_id, data); see functions.chunking. Objects of more than `most_bytes` are refused: nothing of them is stored."""
    if most_bytes is not None:
        objects = objects.where(F.coalesce(F.octet_length("data"), F.lit(0)) <= most_bytes)
    return chunk(objects, least, average, largest, keep_data)


def manifests(chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """object_id, size_bytes, sha256, chunks (in order), merkle_root; an object without chunks is the empty one."""
    lists = chunks.groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("chunks"))
    rows = objects.select("object_id", F.octet_length("data").cast("long").alias("size_bytes"), F.sha2("data", 256).alias("sha256"))
    joined = rows.join(lists, "object_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))
    return joined.withColumn("merkle_root", F.lower(F.hex(merkle_root(F.transform("chunks", raw)))))


def maintained(log: DataFrame, chunk_rows: DataFrame, stored: DataFrame, condemned: DataFrame, days: int, newest: int, now: Column, now_seconds: int, grace: int) -> DataFrame:
    """Lifecycle, then one sweep over what the remaining log reaches."""
    return swept(stored, reachable(lifecycle(log, days, newest, now), chunk_rows), condemned, now_seconds, grace)
