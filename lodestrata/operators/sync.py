"""Set and bag algebra over chunk lists, for diffs and for copying between stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.hashing import merkle_root, raw


def added(before: Column, after: Column) -> Column:
    """How many chunks, as a set, only the later list has; swap the arguments for those removed."""
    return F.size(F.array_except(after, before)).cast("long")


def shared(before: Column, after: Column) -> Column:
    return F.size(F.array_intersect(before, after)).cast("long")


def bag_delta(before: Column, after: Column) -> Column:
    """Chunks of the later list that the earlier one lacks, in order, repeats kept."""
    return F.filter(after, lambda x: ~F.array_contains(before, x))


def consecutive(lists: DataFrame) -> DataFrame:
    """Each version's chunks beside those of the version before; first versions are left out."""
    w = Window.partitionBy("pot", "key").orderBy("seq")
    return lists.withColumn("before", F.lag("chunks").over(w)).where("before is not null")


def missing(wanted: DataFrame, have: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Wanted rows whose chunk the store lacks; all their columns, repeats kept."""
    return wanted.join(have.select(chunk).distinct(), chunk, "left_anti")


def importable(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Objects all of whose chunks are present: object_id."""
    known = have.select("chunk").distinct().withColumn("_there", F.lit(True))
    rows = wanted.join(known, "chunk", "left")
    return rows.groupBy("object_id").agg(F.bool_and(F.col("_there").isNotNull()).alias("whole")).where("whole").select("object_id")


def new_chunks(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """What an ingest writes: each new chunk once."""
    return incoming.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def import_checks(manifests: DataFrame, have: DataFrame) -> DataFrame:
    """object_id with what an import checks: whole (every chunk is present), root (equal to the declared one, if any) and same_id.

    manifests: object_id, declared_id, chunks (addresses in order), merkle_root (hex, nullable); have: hash.
    """
    known = have.select("hash").distinct().withColumn("_there", F.lit(True))
    rows = manifests.select("object_id", F.explode("chunks").alias("hash")).join(known, "hash", "left")
    whole = rows.groupBy("object_id").agg(F.bool_and(F.col("_there").isNotNull()).alias("whole"))
    computed = F.lower(F.hex(merkle_root(F.transform("chunks", raw))))
    checked = manifests.join(whole, "object_id", "left")
    return checked.select("object_id", F.coalesce("whole", F.lit(True)).alias("whole"), F.coalesce(computed == F.col("merkle_root"), F.lit(True)).alias("root"), (F.col("object_id") == F.col("declared_id")).alias("same_id"))
