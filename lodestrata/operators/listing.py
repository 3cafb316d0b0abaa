"""What a console shows: pots, objects, folders, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .versions import current


def object_sizes(chunk_rows: DataFrame, stored: DataFrame) -> DataFrame:
    """object_id, size: the sum of its chunks' sizes, repeats counted."""
    return chunk_rows.join(stored, "chunk").groupBy("object_id").agg(F.sum("size").alias("size"))


def storage_stats(log: DataFrame, sizes: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: pots that ever held a key, live objects, their logical bytes, and the chunk store's bytes and chunks."""
    pots = log.agg(F.countDistinct("pot").alias("buckets"))
    held = current(log).join(sizes, "object_id", "left").agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"))
    chunks = stored.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("physical_bytes"), F.count("*").alias("unique_chunks"))
    return pots.crossJoin(held).crossJoin(chunks)


def savings(physical: Column, logical: Column) -> Column:
    """Per cent saved: never below 0, and 0 for nothing stored."""
    return F.when(logical > 0, F.greatest(F.lit(0.0), 100.0 - 100.0 * physical / logical)).otherwise(0.0)


def pot_listing(log: DataFrame) -> DataFrame:
    return log.groupBy("pot").agg(F.countDistinct("key").alias("n_keys"))


def object_listing(log: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each key's current size (0 without a manifest) and number of versions."""
    keys = log.groupBy("pot", "key").agg(F.max_by("object_id", "seq").alias("object_id"), F.count("*").alias("versions"))
    return keys.join(sizes, "object_id", "left").select("pot", "key", F.coalesce("size", F.lit(0)).alias("size"), "versions")


def folders(keys: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Number of keys under each next path segment below the prefix; keys right below it are no folder."""
    rest = F.substring(F.col(key), len(prefix) + 1, 1 << 30)
    inside = keys.where(F.col(key).startswith(prefix)).select(rest.alias("rest")).where(F.col("rest").contains("/"))
    return inside.groupBy(F.substring_index("rest", "/", 1).alias("folder")).agg(F.count("*").alias("n_keys"))


def named(rows: DataFrame, text: str, key: str = "key") -> DataFrame:
    """Rows whose key contains the text, whatever its case."""
    return rows.where(F.contains(F.lower(key), F.lower(F.lit(text))))


def all_pots(*tables: DataFrame) -> DataFrame:
    """Distinct pots of all tables, sorted."""
    pots = tables[0].select("pot")
    for t in tables[1:]:
        pots = pots.union(t.select("pot"))
    return pots.distinct().orderBy("pot")


def hits_by_pot(hits: DataFrame) -> DataFrame:
    """Search hits per pot, best first; hits without a place are under `unknown`."""
    pot = F.coalesce("pot", F.lit("unknown"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "object_id")))
    return hits.groupBy(pot.alias("pot")).agg(F.count("*").alias("n"), F.transform(ranked, lambda x: x["object_id"]).alias("objects"))


def chunk_offsets(rows: DataFrame, *order: str) -> DataFrame:
    """Where each chunk begins in its object, from (object_id, size) rows in the given order."""
    w = Window.partitionBy("object_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)))
