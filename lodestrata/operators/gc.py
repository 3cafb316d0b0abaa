"""Garbage collection: mark what any version or pin reaches, condemn the rest, erase it after a grace time; and lifecycle rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import current, trimmed


def reachable(log: DataFrame, chunk_rows: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """The chunks of all versions in the log, and pinned ones. Objects are made distinct before their chunks are read."""
    objects = log.select("object_id").distinct()
    found = chunk_rows.join(objects, "object_id", "left_semi").select("chunk")
    return (found if pins is None else found.unionByName(pins.select("chunk"))).distinct()


def swept(stored: DataFrame, live: DataFrame, condemned: DataFrame, now: int, grace: int) -> DataFrame:
    """One sweep: chunk, condemned_at and state of each stored chunk.

    A live chunk is pardoned (condemned_at null). One that isn't is condemned now, or, if an earlier sweep condemned it, erased
    after at least `grace` seconds and waiting until then; so nothing goes on its first sweep.
    """
    marked = stored.select("chunk").join(live.select("chunk", F.lit(True).alias("_live")), "chunk", "left").join(condemned.select("chunk", "condemned_at"), "chunk", "left")
    state = F.when(F.col("_live"), "live").when(F.col("condemned_at").isNull(), "condemned").when(F.lit(now) - F.col("condemned_at") >= grace, "erased").otherwise("waiting")
    since = F.when(F.col("_live"), F.lit(None).cast("long")).otherwise(F.coalesce("condemned_at", F.lit(now).cast("long")))
    return marked.select("chunk", since.alias("condemned_at"), state.alias("state"))


def sweep_counts(sweep: DataFrame) -> DataFrame:
    """What this sweep did: chunks found live, condemned by it and erased by it. Those that wait are none of these."""
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("live", "condemned", "erased")]
    return sweep.agg(*states)


def expired(log: DataFrame, days: Column, now: Column) -> DataFrame:
    """Keys whose current version is more than `days` old, to the second; locks don't matter here."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    return current(log, "created_at").where(age > days * 86400)


def lifecycle(log: DataFrame, days: int, newest: int, now: Column) -> DataFrame:
    """The log after a lifecycle run: expired keys go, then the others keep their newest versions."""
    gone = expired(log, F.lit(days), now).select("pot", "key")
    return trimmed(log.join(gone, ["pot", "key"], "left_anti"), newest)
