"""Versions: a log of (pot, key, seq, object_id), of which the last row of a key is its current version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.hashing import valid_address

KEY = ("pot", "key")


def current(log: DataFrame, *more: str) -> DataFrame:
    """Each key's last version, by a partial aggregate instead of a sort."""
    last = F.max_by(F.struct("seq", "object_id", *more), "seq")
    return log.groupBy(*KEY).agg(last.alias("x")).select(*KEY, "x.seq", "x.object_id", *[f"x.{c}" for c in more])


def readable(log: DataFrame) -> DataFrame:
    """Rows whose object_id is an address; the others are skipped, so a corrupt last row leaves the version before it."""
    return log.where(F.coalesce(valid_address(F.col("object_id")), F.lit(False)))


def history(log: DataFrame) -> DataFrame:
    """Each key's versions numbered from 1, oldest first."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy(*KEY).orderBy("seq")).cast("long"))


def trimmed(log: DataFrame, newest: int) -> DataFrame:
    """The newest versions of each key; 0 keeps all."""
    if not newest:
        return log
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("seq")))
    return log.withColumn("_rank", rank).where(F.col("_rank") <= newest).drop("_rank")


def appended(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with (pot, key, object_id) rows after each key's last; several rows of a key go in object_id order."""
    last = log.groupBy(*KEY).agg(F.max("seq").alias("_last"))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("object_id"))
    new = rows.join(last, list(KEY), "left").withColumn("seq", F.coalesce("_last", F.lit(0)) + number)
    return log.select(*KEY, "seq", "object_id").unionByName(new.select(*KEY, "seq", "object_id"))


def restored(log: DataFrame, versions: DataFrame, manifests: DataFrame) -> DataFrame:
    """Append older versions (pot, key, object_id) again; one without a manifest is refused, which is left out here."""
    return appended(log, versions.join(manifests.select("object_id").distinct(), "object_id", "left_semi"))


def copied(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """Append the current version of (pot, key) to (to_pot, to_key): pointers only, no data."""
    rows = current(log).join(pairs, list(KEY)).select(F.col("to_pot").alias("pot"), F.col("to_key").alias("key"), "object_id")
    return appended(log, rows)


def moved(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rename (pot, key) to (to_pot, to_key): the history goes along and replaces the destination's. Moving a key onto itself changes nothing."""
    pairs = pairs.where((F.col("pot") != F.col("to_pot")) | (F.col("key") != F.col("to_key")))
    present = log.select(*KEY).distinct().join(pairs, list(KEY))
    gone = present.select(F.col("to_pot").alias("pot"), F.col("to_key").alias("key")).unionByName(present.select(*KEY)).distinct()
    came = log.join(pairs, list(KEY)).select(F.col("to_pot").alias("pot"), F.col("to_key").alias("key"), "seq", "object_id")
    return log.select(*KEY, "seq", "object_id").join(gone, list(KEY), "left_anti").unionByName(came)


def renamed_pot(log: DataFrame, old: str, new: str) -> DataFrame:
    return log.withColumn("pot", F.when(F.col("pot") == old, new).otherwise(F.col("pot")))


def live(log: DataFrame) -> DataFrame:
    """Rows after each key's last tombstone (op = 'delete'): a deletion drops the history too."""
    dead = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(Window.partitionBy(*KEY))
    return log.withColumn("_dead", dead).where("(_dead is null or seq > _dead) and op <> 'delete'").drop("_dead")


def without_pots(log: DataFrame, pots: list[str]) -> DataFrame:
    return log.where(~F.col("pot").isin(pots))


def droppable_pots(pots: DataFrame, log: DataFrame) -> DataFrame:
    """Pots without a key, which may be deleted without force."""
    return pots.join(log.select("pot").distinct(), "pot", "left_anti")


def upserted(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """The table with rows replaced or added by key."""
    return table.join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(rows)


def first_location(locations: DataFrame) -> DataFrame:
    """The first (pot, key) that was recorded for each object."""
    return locations.groupBy("object_id").agg(F.min_by(F.struct("pot", "key"), "seq").alias("x")).select("object_id", "x.pot", "x.key")


def dangling(log: DataFrame, manifests: DataFrame) -> DataFrame:
    """Current versions whose manifest is missing."""
    return current(log).join(manifests.select("object_id").distinct(), "object_id", "left_anti")


def with_default(rows: DataFrame, configs: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Left join to a config table; what is missing gets its default."""
    joined = rows.join(configs, key, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), value) for name, value in defaults.items()})
