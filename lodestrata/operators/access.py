"""Access keys, webhooks and what is reported about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import owner_key


def redacted(keys: DataFrame) -> DataFrame:
    """Keys as they are listed: without their secrets."""
    return keys.select("access_key", "read_only", "pots", "created_at", owner_key(F.col("read_only"), F.col("pots")).alias("owner"))


def signing_secret(keys: DataFrame) -> DataFrame:
    """The secret of the first owner key by name; null if there is none, when links aren't signed."""
    owners = keys.where(owner_key(F.col("read_only"), F.col("pots")))
    return owners.agg(F.min_by("secret_key", "access_key").alias("secret"))


def created(keys: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Keys with new ones put in or replaced; an empty creation time becomes `now`."""
    stamped = new.withColumn("created_at", F.when(F.coalesce("created_at", F.lit("")) == "", now).otherwise(F.col("created_at")))
    return keys.join(stamped.select("access_key"), "access_key", "left_anti").unionByName(stamped)


def seeded(keys: DataFrame, owner: DataFrame) -> DataFrame:
    """The owner key is put in only where there is no key at all."""
    some = keys.select(F.lit(1).alias("_any")).limit(1)
    return keys.unionByName(owner.join(some, F.lit(True), "left_anti"))


def webhook_id(url: Column, seconds: Column) -> Column:
    """Sixteen hex digits of the hash of address and time; SHA-256 here, as for other addresses."""
    return F.substring(F.sha2(F.concat(url, F.lit(":"), seconds.cast("string")), 256), 1, 16)


def metrics(stats: DataFrame, prefix: str = "catalog") -> DataFrame:
    """A row of numbers as text lines for a scraper: name, line."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in stats.columns]))
    return stats.select(pairs.alias("x")).select("x.name", F.concat(F.lit(f"{prefix}_"), "x.name", F.lit(" "), F.col("x.value").cast("string")).alias("line"))


def json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
