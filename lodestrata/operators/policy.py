"""Policies and access as joins with predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import authorized, wants


def effective(codec: Column, level: Column, fidelity: Column, routed: Column, content_type: Column, codec_default: str = "zstd", level_default: int = 3) -> list[Column]:
    """A pot's settings over the server's: codec, zstd_level, fidelity, route."""
    return [
        F.coalesce(codec, F.lit(codec_default)).alias("codec"),
        F.coalesce(level, F.lit(level_default)).cast("int").alias("zstd_level"),
        F.when(fidelity == "perceptual", "perceptual").otherwise("exact").alias("fidelity"),
        F.when(F.coalesce(routed, F.lit(False)) & content_type.startswith("image/"), "image").otherwise("blob").alias("route"),
    ]


def decisions(requests: DataFrame, keys: DataFrame, pots: DataFrame) -> DataFrame:
    """Requests (request_id, access_key, pot, action) with `allowed`. An unknown key is like none."""
    rows = requests.join(keys.select("access_key", "read_only", "pots"), "access_key", "left").join(pots.select("pot", "public_read"), "pot", "left")
    allowed = authorized(F.col("read_only").isNotNull(), F.col("read_only"), F.col("pots"), F.col("pot"), F.col("action"), F.coalesce("public_read", F.lit(False)))
    return rows.select("request_id", F.coalesce(allowed, F.lit(False)).alias("allowed"))


def deliveries(events: DataFrame, hooks: DataFrame, kind: str) -> DataFrame:
    """Each event with each webhook that wants it. Hooks are one short administrative table, so they are broadcast."""
    return events.join(F.broadcast(hooks), wants(F.col("events"), F.col(kind)))


def auto_tagged(annotations: DataFrame) -> DataFrame:
    """Put `auto:<i>` -> tag for the i-th suggested tag into `tags`; a note is set only where there is none."""
    made = F.map_from_entries(F.transform("suggested", lambda t, i: F.struct(F.concat(F.lit("auto:"), i.cast("string")).alias("key"), t.alias("value"))))
    kept = F.map_filter("tags", lambda k, _: ~F.array_contains(F.map_keys(made), k))
    return annotations.withColumn("tags", F.map_concat(kept, made)).withColumn("note", F.when(F.coalesce("note", F.lit("")) == "", F.col("suggested_note")).otherwise(F.col("note")))
