"""Multipart uploads: parts by upload and number, completed in a given order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.integrity import joined


def parts(rows: DataFrame) -> DataFrame:
    """(upload_id, part_number, seq, ...): of a repeated part number the last counts."""
    rest = [c for c in rows.columns if c not in ("upload_id", "part_number", "seq")]
    last = rows.groupBy("upload_id", "part_number").agg(F.max_by(F.struct(*rest), "seq").alias("x"))
    return last.select("upload_id", "part_number", *[f"x.{c}" for c in rest])


def completed(found: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """upload_id, n_parts, size, sha256 of the joined data; ok is false if the order names a part that isn't there.

    found: upload_id, part_number, data. Without orders (upload_id, order), parts go by number; a part named twice is joined twice.
    """
    if orders is None:
        wanted = found.select("upload_id", F.col("part_number").alias("pos"), "part_number")
    else:
        wanted = orders.select("upload_id", F.posexplode("order").alias("pos", "part_number"))
    rows = wanted.join(found, ["upload_id", "part_number"], "left")
    whole = rows.groupBy("upload_id").agg(F.count("*").alias("n_parts"), F.bool_and(F.col("data").isNotNull()).alias("ok"), joined().alias("data"))
    return whole.select("upload_id", "n_parts", "ok", F.when(F.col("ok"), F.octet_length("data")).cast("long").alias("size"), F.when(F.col("ok"), F.sha2("data", 256)).alias("sha256"))
