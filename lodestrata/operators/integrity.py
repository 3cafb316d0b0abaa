"""Reassembly and verification of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(order: str = "pos", data: str = "data") -> Column:
    """Aggregate: the values of a binary column in order, end to end; null where there is none. One pass, however many there are."""
    return F.expr(f"listagg({data}, X'') WITHIN GROUP (ORDER BY {order})")


def reassembled(chunks: DataFrame) -> DataFrame:
    """object_id and its data from (object_id, pos, data). One object's bytes are one value, as when it was put."""
    return chunks.groupBy("object_id").agg(joined().alias("data"))


def verified(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """object_id, ok: every chunk is there and hashes to its address, and the whole hashes to the manifest's digest.

    manifests: object_id, sha256, fidelity, chunks (addresses in order). The digest is compared for exact objects only;
    an object without chunks is the empty one. Chunks are checked once each, before they meet the manifests.
    """
    good = chunks.where(F.concat(F.lit("sha256:"), F.sha2("data", 256)) == F.col("hash")).dropDuplicates(["hash"])
    wanted = manifests.select("object_id", F.posexplode("chunks").alias("pos", "hash"))
    rows = wanted.join(good, "hash", "left").groupBy("object_id").agg(F.bool_and(F.col("data").isNotNull()).alias("whole"), joined().alias("data"))
    found = manifests.join(rows, "object_id", "left")
    data = F.coalesce("data", F.lit("").cast("binary"))
    exact = (F.col("fidelity") != "exact") | (F.sha2(data, 256) == F.col("sha256"))
    return found.select("object_id", (F.coalesce("whole", F.lit(True)) & F.coalesce(exact, F.lit(False))).alias("ok"))
