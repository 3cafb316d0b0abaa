"""Nearest neighbours by cosine, within a tenant."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import cosine


def top_k(vectors: DataFrame, query: list[float], k: int = 10, tenant: str | None = None) -> DataFrame:
    """object_id and score of the k best; equal scores by object_id. Each task keeps k rows; no row is sorted twice."""
    rows = vectors if tenant is None else vectors.where(F.col("tenant") == tenant)
    scored = rows.select("object_id", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return scored.orderBy(F.desc("score"), "object_id").limit(k)


def similar(vectors: DataFrame, object_id, k: int = 10) -> DataFrame:
    """The k best of the object's own tenant; the object itself can be among them."""
    query = vectors.where(F.col("object_id") == object_id).select(F.col("tenant").alias("_t"), F.col("vector").alias("_q"))
    near = vectors.join(F.broadcast(query), F.col("tenant") == F.col("_t"))
    return near.select("object_id", cosine(F.col("vector"), F.col("_q")).alias("score")).orderBy(F.desc("score"), "object_id").limit(k)


def enriched(hits: DataFrame, first_locations: DataFrame) -> DataFrame:
    """Hits with the first place recorded for each; null where none is."""
    return hits.join(first_locations, "object_id", "left")


def upserted(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """Vectors replaced or added by tenant and object."""
    return vectors.join(rows.select("tenant", "object_id").distinct(), ["tenant", "object_id"], "left_anti").unionByName(rows)


def understood(objects: DataFrame, embed: Callable[[list[bytes]], list[list[float]]]) -> DataFrame:
    """(tenant, object_id, vector) of objects (tenant, object_id, data); `embed` gets a batch of bytes and returns a vector for each."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            vectors = pa.array(embed([x or b"" for x in frame.column("data").to_pylist()]), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([frame.column("tenant"), frame.column("object_id"), vectors], ["tenant", "object_id", "vector"])

    return objects.select("tenant", "object_id", "data").mapInArrow(run, "tenant string, object_id string, vector array<float>")


def length_and_sum(batch: list[bytes]) -> list[list[float]]:
    """A stand-in for a model: the number of bytes and their sum."""
    return [[float(len(x)), float(sum(x))] for x in batch]
