"""Catalog tables over landed Parquet: readers, and the views that map the star schema to a catalog of objects, versions and chunks.

An order is an object version; its key is the customer within the pot of the market segment; its chunks are the parts of
its lines, in line order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def checked_format(stamp: DataFrame, known: int) -> DataFrame:
    """The one-row stamp (version) of a catalog, refused when it is newer than `known`; no stamp is adopted as version 1."""
    version = stamp.agg(F.coalesce(F.max("version"), F.lit(1)).alias("version"))
    return version.select(F.when(F.col("version") > known, F.raise_error(F.lit("the catalog has a newer format"))).otherwise(F.col("version")).cast("int").alias("version"))


def pointer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pot, key, seq, object_id, created_at: all versions of all keys, numbered from the oldest."""
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    keys = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    log = orders.withColumn("seq", seq).join(keys, F.col("o_custkey") == F.col("c_custkey"))
    return log.select(F.col("c_mktsegment").alias("pot"), F.col("o_custkey").cast("string").alias("key"), "seq", F.col("o_orderkey").alias("object_id"), F.col("o_orderdate").alias("created_at"))


def chunk_rows(spark: SparkSession, sf_dir: str, chunk: str = "l_partkey") -> DataFrame:
    """object_id, chunk and the columns that order an object's chunks."""
    return read(spark, sf_dir, "lineitem", "l_orderkey", *LINE_ORDER).select(F.col("l_orderkey").alias("object_id"), F.col(chunk).alias("chunk"), *LINE_ORDER)


def ordered(value: Column) -> Column:
    """Aggregate: the values of an object's lines as an array in line order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, value.alias("v")))), lambda x: x["v"])


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk, size: the chunk store."""
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("chunk"), F.col("p_size").cast("long").alias("size"))


def brand_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pot, key, seq, object_id, chunks: versions with the brands of their parts as an ordered chunk list; no lines, no chunks."""
    brands = read(spark, sf_dir, "part", "p_partkey", "p_brand")
    lines = chunk_rows(spark, sf_dir).join(brands, F.col("chunk") == F.col("p_partkey"))
    lists = lines.withColumn("l_partkey", F.col("chunk")).groupBy("object_id").agg(ordered(F.col("p_brand")).alias("chunks"))
    log = pointer_log(spark, sf_dir).drop("created_at")
    return log.join(lists, "object_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and its turns' SHA-256 hashes in order, as 32-byte values."""
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    hashed = rows.select("conv_id", F.struct("turn", F.unhex(F.sha2("text", 256)).alias("h")).alias("x"))
    return hashed.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]).alias("chunks"))


def document_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, pot, key, data: document texts as objects."""
    d = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    return d.select(F.col("doc_id").cast("string").alias("object_id"), F.col("source").alias("pot"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("key"), F.encode("text", "UTF-8").alias("data"))
