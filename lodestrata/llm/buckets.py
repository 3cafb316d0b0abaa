"""Buckets of rows that are compared with one another, dealt out so that no task holds a large bucket.

A bucket of up to `most` rows is one block. A larger one is cut into shards of about that size, and each pair of shards, a shard and itself included,
is a block. So every pair of a bucket meets in one block, whatever the bucket's size, and a block has `most` rows or twice as many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import join_dealt, table


def blocks(rows: DataFrame, bucket: str, item: str, most: int, where: str = "_n > 1") -> DataFrame:
    """Rows of buckets with two rows or more, with block (long), indexed (are others compared with it?) and inner (is it compared
    with those indexed before it, too?), sorted by block within partitions, those indexed first.

    `where` may ask more of a bucket, by _n, its rows, and _homes, its rows that are `home`, if there is such a column.
    """
    homes = F.count_if("home") if "home" in rows.columns else F.lit(0)
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("_n"), homes.alias("_homes")).where(where).select(bucket, "_n", F.ceil(F.col("_n") / most).cast("int").alias("_shards"))
    sizes = table(sizes, "sizes")
    cut = join_dealt(rows, sizes.drop("_n"), [bucket], sizes.select(bucket, "_n"))
    own = F.pmod(F.xxhash64(item), "_shards").cast("int")
    cut = cut.withColumn("_own", own).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)))
    cut = cut.withColumn("block", F.xxhash64(bucket, F.least("_own", "_shard"), F.greatest("_own", "_shard"))).withColumn("indexed", F.col("_own") <= F.col("_shard")).withColumn("inner", F.col("_own") == F.col("_shard"))
    return cut.drop("_shards", "_own", "_shard").repartition("block").sortWithinPartitions("block", F.desc("indexed"), item)
