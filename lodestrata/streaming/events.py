"""Write events as streams: counts, running pointers, webhook fan-out, and garbage collection with timers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.model import EVENTS
from lodestrata.operators.policy import deliveries
from lodestrata.operators.search import understood

WRITES, DELETES = ("purchase", "signup"), ("error",)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with `ts` as a timestamp that can be watermarked."""
    stream = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def folder(spark: SparkSession) -> str:
    """A new folder for a stream's state and output, in the session's shared folder if it names one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "lodestrata-streams")
    return f"{base}/stream-{uuid.uuid4().hex}"


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run the stream over what is there and return its output. In complete and update mode the last batch's rows of a key count; in append mode all."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/out/batch=-1")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == last)
    return rows.drop("batch")


def daily_counts(events: DataFrame) -> DataFrame:
    """Events of each type and day. In update and append mode rows later than a day are dropped, and in append mode a day is written when it is over; in complete mode no row is dropped."""
    by_day = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return by_day.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def pointers(events: DataFrame) -> DataFrame:
    """Each key's last write or deletion: user_id, event_id and whether the key is live."""
    kind = F.col("event_type")
    rows = events.where(kind.isin(*WRITES, *DELETES)).select("user_id", "event_id", kind.isin(*WRITES).alias("live"))
    return rows.groupBy("user_id").agg(F.max(F.struct("event_id", "live")).alias("x")).select("user_id", "x.event_id", "x.live")


def fan_out(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Stream-static join: an event for each webhook that wants its type."""
    return deliveries(events, hooks, "event_type")


def _in_order(frames: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """All of a key's rows of a micro-batch, in order: a key may come in several frames."""
    return pd.concat(list(frames)).sort_values(list(by), kind="stable")


def collected(sweeps: DataFrame, grace: int) -> DataFrame:
    """Chunks erased by a stream of observations (hash, at, seq, live): hash, erased_at.

    A chunk seen dead is condemned, seen live is pardoned, and seen dead at least `grace` seconds after it was condemned is erased.
    Observations of a micro-batch are taken by time, then seq.
    """

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else -1
        erased = []
        for at, live in _in_order(frames, "at", "seq")[["at", "live"]].itertuples(index=False):
            if live:
                since = -1
            elif since < 0:
                since = int(at)
            elif at - since >= grace:
                erased.append(int(at))
                since = -1
        state.update((since,))
        yield pd.DataFrame({"hash": [key[0]] * len(erased), "erased_at": erased}).astype({"erased_at": "int64"})

    return sweeps.groupBy("hash").applyInPandasWithState(watch, "hash string, erased_at long", "since long", "append", "NoTimeout")


def expiring(marks: DataFrame, grace: int) -> DataFrame:
    """Chunks erased by a timer: of marks (hash, at: timestamp, ms: the same in milliseconds, live), hash and erased_at, when the watermark passes the end of the grace
    time of a chunk that was seen dead and not live since. No further observation of the chunk is needed.

    A chunk seen both dead and live at one millisecond of a micro-batch is live, whichever row comes first. Marks without a hash, a time or an answer say nothing, but a
    time moves the watermark. The watermark starts at 1970, and nothing is erased before that.
    """

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            due = state.get[0] + grace * 1000
            state.remove()
            yield pd.DataFrame({"hash": [key[0]], "erased_at": [int(due / 1000)]})
            return
        if pd.isna(key[0]):
            return
        rows = list(frames)
        ms, live = (np.concatenate([x[c].to_numpy() for x in rows]) for c in ("ms", "live"))
        known = ~(pd.isna(ms) | pd.isna(live))
        ms, live = ms[known].astype("int64"), live[known].astype(bool)
        dead = ms[~live].tolist() + ([state.get[0]] if state.exists else [])
        if live.any():
            last = int(ms[live].max())
            dead = [x for x in dead if x > last]
        if dead:
            since = min(dead)
            state.update((since,))
            state.setTimeoutTimestamp(max(since + grace * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return marks.withWatermark("at", "0 seconds").groupBy("hash").applyInPandasWithState(watch, "hash string, erased_at long", "since long", "append", "EventTimeTimeout")


def uploads(requests: DataFrame) -> DataFrame:
    """Multipart sessions of a stream of requests (upload_id, seq, op, part_number, size): upload_id, n_parts, size of those completed.

    A part replaces the one of its number; `abort` and `complete` end the session. Requests of a micro-batch are taken by seq.
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        parts = dict(zip(*state.get)) if state.exists else {}
        done = []
        for op, number, size in _in_order(frames, "seq")[["op", "part_number", "size"]].itertuples(index=False):
            if op == "part":
                parts[int(number)] = int(size)
            else:
                if op == "complete":
                    done.append((key[0], len(parts), sum(parts.values())))
                parts = {}
        state.update((list(parts), list(parts.values())))
        yield pd.DataFrame(done, columns=["upload_id", "n_parts", "size"]).astype({"upload_id": "object", "n_parts": "int64", "size": "int64"})

    return requests.groupBy("upload_id").applyInPandasWithState(follow, "upload_id string, n_parts long, size long", "numbers array<long>, sizes array<long>", "append", "NoTimeout")


def understanding(writes: DataFrame, embed: Callable[[list[bytes]], list[list[float]]], path: str) -> str:
    """Run a stream of writes (seq, tenant, object_id, data, tags array): embed each object, and keep of each (tenant, object_id) the last vector and
    all its tags, merged in order. Each micro-batch writes the table anew in its own folder below `path`; returns the last folder.

    A batch that is run again overwrites its own folder, so a restart repeats nothing.
    """

    def folder_of(batch: int) -> str:
        return f"{path}/vectors/batch={batch}"

    schema = "tenant string, object_id string, vector array<float>, tags map<string,string>, seq long"
    spark = writes.sparkSession
    spark.createDataFrame([], schema).write.parquet(folder_of(-1))
    seen, owner = [-1], ["tenant", "object_id"]

    def keep(rows: DataFrame, batch: int) -> None:
        before = spark.read.schema(schema).parquet(folder_of(max(b for b in seen if b < batch)))
        last = rows.groupBy(*owner).agg(F.max_by("data", "seq").alias("data"), F.max("seq").alias("seq"))
        vectors = understood(last, embed).join(last.select(*owner, "seq"), owner).select(*owner, "seq", "vector").unionByName(before.select(*owner, "seq", "vector"))
        made = F.transform("tags", lambda t, i: F.struct(F.concat(F.lit("auto:"), i.cast("string")).alias("key"), t.alias("value")))
        tags = rows.select(*owner, "seq", made.alias("e")).unionByName(before.select(*owner, "seq", F.map_entries("tags").alias("e")))
        put = lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"]))
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        tags = tags.groupBy(*owner).agg(F.aggregate(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "e"))), lambda x: x["e"])), none, put).alias("tags"))
        merged = vectors.groupBy(*owner).agg(F.max_by("vector", "seq").alias("vector"), F.max("seq").alias("seq")).join(tags, owner)
        merged.select(*owner, "vector", "tags", "seq").write.mode("overwrite").parquet(folder_of(batch))
        seen.append(batch)

    writes.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return folder_of(max(seen))
