from __future__ import annotations

import hashlib
import os

from pyspark.sql import functions as F

from lodestrata.functions import requests
from lodestrata.operators import store
from lodestrata.streaming import events as streams


def test_the_published_signing_example(spark):
    # The "get-vanilla" example that the scheme's authors publish.
    headers = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in (("host", "example.amazonaws.com"), ("x-amz-date", " 20150830T123600Z "))])
    request = requests.canonical_request(F.lit("GET"), F.lit("/"), F.lit(""), headers, F.lit(hashlib.sha256(b"").hexdigest()))
    scope = F.lit("20150830/us-east-1/service/aws4_request")
    text = requests.string_to_sign(F.lit("20150830T123600Z"), scope, request)
    signed = requests.chained_signature(F.lit("wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY"), scope, text)
    assert spark.range(1).select(signed).first()[0] == "5fa00fa31553b73ebf1942676e86291e8372ff2a2260956d9b8aae1d763fbf31"


def test_uri_coding(spark):
    row = spark.range(1).select(requests.uri_encoded(F.lit("a b/~*é%"), True).alias("kept"), requests.uri_encoded(F.lit("a/b")).alias("coded"), requests.uri_decoded(F.lit("a+b%2Fc%zz%")).alias("plain")).first()
    assert tuple(row) == ("a%20b/~%2A%C3%A9%25", "a%2Fb", "a b/c%zz%")


def test_a_point_read_lists_one_folder(spark, tmp_path):
    rows = spark.createDataFrame([("sha256:" + hashlib.sha256(b).hexdigest(), bytearray(b)) for b in (b"x", b"y", b"z")], "hash string, data binary")
    store.laid_out(rows, f"file://{tmp_path}/c")
    asked = "sha256:" + hashlib.sha256(b"y").hexdigest()
    found = store.by_hash(spark.read.schema("hash string, data binary, shard string").parquet(f"file://{tmp_path}/c"), asked)
    assert "PartitionFilters: [isnotnull(shard" in found._jdf.queryExecution().toString()
    assert found.first()["ok"] and bytes(found.first()["data"]) == b"y"
    bad = rows.withColumn("shard", F.substring("hash", 8, 2)).withColumn("data", F.lit("other").cast("binary"))
    assert store.by_hash(bad, asked).first()["ok"] is False and store.by_hash(bad, "sha256:00").count() == 0


def test_files_that_a_crash_left(spark, tmp_path):
    os.makedirs(tmp_path / "a")
    (tmp_path / "a" / "tmp-1").write_bytes(b"12")
    (tmp_path / "a" / "kept").write_bytes(b"1")
    (tmp_path / "other-tmp-").write_bytes(b"1")
    assert [r["length"] for r in store.leftovers(spark, f"file://{tmp_path}").collect()] == [2]


def _stream(spark, tmp_path, schema, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def test_sessions_across_batches_and_out_of_order(spark, tmp_path):
    schema = "upload_id string, seq long, op string, part_number long, size long"
    stream = _stream(spark, tmp_path, schema, [("u", 2, "part", 1, 20), ("u", 1, "part", 1, 10), ("v", 1, "part", 1, 1)], [("u", 4, "complete", 0, 0), ("u", 3, "part", 2, 5), ("v", 2, "abort", 0, 0)])
    assert [tuple(r) for r in streams.finished(streams.uploads(stream), "append").collect()] == [("u", 2, 25)]


def test_a_timer_erases_without_another_observation(spark, tmp_path):
    schema = "hash string, at timestamp, live boolean"
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, s)
    stream = _stream(spark, tmp_path, schema, [("a", at(1), False), ("b", at(1), False), ("b", at(2), True)], [("c", at(30), True)])
    found = streams.finished(streams.expiring(stream.withColumn("ms", F.unix_millis("at")), 10), "append").collect()
    assert [r["hash"] for r in found] == ["a"]


def test_timers_agree_with_sql_on_ties_and_nulls(spark, tmp_path):
    import datetime

    import duckdb
    from compare import same

    from lodestrata import queries

    at = lambda s, micro=0: datetime.datetime(2024, 1, 1, 0, 0, s, micro)
    marks = [("live", at(9)), ("error", at(9)), *[(kind, at(k % 5)) for kind in ("error", "live") for k in range(20)]]
    rows = [(when, user, kind) for user in (1, 2) for kind, when in (marks if user == 1 else marks[::-1])]
    rows += [(at(3, 400), 3, "error"), (at(3, 900), 3, "live"), (at(4, 900), 4, "live"), (at(4, 950), 4, "error"), (at(5), 4, "error"), (at(5), 5, "error"), (at(7), 5, "error")]
    rows += [(at(5), 6, None), (at(5), None, "error"), (None, 7, "error"), (None, 8, "live"), (at(6), 8, "error"), (at(6), 9, "error"), (at(8), 9, None)]
    rows += [(at(9) + datetime.timedelta(days=1), 10, None)]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string")
    table.selectExpr("*", "0D AS value", "'' AS props").coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = queries.QUERIES["stream_gc_expiry"](spark, f"file://{tmp_path}")
    assert {r["hash"] for r in found.collect()} == {"4", "5", "8", "9"}
    same(found, con, queries.ORACLES["stream_gc_expiry"])


def test_late_rows_are_dropped_outside_complete_mode(spark, tmp_path):
    schema = "ts timestamp, event_type string"
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    stream = _stream(spark, tmp_path, schema, [(day(1), "x")], [(day(9), "x")], [(day(9), "x")], [(day(1), "x")])
    got = {(r["day"], r["n"]) for r in streams.finished(streams.daily_counts(stream), "append").collect()}
    assert got == {("2024-01-01", 1)}
