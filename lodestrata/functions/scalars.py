"""Scalar functions and predicates of the catalog, as column expressions."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def valid_key(pot: Column, key: Column) -> Column:
    """Keys are not empty, and pot and key together fit a hex-coded file name."""
    return (F.octet_length(key) > 0) & (2 * F.octet_length(pot) + 2 * F.octet_length(key) + 6 <= 255)


def valid_pot(pot: Column) -> Column:
    return ~pot.isin("", ".", "..") & ~pot.contains("/") & ~pot.contains("\\")


def epoch(text: Column) -> Column:
    """Seconds of a timestamp text; times before 1970 are 0, and text that is no timestamp is null."""
    return F.greatest(F.lit(0).cast("long"), F.unix_timestamp(F.try_to_timestamp(text)))


def locked(until: Column, now: Column) -> Column:
    """Locked while `until` lies strictly ahead; no or unreadable time is no lock."""
    return F.coalesce(epoch(until) > now, F.lit(False))


def owner_key(read_only: Column, pots: Column) -> Column:
    return ~read_only & (F.size(pots) == 0)


def authorized(has_key: Column, read_only: Column, pots: Column, pot: Column, action: Column, public: Column) -> Column:
    """A key must reach the pot, and write only if it may; without a key, public pots can be read."""
    with_key = ~(read_only & (action != "read")) & ((F.size(pots) == 0) | F.array_contains(pots, pot))
    return F.when(has_key, with_key).otherwise((action == "read") & public)


def wants(events: Column, event: Column) -> Column:
    """Does a webhook with these events want this one? None or `*` wants all."""
    return (F.size(events) == 0) | F.array_contains(events, event) | F.array_contains(events, F.lit("*"))


def etag(object_id: Column) -> Column:
    return F.concat(F.lit('"'), object_id, F.lit('"'))


def etag_matches(header: Column, tag: Column) -> Column:
    """If-None-Match: `*`, or one of the comma-separated tags."""
    return (header == "*") | F.exists(F.split(header, ","), lambda x: F.trim(x) == tag)


def byte_range(header: Column, total: Column) -> Column:
    """(first, last) of `bytes=a-b`, `bytes=a-` or `bytes=-n`; null if it isn't satisfiable or well formed."""
    first, last = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", k).try_cast("long") for k in (1, 2))
    begin = F.when(first.isNull(), F.greatest(F.lit(0).cast("long"), total - last)).otherwise(first)
    end = F.when(first.isNull() | last.isNull(), total - 1).otherwise(F.least(last, total - 1))
    good = (first.isNotNull() | (last > 0)) & (begin <= end) & (begin < total)
    return F.when(good, F.struct(begin.alias("first"), end.alias("last")))


def cache_control(immutable: Column) -> Column:
    return F.when(immutable, "public, max-age=31536000, immutable").otherwise("public, max-age=60, must-revalidate")


def content_class(content_type: Column) -> Column:
    """How a viewer shows a content type."""
    shown = F.lit(None).cast("string")
    for family in ("audio", "video", "image"):
        shown = F.when(content_type.startswith(f"{family}/"), family).otherwise(shown)
    text = content_type.startswith("text/")
    for part in ("json", "xml", "javascript", "markdown"):
        text = text | content_type.contains(part)
    return F.coalesce(shown, F.when(content_type == "application/pdf", "pdf").when(text, "text").otherwise("other"))


def xml_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def query_map(query: Column) -> Column:
    """Parameters of a query string, undecoded; of a repeated name the last counts."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.regexp_replace(x, r"^[^=]*=", "")).otherwise("").alias("v")))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(pairs, empty, lambda m, p: F.map_from_entries(F.concat(F.filter(F.map_entries(m), lambda e: e["key"] != p["k"]), F.array(F.struct(p["k"].alias("key"), p["v"].alias("value"))))))


def part_numbers(body: Column) -> Column:
    """The part numbers that a completion request lists, in order; what is no unsigned number of 32 bits is skipped."""
    found = F.transform(F.regexp_extract_all(body, F.lit(r"<PartNumber>\s*(\d+)\s*</PartNumber>"), F.lit(1)), lambda x: x.try_cast("long"))
    return F.filter(found, lambda x: x.between(0, 0xFFFFFFFF))


def human_bytes(size: Column) -> Column:
    """Sizes as people read them, by steps of 1024."""
    shown = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        shown = F.when(size >= 1024**power, F.concat(F.format_string("%.1f", size / float(1024**power)), F.lit(f" {unit}"))).otherwise(shown)
    return shown


def short_hash(address: Column) -> Column:
    """The first six and last four digits of an address of more than twelve."""
    digits = F.substring_index(address, ":", -1)
    return F.when(F.length(digits) > 12, F.concat(F.substring(digits, 1, 6), F.lit("…"), F.substring(digits, -4, 4))).otherwise(digits)


def shard(address: Column) -> Column:
    return F.substring(F.substring_index(address, ":", -1), 1, 2)


@pandas_udf(StringType())
def signature(secret: pd.Series, message: pd.Series) -> pd.Series:
    """Hex HMAC-SHA256; there is no built-in for it."""
    return pd.Series([None if s is None or m is None else hmac.new(s.encode(), m.encode(), hashlib.sha256).hexdigest() for s, m in zip(secret, message)], dtype=object)


def presigned(secret: Column, pot: Column, key: Column, expires: Column) -> Column:
    return signature(secret, F.concat(pot, F.lit("/"), key, F.lit("?exp="), expires.cast("string")))


def presign_valid(secret: Column, pot: Column, key: Column, expires: Column, given: Column, now: Column) -> Column:
    return (now <= expires) & (presigned(secret, pot, key, expires) == given)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision: the product ends with the shorter vector, and a zero vector scores 0."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(size == 0, 0.0).otherwise(dot / size)


def status_of(error: Column) -> Column:
    """The HTTP status for an error's name: the caller's own mistakes have one, the rest are the server's."""
    told = {"Locked": 409, "TooLarge": 413, "Forbidden": 403, **dict.fromkeys(("InvalidKey", "InvalidPart", "BadBucket", "Upload"), 400)}
    status = F.when(error.isNull(), 200)
    for name, code in told.items():
        status = status.when(error == name, code)
    return status.otherwise(500)


def upload_id(pot: Column, key: Column, seconds: Column, number: Column) -> Column:
    return F.sha2(F.concat_ws("/", pot, key, seconds.cast("string"), number.cast("string")), 256)
