"""What signed requests are made of: URI coding, canonical queries, the signing chain, basic credentials, paths, listings."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .scalars import xml_escaped


def uri_encoded(text: Column, keep_slash: bool = False) -> Column:
    """Percent-encoding of all but letters, digits and -_.~ (and of slashes, unless kept)."""
    shown = F.url_encode(text)
    for found, put in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((("%2F", "/"),) if keep_slash else ())):
        shown = F.replace(shown, F.lit(found), F.lit(put))
    return shown


def uri_decoded(text: Column) -> Column:
    """The reverse, with + as a space; a percent sign that begins no code stays."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_query(query: Column) -> Column:
    """Parameters decoded, encoded again and sorted by name, then value."""
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    value = lambda x: F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")
    code = lambda x: uri_encoded(uri_decoded(x))
    both = F.array_sort(F.transform(pairs, lambda x: F.struct(code(F.substring_index(x, "=", 1)).alias("k"), code(value(x)).alias("v"))))
    return F.array_join(F.transform(both, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def canonical_request(method: Column, path: Column, query: Column, headers: Column, payload_hash: Column) -> Column:
    """headers: an array of (name, value), signed in that order; values are trimmed."""
    lines = F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(":"), F.trim(h["value"]), F.lit("\n"))), "")
    names = F.array_join(F.transform(headers, lambda h: h["name"]), ";")
    return F.concat_ws("\n", method, path, canonical_query(query), lines, names, payload_hash)


def string_to_sign(date: Column, scope: Column, request: Column) -> Column:
    return F.concat_ws("\n", F.lit("AWS4-HMAC-SHA256"), date, scope, F.sha2(request, 256))


@pandas_udf(StringType())
def chained_signature(secret: pd.Series, scope: pd.Series, text: pd.Series) -> pd.Series:
    """Hex signature by the keyed chain over date, region, service and terminator of a scope; there is no built-in HMAC. Null for a scope of other than four parts."""

    def sign(s, parts, t):
        key = b"AWS4" + s.encode()
        for part in parts:
            key = hmac.new(key, part.encode(), hashlib.sha256).digest()
        return hmac.new(key, t.encode(), hashlib.sha256).hexdigest()

    rows = zip(secret, scope, text)
    return pd.Series([None if s is None or c is None or t is None or c.count("/") != 3 else sign(s, c.split("/"), t) for s, c, t in rows], dtype=object)


def basic_header(user: Column, password: Column) -> Column:
    coded = F.base64(F.encode(F.concat(user, F.lit(":"), password), "UTF-8"))
    return F.concat(F.lit("Basic "), F.regexp_replace(coded, "[\r\n]", ""))


def basic_credentials(header: Column) -> Column:
    """(user, password) of a basic authorisation header; null for any other. A password may hold colons."""
    plain = F.decode(F.try_to_binary(F.substring_index(header, " ", -1), F.lit("base64")), "UTF-8")
    found = F.struct(F.substring_index(plain, ":", 1).alias("user"), F.regexp_replace(plain, "(?s)^[^:]*:", "").alias("password"))
    return F.when(header.startswith("Basic ") & plain.contains(":"), found)


def path_pot(path: Column) -> Column:
    """The pot that a request's path begins with; empty for the root."""
    return F.split_part(F.ltrim(path, F.lit("/")), F.lit("/"), F.lit(1))


def listing_xml(pot: Column, created: Column) -> Column:
    return F.concat(F.lit("<Bucket><Name>"), xml_escaped(pot), F.lit("</Name><CreationDate>"), created, F.lit("</CreationDate></Bucket>"))
