"""Content addresses: SHA-256 with built-in functions, BLAKE3 as a vectorised function for parity, and Merkle trees as folds."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

ADDRESS = r"^(sha256|blake3):[0-9a-fA-F]{64}$"

# Fixed values of the published BLAKE3 specification.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_MASK = 0xFFFFFFFF


def _compress(chaining: tuple[int, ...], block: bytes, counter: int, length: int, flags: int) -> tuple[int, ...]:
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    v = [*chaining, *_IV[:4], counter & _MASK, counter >> 32, length, flags]

    def quarter(a: int, b: int, c: int, d: int, x: int, y: int) -> None:
        for word, first, second in ((x, 16, 12), (y, 8, 7)):
            v[a] = (v[a] + v[b] + word) & _MASK
            t = v[d] ^ v[a]
            v[d] = (t >> first | t << (32 - first)) & _MASK
            v[c] = (v[c] + v[d]) & _MASK
            t = v[b] ^ v[c]
            v[b] = (t >> second | t << (32 - second)) & _MASK

    for _ in range(7):
        for k in range(4):
            quarter(k, k + 4, k + 8, k + 12, m[2 * k], m[2 * k + 1])
        for k in range(4):
            quarter(k, (k + 1) % 4 + 4, (k + 2) % 4 + 8, (k + 3) % 4 + 12, m[2 * k + 8], m[2 * k + 9])
        m = [m[k] for k in _ORDER]
    return tuple(v[k] ^ v[k + 8] for k in range(8))


def blake3(data: bytes) -> bytes:
    """The 32-byte BLAKE3 hash."""

    def leaf(chunk: bytes, number: int, root: int) -> tuple[int, ...]:
        blocks = [chunk[k : k + 64] for k in range(0, len(chunk), 64)] or [b""]
        state = _IV
        for k, block in enumerate(blocks):
            last = k + 1 == len(blocks)
            state = _compress(state, block, number, len(block), _CHUNK_START * (k == 0) | (_CHUNK_END | root) * last)
        return state

    def tree(low: int, high: int, root: int) -> tuple[int, ...]:
        if high - low == 1:
            return leaf(data[1024 * low : 1024 * high], low, root)
        left = 1 << ((high - low - 1).bit_length() - 1)  # the largest power of two below the number of chunks
        pair = struct.pack("<16I", *tree(low, low + left, 0), *tree(low + left, high, 0))
        return _compress(_IV, pair, 0, 64, _PARENT | root)

    return struct.pack("<8I", *tree(0, max(1, -(-len(data) // 1024)), _ROOT))


@pandas_udf(StringType())
def blake3_address(data: pd.Series) -> pd.Series:
    """`blake3:<hex>` of a binary column; null for null. Pure Python: for checks of single objects, not for bulk."""
    return data.map(lambda x: None if x is None else "blake3:" + blake3(bytes(x)).hex())


def address(data: Column) -> Column:
    """`sha256:<hex>` of a binary or string column."""
    return F.concat(F.lit("sha256:"), F.sha2(data.cast("binary"), 256))


def valid_address(text: Column) -> Column:
    return text.rlike(ADDRESS)


def raw(address_text: Column) -> Column:
    """The 32 bytes of an address."""
    return F.unhex(F.substring_index(address_text, ":", -1))


def manifest_json(manifest: dict) -> str:
    """What an object id is the hash of: compact JSON with sorted keys, without the id, and without an absent Merkle root."""
    body = {k: v for k, v in manifest.items() if k != "object_id"}
    if body.get("chunking", {}).get("merkle_root", "") is None:
        body["chunking"] = {k: v for k, v in body["chunking"].items() if k != "merkle_root"}
    return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _hash(prefix: str, *parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit(prefix)), *parts), 256))


def merkle_leaf(chunk: Column) -> Column:
    return _hash("00", chunk)


def merkle_node(left: Column, right: Column) -> Column:
    return _hash("01", left, right)


def merkle_empty() -> Column:
    return _hash("02")


def _rounds(leaves: Column) -> Column:
    """One element for each level above the leaves."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.size(leaves), F.lit(1)))).cast("int")))


def _up(level: Column) -> Column:
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")),
        lambda k: F.when(2 * k + 1 < F.size(level), merkle_node(F.get(level, 2 * k), F.get(level, 2 * k + 1))).otherwise(F.get(level, 2 * k)),
    )
    return F.when(F.size(level) <= 1, level).otherwise(pairs)


def merkle_root(chunks: Column) -> Column:
    """The root over an ordered array of 32-byte chunk hashes: an odd tail moves up unchanged; no chunk has a root of its own."""
    leaves = F.transform(chunks, merkle_leaf)
    return F.when(F.size(chunks) == 0, merkle_empty()).otherwise(F.get(F.aggregate(_rounds(chunks), leaves, lambda level, _: _up(level)), 0))


def merkle_proof(chunks: Column, index: Column) -> Column:
    """The audit path of a chunk: array of (side, hash) from the leaf up, hex; null for an index outside. A level where the node has no sibling adds no step."""
    start = F.struct(F.transform(chunks, merkle_leaf).alias("level"), index.cast("int").alias("at"), F.array().cast("array<struct<side:string,hash:string>>").alias("steps"))

    def climb(state: Column, _: Column) -> Column:
        level, at = state["level"], state["at"]
        left = at % 2 == 1
        beside = F.when(left, at - 1).otherwise(at + 1)
        step = F.struct(F.when(left, "left").otherwise("right").alias("side"), F.lower(F.hex(F.get(level, beside))).alias("hash"))
        steps = F.when(beside < F.size(level), F.concat(state["steps"], F.array(step))).otherwise(state["steps"])
        return F.struct(_up(level).alias("level"), F.floor(at / 2).cast("int").alias("at"), steps.alias("steps"))

    return F.when((index >= 0) & (index < F.size(chunks)), F.aggregate(_rounds(chunks), start, climb, lambda state: state["steps"]))


def merkle_verify(chunk: Column, steps: Column, root: Column) -> Column:
    """Does the path lead from the chunk to the root?"""
    folded = F.aggregate(steps, merkle_leaf(chunk), lambda at, s: F.when(s["side"] == "left", merkle_node(F.unhex(s["hash"]), at)).otherwise(merkle_node(at, F.unhex(s["hash"]))))
    return folded == root


def object_root(declared: Column, chunks: Column) -> Column:
    """The declared root as hex, computed only where there is none."""
    return F.coalesce(declared, F.lower(F.hex(merkle_root(chunks))))
