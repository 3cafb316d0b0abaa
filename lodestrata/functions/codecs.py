"""Stored forms of chunks: as they are, or compressed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

CODECS = ("none", "zstd")


def known(codec: Column) -> Column:
    return codec.isin(*CODECS)


def _zstd(level: int):
    @pandas_udf(BinaryType())
    def run(data: pd.Series) -> pd.Series:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        return data.map(lambda x: None if x is None else packer.compress(bytes(x)))

    return run


@pandas_udf(BinaryType())
def _unzstd(data: pd.Series) -> pd.Series:
    import zstandard

    return data.map(lambda x: None if x is None else zstandard.ZstdDecompressor().decompress(bytes(x)))


def encode(data: Column, codec: str, level: int = 3) -> Column:
    if codec not in CODECS:
        raise ValueError(f"unknown codec: {codec}")
    return data if codec == "none" else _zstd(level)(data)


def decode(data: Column, codec: str) -> Column:
    if codec not in CODECS:
        raise ValueError(f"unknown codec: {codec}")
    return data if codec == "none" else _unzstd(data)


def sealed(data: Column, key: Column) -> Column:
    """Hex of nonce, AES-256-GCM ciphertext and tag."""
    return F.lower(F.hex(F.aes_encrypt(data, key, F.lit("GCM"))))


def opened(text: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unhex(text), key, F.lit("GCM"))
