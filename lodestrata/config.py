"""Settings: defaults, then a TOML file, then environment variables."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Sizes in bytes, times in seconds."""

    tenant: str = "default"
    codec: str = "zstd"
    zstd_level: int = 3
    chunk_least: int = 16 << 10
    chunk_average: int = 64 << 10
    chunk_largest: int = 256 << 10
    max_object_bytes: int = 512 << 20
    gc_grace: int = 86_400
    gc_interval: int = 3_600
    top_k: int = 10


def load(path: str | None = None, environ: dict[str, str] | None = None, prefix: str = "LODESTRATA_") -> Settings:
    """A missing file is like an empty one; unknown names are refused."""
    settings = Settings()
    known = {f.name: f.type for f in fields(Settings)}
    if path and os.path.exists(path):
        with open(path, "rb") as file:
            found = tomllib.load(file)
        if strange := set(found) - set(known):
            raise ValueError(f"unknown settings: {sorted(strange)}")
        settings = replace(settings, **found)
    environ = os.environ if environ is None else environ
    given = {n: environ[prefix + n.upper()] for n in known if prefix + n.upper() in environ}
    return replace(settings, **{n: int(v) if known[n] == "int" else v for n, v in given.items()})
