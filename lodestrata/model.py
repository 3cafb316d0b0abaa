"""Schemas of the catalog tables, as DDL strings."""

from __future__ import annotations

MANIFEST_VERSION = 1

MANIFEST = (
    "manifest_version INT, object_id STRING, created_at STRING, "
    "original STRUCT<size_bytes: BIGINT, sha256: STRING, content_type: STRING>, "
    "storage STRUCT<route: STRING, fidelity: STRING, codec: STRING, codec_params: STRING, stored_size_bytes: BIGINT, reconstructs_original: BOOLEAN>, "
    "chunking STRUCT<algo: STRING, chunks: ARRAY<STRING>, merkle_root: STRING>, "
    "quality STRUCT<metric: STRING, score: DOUBLE>, tenant STRING, policy_snapshot STRING"
)
POINTER_LOG = "pot STRING, key STRING, seq BIGINT, object_id STRING, op STRING"
CHUNK = "hash STRING, data BINARY"
POT_CONFIG = "pot STRING, public_read BOOLEAN, codec STRING, zstd_level INT, fidelity STRING, route_by_content_type BOOLEAN, max_versions INT, expire_after_days INT"
ANNOTATION = "pot STRING, key STRING, tags MAP<STRING, STRING>, note STRING, favorite BOOLEAN, locked_until STRING"
ACCESS_KEY = "access_key STRING, secret_key STRING, read_only BOOLEAN, pots ARRAY<STRING>, created_at STRING"
WEBHOOK = "id STRING, url STRING, events ARRAY<STRING>"
VECTOR = "tenant STRING, object_id STRING, vector ARRAY<FLOAT>"
WRITE_EVENT = "object_id STRING, tenant STRING, content_type STRING, bucket STRING, key STRING"
CONDEMNED = "hash STRING, condemned_at BIGINT"
PART = "upload_id STRING, part_number INT, chunks ARRAY<STRING>, stored_size BIGINT, orig_size BIGINT, etag STRING"
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
