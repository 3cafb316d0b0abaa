from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrata.config import Settings, load
from lodestrata.operators import access

KEYS = "access_key string, secret_key string, read_only boolean, pots array<string>, created_at string"


def test_settings_layers(tmp_path):
    file = tmp_path / "settings.toml"
    assert load(str(file), {}) == Settings()
    file.write_text('tenant = "acme"\ngc_grace = 5\n')
    got = load(str(file), {"LODESTRATA_GC_GRACE": "7", "LODESTRATA_CODEC": "none"})
    assert (got.tenant, got.gc_grace, got.codec, got.zstd_level) == ("acme", 7, "none", 3)
    file.write_text("nonsense = 1\n")
    with pytest.raises(ValueError):
        load(str(file), {})


def test_keys(spark):
    none = spark.createDataFrame([], KEYS)
    owner = spark.createDataFrame([("o", "s", False, [], "")], KEYS)
    assert access.signing_secret(none).first()["secret"] is None
    assert access.seeded(none, owner).count() == 1 and access.seeded(owner, owner).count() == 1
    made = access.created(owner, spark.createDataFrame([("o", "t", True, [], ""), ("p", "u", False, ["x"], "then")], KEYS), F.lit("now"))
    assert sorted((r["access_key"], r["secret_key"], r["created_at"]) for r in made.collect()) == [("o", "t", "now"), ("p", "u", "then")]
    assert "secret_key" not in access.redacted(made).columns
    rows = access.json_rows(spark.createDataFrame([(1, None)], "a int, b string")).first()["json"]
    assert rows == '{"a":1,"b":null}'
