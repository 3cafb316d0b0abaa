"""The pipeline's stages, each on what the stage before it kept, against plain Python."""

from __future__ import annotations

import itertools
import re

import numpy as np
import public_tokenizers
from test_packing import check
from test_pii import base
from tokenizers import Tokenizer

import corpus_pipeline
from lodestrata.llm import language
from lodestrata.llm.session import documents

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def leaks(text, item):
    """Does any 20-word window of the item (all of a shorter one) agree in 80% of its words with the text, at some distance?"""
    a, b = words(text), words(item)
    n = min(20, len(b))
    for shift in range(-len(b), len(a)):
        same = [0 <= shift + k < len(a) and a[shift + k] == w for k, w in enumerate(b)]
        if any(sum(same[k : k + n]) >= 0.8 * n for k in range(len(b) - n + 1)):
            return True
    return False


def heads(rows):
    """The least id of each group of texts linked by a Jaccard similarity of 0.8 of their sets of five-word shingles."""
    sets = {}
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[d] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {top(d) for d in sets}


def test_stage_by_stage(spark):
    read = lambda f: {r["doc_id"]: r for r in f.collect()}
    docs = documents(spark, SF)
    start = read(docs)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "pii", "packing"]

    one = spark.createDataFrame(stages["language_id"](spark, docs, SF).collect(), docs.schema)
    told = {r["doc_id"]: r for r in language.predict(docs, language.fit(language.training_rows(docs))).collect()}
    assert set(read(one)) == {d for d, r in told.items() if r["lang_pred"] != "und" and r["score"] >= 0.4}
    assert len(read(one)) > 0.95 * len(start)

    two = spark.createDataFrame(stages["simhash_near_dedup"](spark, one, SF).collect(), docs.schema)
    assert set(read(two)) == heads([(d, r["text"]) for d, r in read(one).items()])

    three = spark.createDataFrame(stages["benchmark_decontamination"](spark, two, SF).collect(), docs.schema)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = {w for t in items for w in zip(*[words(t)[k:] for k in range(3)])}
    dirty = {d for d, r in read(two).items() if near & set(zip(*[words(r["text"])[k:] for k in range(3)])) and any(leaks(r["text"], t) for t in items)}
    assert set(read(three)) == set(read(two)) - dirty and dirty

    four = spark.createDataFrame(stages["pii"](spark, three, SF).collect(), docs.schema)
    assert four.columns == docs.columns and set(read(four)) == set(read(three))
    changed = 0
    for d, r in read(four).items():
        before = start[d]["text"]
        if base(before):
            changed += 1
            assert not base(r["text"]) and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == before
    assert changed

    pieces = stages["packing"](spark, four, SF).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [1], dtype=np.uint32) for d, r in read(four).items()}
    assert set(pieces["doc_id"]) == set(ids)
    check(pieces, ids, 2048)

    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert whole.groupby("doc_id")["length"].sum().to_dict() == pieces.groupby("doc_id")["length"].sum().to_dict()


def test_hard_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, long texts, clashing names, and empty tables, through all stages."""
    text = {r["doc_id"]: r["text"] for r in documents(spark, SF).where("doc_id < 40").collect()}
    rows = [(k, t, "en", "s", None) for k, t in text.items()] + [(None, text[1], None, None, 1), (None, text[1], None, None, 1), (None, None, "en", None, 2), (5, None, "en", "s", 3), (6, "", None, "s", 0), (7, text[2], "en", "s", 4), (7, text[2], "en", "s", 4), (208, "Der Hund \U0001f600 " * 9000, "de", "s", 5), (209, "1 2 3 .", "de", None, 6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).selectExpr("*", "1 AS rid", "text AS key", "true AS block", "doc_id AS node", "source AS _lodestrata_id2").write.parquet(f"file://{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, None), (None, "lorem ipsum " * 20)], "item_id long, text string").write.parquet(f"file://{tmp_path}/a/benchmark.parquet")
    found = corpus_pipeline.run(spark, f"file://{tmp_path}/a").toPandas()
    assert found["length"].sum() > 0 and 208 in set(found["doc_id"]) and 209 not in set(found["doc_id"]) and found["doc_id"].isna().sum() >= 1
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/b").count() == 0
