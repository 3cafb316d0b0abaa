from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa

from lodestrata.llm import language
from lodestrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op7_language_id"](spark, SF).join(docs, "doc_id").toPandas()
    held = found[found["held_out"]]
    assert len(found) == 1000 and (held["lang_pred"] == held["lang"]).mean() > 0.97 and found["score"].between(0, 1).all()


def test_code_switched_text_is_labelled_by_word(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(language.training_rows(docs))
    texts = {r["lang"]: r["text"] for r in docs.where("doc_id in (1, 3, 26)").collect()}
    mixed = " ".join(" ".join(texts[x].split()[:40]) for x in ("en", "fr", "de"))
    got = language.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert got["n_words"] == 120 and 2 <= got["n_switches"] <= 12 and got["score"] < 0.7


def test_hard_rows(spark, hard, none):
    found = {(r["doc_id"], r["lang_pred"]) for r in language.identify(hard).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= found and language.identify(hard).count() == hard.count()
    assert language.identify(none).count() == 0
    nameless = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert language.identify(nameless).first()["lang_pred"] == "und"
    model = language.fit(language.training_rows(spark.read.parquet(f"{SF}/documents.parquet")))
    kept = language.accepted(hard, model)
    assert kept.columns == hard.columns and kept.where("text is null or trim(text) = ''").count() == 0 and kept.where("doc_id = 1").count() == 1


def test_training_documents_are_those_of_the_least_hashes(spark):
    """Dealt by groups of partitions or not, the same documents teach, so the weights are the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    one, many = (language.fit(docs.repartition(n), per_language=5) for n in (1, 40))
    assert one.languages == many.languages and (one.field.weights == many.field.weights).all()


def test_training_holds_little_memory_of_the_driver(spark):
    draw = random.Random(4)
    rows = [(k, " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(500)), "ab"[k % 2]) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    model = language.fit(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.languages == ["a", "b"] and peak < 60 << 20


def test_features_of_many_words_are_those_of_the_words(monkeypatch):
    words = pa.array(["", "a", "\u00fcber", "word", "x" * 40, "\u65e5\u672c"] * 7)
    monkeypatch.setattr(language, "FEATURED", 5)
    for some in (words, words.slice(3, 11), words.slice(2, 1)):
        for one, many in zip(language.word_features(some), language._features_of_many(some, language.BITS)):
            assert one.tolist() == many.tolist()
