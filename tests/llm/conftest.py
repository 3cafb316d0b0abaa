from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with nulls, empty and very long texts, repeated rows and ids, and columns whose names clash with inner ones."""
    rows = [
        (1, "The and of to in is that", "en", 7), (2, None, "en", None), (3, "", None, 0), (4, "   \n\t ", "fr", 5), (5, LONG, "en", len(LONG)), (6, "The and of to in is that", "en", 7),
        (6, "The and of to in is that", "en", 7), (7, "Ünïcödé 日本語 \U0001f600 mail me@example.org now", None, 3), (None, "no id here at all", "de", 4), (None, None, None, None), (8, "x", "es", 1),
    ]
    extra = [(*r, "k", 5, "r", 9, "e", 2.0, "b", True) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, n_chars long, key string, rid int, row string, h int, email string, score double, block string, indexed boolean")


@pytest.fixture(scope="session")
def none(hard):
    return hard.limit(0)
