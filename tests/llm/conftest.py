from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text, lang, source) as a table like ``documents``."""
    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make

