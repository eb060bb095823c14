from __future__ import annotations

import random

import pytest
from texts import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hashes string, n_tokens int, spans string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts (or (text, source) pairs), with columns whose names clash with the operators' own."""

    def frame(texts, ids=None, langs=None, sources=None):
        rows = []
        for k, text in enumerate(texts):
            lang = langs[k] if langs else "en"
            source = sources[k] if sources else ("a", "b", None)[k % 3]
            rows.append((ids[k] if ids else k, text, lang, source, len(text) if text is not None else None, "x", 3, None))
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return frame


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, without letters, long, repeated, and beyond ASCII."""
    rng = random.Random(5)
    long_text = words(rng, 20_000)
    return [None, "", "   ", "12 34 -- !!", long_text, "Straße élan 日本語 😀 \u0001 x", long_text, "one two", "a" * 5000, "a" * 5000]
