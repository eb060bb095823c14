from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from areal_exposure.llm import ranked_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(ranked_search.TERM, (text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(doc_id, Counter(terms(text)), len(terms(text))) for doc_id, text in docs]
    n_docs, words = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc_id, c, n in held:
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // words))) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, doc_id))
        out += [(item, rank, doc_id, -s) for rank, (s, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"W{min(int(rng.expovariate(0.1)), 90)}" for _ in range(rng.randint(1, 12)))) for k in range(40)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "w1 W1 w1-w2"), (53, "w3"), (54, "Élan 日本 x_y")]
    frame = spark.createDataFrame([(i, t, 7, "clash") for i, t in items], "item_id long, text string, rank int, term string")
    return items, frame


@pytest.mark.parametrize(("block", "sent", "bundle"), [(8192, 500_000, 256), (50, 0, 9)])
def test_against_brute_force(make, asked, monkeypatch, block, sent, bundle):
    items, frame = asked
    rng = random.Random(4)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.1)), 90)}" for _ in range(rng.randint(0, 80))) for _ in range(600)]
    texts += [texts[0]] * 40 + [None, "", "-- !", "élan ÉLAN 日本 x y", "w1 " * 20_000]
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(ranked_search, "_SENT_TERMS", sent)
    monkeypatch.setattr(ranked_search, "BUNDLE", bundle)
    got = ranked_search.top_documents(make(texts), frame).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)), items)


def test_repeated_and_null_ids(make, spark, asked):
    items, frame = asked
    docs = [(5, "w1 w2"), (5, "w1 w2"), (5, "w1"), (7, "w1 w2"), (8, "w9"), (9, "w8 w7")]
    got = ranked_search.top_documents(make([t for _, t in docs], [i for i, _ in docs]), frame, k=3).collect()
    assert sorted(map(tuple, got)) == brute(docs, items, 3)
    lost = spark.createDataFrame([(None, "w1 w2")], "item_id long, text string")
    assert [r["rank"] for r in ranked_search.top_documents(make([t for _, t in docs]), lost, k=2).collect()] == [1, 2]


def test_empty_tables(make, asked):
    _, frame = asked
    columns = ["item_id", "rank", "doc_id", "score"]
    for docs, items in ((make([]), frame), (make([None, "--"]), frame), (make(["w1 w2", "w3"]), frame.limit(0))):
        found = ranked_search.top_documents(docs, items)
        assert found.columns == columns and found.count() == 0
