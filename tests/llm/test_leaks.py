from __future__ import annotations

import random

from areal_exposure.llm import benchmark_leaks as B
from texts import words


def test_majority_votes(spark):
    rng = random.Random(1)
    rows = [[rng.getrandbits(64) - 2**63 for _ in range(16)] for _ in range(30)]
    df = spark.createDataFrame(rows, ", ".join(f"v{k} long" for k in range(16)))
    for size in (8, 16):
        out = B.with_votes(df, [f"v{k}" for k in range(size)], f"f{size}").collect()
        for row, r in zip(rows, out, strict=True):
            want = sum(1 << b for b in range(64) if sum(v >> b & 1 for v in row[:size]) > size / 2)
            assert r[f"f{size}"] & (2**64 - 1) == want


def test_leaks_are_found_and_clean_documents_left(spark, make, odd_texts):
    rng = random.Random(6)
    items = [words(rng, n) for n in (5, 8, 11, 14, 20, 23, 30, 47, 56, 90)] + [None, "", "too short"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts, want = [], set()
    for k, item in enumerate(items[2:10], 2):
        for before in (0, 1, 2, 3, 40):
            want.add((len(texts), k))
            texts.append(f"{words(rng, before)} {item.upper()}.\n{words(rng, 30)}")
    for k in (7, 8, 9):  # a word changed in a long item
        w = items[k].split()
        w[len(w) // 2] = "zzz"
        if (len(w) - 9) / (len(w) + 1) >= 0.8:
            want.add((len(texts), k))
        texts.append(words(rng, 9) + " " + " ".join(w) + " " + words(rng, 5))
    cut = items[8].split()
    want.add((len(texts), 8))
    texts.append(" ".join(cut[4:]) + " " + words(rng, 20))
    half = items[9].split()[:40]
    texts.append(" ".join(half))  # less than half of it
    texts += odd_texts + [words(rng, 300)]
    docs = make(texts)
    found = B.leaks(docs, benchmark)
    assert found.columns == ["doc_id", "item_id", "similarity", "start"]
    rows = found.collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    assert all(0.8 <= r["similarity"] <= 1 for r in rows)
    kept = B.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_short_items_are_found_at_every_place(spark, make):
    rng = random.Random(8)
    items = [words(rng, n) for n in range(5, 14)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts, want = [], set()
    for k, item in enumerate(items):
        for before in range(9):
            for after in (0, 30):  # alone, and at the start, inside and at the end of a text
                want.add((len(texts), k))
                texts.append(f"{words(rng, before)} {item.upper()}, {words(rng, after)}")
    for k in (4, 5, 6, 7, 8):  # without the last word, at the end of a text: 0.8 or more of the shingles
        for before in range(4):
            want.add((len(texts), k))
            texts.append(f"{words(rng, 20 + before)} {' '.join(items[k].split()[:-1])}")
    texts += [" ".join(items[k].split()[:-1]) for k in range(4)] + [f"{items[k].split()[0]} {words(rng, 20)}" for k in range(9)]
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in B.leaks(make(texts), benchmark).collect()}
    assert set(found) == want
    assert all(found[d, k] == 1 for d, k in want if d < 2 * 9 * len(items))


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert B.leaks(make([]), none).count() == 0
    assert B.without_leaks(make(["a b c d e f g h i j k"]), none).count() == 1
