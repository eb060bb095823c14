from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline
from areal_exposure.llm import packing
from texts import words


def brute_best_fit(lengths, sources, clusters, capacity):
    """Each item, longest first, into the fullest bin that may hold it: by looking at all bins."""
    bins, placed = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [
            (room, b)
            for b, (room, s, c) in enumerate(bins)
            if room >= lengths[i] and not (sources[i] >= 0 and sources[i] in s) and not (clusters[i] >= 0 and clusters[i] in c)
        ]
        if fits:
            room, b = min(fits)
        else:
            room, b = capacity, len(bins)
            bins.append((capacity, set(), set()))
        placed[i] = (b, capacity - room)
        bins[b] = (room - lengths[i], bins[b][1] | {sources[i]}, bins[b][2] | {clusters[i]})
    return placed


def test_best_fit_equals_brute_force():
    rng = random.Random(12)
    for n in (0, 1, 30, 200):
        items = [(rng.randint(0, 50), rng.randint(-1, 6), rng.randint(-1, 40)) for _ in range(n)]
        columns = [list(c) for c in zip(*items, strict=True)] or [[], [], []]
        assert packing.best_fit(*columns, 100) == brute_best_fit(*columns, 100)


def test_packed_bins_hold_their_rules(make, odd_texts):
    rng = random.Random(13)
    texts = [words(rng, rng.randint(0, 90)) for _ in range(300)] + odd_texts + ["same words", "Same, words!"] * 3
    sources = ["hot" if k % 3 else f"s{k % 7}" for k in range(len(texts))]
    rows = packing.pack_texts(make(texts, sources=sources), capacity=64, group_items=50).collect()
    lengths = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        lengths[r["doc_id"]] += r["length"]
        bins[r["bin_id"]].append(r)
    assert [lengths[k] for k in range(len(texts))] == [len((t or "").split()) for t in texts]
    for held in bins.values():
        held.sort(key=lambda r: (r["start"], r["length"]))
        assert sum(r["length"] for r in held) <= 64
        assert all(a["start"] + a["length"] == b["start"] for a, b in zip(held, held[1:], strict=False))
        assert len({r["source"] for r in held}) == len(held)
    assert packing.pack_texts(make([])).count() == 0


def test_stages_take_effect(spark, make, odd_texts, tmp_path):
    rng = random.Random(14)
    item = words(rng, 40)
    texts = [words(rng, 60) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", "x " + item + " y", "password=abcdef0123456789 " + words(rng, 30)] + odd_texts[:4]
    docs = make(texts, langs=["en"] * len(texts))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        seen[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(seen["language_id"]) == set(range(44))  # those without letters go
    assert set(seen["near_duplicates"]) == set(range(40)) | {42, 43}
    assert set(seen["decontamination"]) == set(range(40)) | {43}
    assert seen["secrets"][43].startswith("[secret] ") and seen["secrets"][5] == texts[5]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == set(seen["secrets"])
