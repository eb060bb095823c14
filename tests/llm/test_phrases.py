from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from areal_exposure.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, langs, least, first):
    out = []
    for lang in {x or "und" for x in langs}:
        pieces = [re.findall(r"[^ \t]+", p) for t, x in zip(texts, langs, strict=True) if (x or "und") == lang for p in re.split(r"[.,;:!?\x0a-\x0d]", (t or "").translate(LOWER))]
        f = Counter(" ".join(p[i : i + k]) for p in pieces for i in range(len(p)) for k in range(1, 6) if i + k <= len(p))
        n = sum(map(len, pieces))
        common = {p: a for p, a in f.items() if " " in p and a >= least}
        rows = []
        for p, a in common.items():
            if any(b >= a and p != q and f" {p} " in f" {q} " for q, b in common.items()):
                continue
            w = p.split(" ")
            score, k = min((1000 * a * n // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w)))
            rows.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:first], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def found(docs, least, first):
    return sorted(map(tuple, phrases.collocations(docs, least, first).collect()))


@pytest.mark.parametrize(("seed", "first", "coded"), [(1, 2000, 200_000), (2, 7, 3), (3, 2000, 0)])
def test_against_brute_force(make, monkeypatch, seed, first, coded):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "Élan", "d\x1ce", "f\xa0g", "h'i", "rare%d"]
    texts, langs = [], []
    for _ in range(150):
        words = [rng.choice(vocabulary).replace("%d", str(rng.randrange(500))) for _ in range(rng.randint(0, 60))]
        texts.append("".join(w + rng.choice(["  ", " ", " ", " ", "\t", ". ", ",", "\n", "\x0b"]) for w in words))
        langs.append(rng.choice(["en", "und", None, "fr"]))
    texts += ["the same line over and over again here"] * 30 + [None, "", " ,; ", "x"]
    langs += ["en"] * 34
    monkeypatch.setattr(phrases, "_HELD", 200)  # several parts from each task
    monkeypatch.setattr(phrases, "_HELD_GRAMS", 200)
    monkeypatch.setattr(phrases, "_CODED", coded)  # the rest are spelled
    assert found(make(texts, langs=langs), 5, first) == brute(texts, langs, 5, first)


def test_equal_grams_of_a_task_are_handed_on_once(monkeypatch):
    """They were handed on anew whenever many places had been read."""
    monkeypatch.setattr(phrases, "_HELD_GRAMS", 40)
    full = np.full(1 << (phrases._BITS - 6), 2**64 - 1, np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["a b c d e f"] * 4)], names=["lang", "text"])
    for code in (phrases.codes(list("abcdef")), {}):
        rows = [r for b in phrases._counted_grams(iter([batch] * 10), full, full, code) for r in b.to_pylist()]
        assert sorted(r["n"] for r in rows) == [40] * 9  # five pairs, and one gram of three words or more at four places


def test_what_a_task_holds_is_bounded_over_all_languages(monkeypatch):
    """Each language held as many words as all may together, rare words too."""
    monkeypatch.setattr(phrases, "_KNOWN", 100)
    none, held = np.zeros(1 << (phrases._BITS - 6), np.uint64), {}
    for i in range(8):
        known = phrases._known(held, f"l{i}", none, {})
        known.pairs([b"w%d" % k for k in range(60)])
        assert len(known.codes) == 2
    assert sum(map(len, held.values())) <= 100 + 61


def test_memory_of_a_task():
    """Sorting took several times what was held, and a task handed all it held on at once."""
    full = np.full(1 << (phrases._BITS - 6), 2**64 - 1, np.uint64)
    code = phrases.codes([f"w{i}" for i in range(2000)])
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(2000)], k=5000)) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"]) for text in texts]

    def peak(made):
        tracemalloc.start()
        rows = [(len(b), sum(n for n, x in zip(b["n"].to_pylist(), b.column(b.num_columns - 2).to_pylist(), strict=True) if type(x) is not str)) for b in made]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(n for _, n in rows) == 60 * 4999  # all pairs
        assert max(n for n, _ in rows) <= 50_000
        return most / 1e6

    assert peak(phrases._counted_pairs(iter(batches), full)) < 12
    assert peak(phrases._counted_grams(iter(batches), full, full, code)) < 35


def test_long_texts_are_taken_apart_bit_by_bit(make, monkeypatch):
    monkeypatch.setattr(phrases, "_READ", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "fr", "en", "en", "en"]), pa.array(["a" * 30, "b" * 30, "c" * 40, "d" * 20, ""])], names=["lang", "text"])
    assert list(phrases._by_language(batch)) == [("en", [b"a" * 30]), ("fr", [b"b" * 30]), ("en", [b"c" * 40, b"d" * 20]), ("en", [b""])]
    monkeypatch.setattr(phrases, "_ROWS", 3)
    texts = ["a b c a b d e a b. f g h i j k l"] * 8
    assert found(make(texts), 5, 10) == brute(texts, ["en"] * 8, 5, 10)


def test_a_task_reads_several_splits(make, monkeypatch):
    tasks, flows = [], phrases._flows
    monkeypatch.setattr(phrases, "_flows", lambda grams, least: tasks.append(grams.rdd.getNumPartitions()) or flows(grams, least))
    phrases.graph(make(["a b c d e f"] * 300).repartition(100), 5)
    assert tasks == [25]


def test_scores_beyond_64_bits(spark):
    one = spark.sql("SELECT CAST(9e12 AS BIGINT) a, CAST(9e15 AS BIGINT) n, CAST(9e12 AS BIGINT) + 1 l, CAST(9e13 AS BIGINT) + 7 r")
    got = one.select(phrases._score(one.a, one.n, one.l, one.r)).first()[0]
    assert got == 1000 * 9 * 10**12 * 9 * 10**15 // ((9 * 10**12 + 1) * (9 * 10**13 + 7))


def test_a_full_bitmap_only_costs_work(make, monkeypatch):
    import numpy as np

    texts = ["a b c a b d e a b"] * 8
    want = found(make(texts), 5, 10)
    monkeypatch.setattr(phrases, "_bitmap", lambda *_: np.full(1 << (phrases._BITS - 6), 2**64 - 1, np.uint64))
    assert found(make(texts), 5, 10) == want == brute(texts, ["en"] * 8, 5, 10)


def test_no_rows(make):
    assert phrases.collocations(make([])).count() == 0
    assert phrases.collocations(make([None, ""])).count() == 0
