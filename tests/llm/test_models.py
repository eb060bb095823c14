from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from areal_exposure.llm import language, quality
from texts import words

LETTERS = {"xx": "abcdé", "yy": "fghiü"}


def labelled(make, n=60):
    rng = random.Random(10)
    langs = [("xx", "yy")[k % 2] for k in range(n)]
    return make([words(rng, 40, LETTERS[x]) for x in langs], langs=langs)


def brute_bits(model, counts, lang, text):
    """Code length by going down the orders one byte at a time."""
    data, total = text.encode(), 0.0
    past = bytes([10] * language.ORDER) + data
    for i, b in enumerate(data):
        bits = 8.0
        for order in range(language.ORDER + 1):
            context = past[i + language.ORDER - order : i + language.ORDER]
            follow = counts.get((lang, context), {})
            n, kinds = sum(follow.values()), len(follow)
            if b in follow:
                bits = -math.log2(follow[b] / (n + kinds))
            elif n:
                bits -= math.log2(kinds / (n + kinds))
        total += bits
    return total


def test_code_lengths_equal_the_trees(make):
    docs = labelled(make)
    model = language.train(docs, per_language=1000)
    counts: dict = {}
    rows = language.context_counts(docs.select("lang", "text")).where((F.col("ord") < 2) | (F.col("n") >= 2)).collect()
    for r in rows:
        gram = r["gram"].to_bytes(4, "big")[3 - r["ord"] :]
        counts.setdefault((r["lang"], gram[:-1]), {})[gram[-1]] = r["n"]
    texts = ["abc fgh", "dé éa", "zz top ü", "", "a" * 50, "b\nfi 日"]
    bits, size = language.code_lengths(model, pa.array(texts))
    assert size.tolist() == [len(t.encode()) for t in texts]
    want = [[brute_bits(model, counts, x, t) for x in model.languages] for t in texts]
    assert np.allclose(bits, want, rtol=1e-4, atol=1e-3)


def test_code_lengths_over_slices(make, monkeypatch):
    model = language.train(labelled(make))
    texts = pa.array([None, "abc " * 40, "", "fgh " * 90, "a"])
    whole, _ = language.code_lengths(model, texts)
    monkeypatch.setattr(language, "_SLICE", 7)
    assert np.allclose(language.code_lengths(model, texts)[0], whole, rtol=1e-5)


def test_languages_of_held_out_and_odd_texts(make, odd_texts):
    docs = labelled(make, 120)
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model).join(docs, "doc_id").where(language.held_out(F.col("doc_id")))
    assert found.count() > 10 and found.where("lang_pred <> lang").count() == 0
    odd = {r["doc_id"]: r for r in language.identify(make(odd_texts), model).collect()}
    assert len(odd) == len(odd_texts)
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["score"] == 0 for k in range(4))
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    unlettered = language.identify(make(["² ½ 12", "① Ⅷ", "日", "ª"]), model).collect()
    assert [r["lang_pred"] == "und" for r in sorted(unlettered, key=lambda r: r["doc_id"])] == [True, True, False, False]
    kept = language.accepted(make(["abc dab é", None, "12"]), model)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [0]


def test_no_labels(make):
    model = language.train(make([]))
    assert [r["lang_pred"] for r in language.identify(make(["abc"]), model).collect()] == ["und"]
    assert language.identify(make([]), model).count() == 0


def test_co_training_tells_good_from_bad(spark, make, odd_texts):
    rng = random.Random(11)
    good = [words(rng, rng.randint(30, 90)).replace("a ", "a. ") for _ in range(300)]
    bad = [" ".join(w + "%%%" for w in words(rng, rng.randint(30, 90)).split()) for _ in range(300)]
    docs = make(good + bad)
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(0, 600, 3)] + [(None, 1), (1, None)], "doc_id long, quality int")
    judge = quality.train(docs, labels, rounds=3, each=40)
    rows = quality.score(docs, judge).collect()
    right = sum((r["quality"] > 0.5) == (r["doc_id"] < 300) for r in rows)
    assert len(rows) == 600 and right >= 590
    odd = quality.score(make(odd_texts), judge).collect()
    assert len(odd) == len(odd_texts) and all(0 <= r[c] <= 1 for r in odd for c in ("by_content", "by_metadata", "quality"))


def test_the_surest_of_all_rows(spark, make):
    """Against sorting the odds of every row in numpy; a source with one row in 300 teaches too, copies count once."""
    rng = random.Random(12)
    texts = [words(rng, rng.randint(5, 60)) for _ in range(299)] + ["%%% !!! ### " * 30] + ["same text here"] * 40
    docs = make(texts)
    pool = quality.unlabelled(docs, spark.createDataFrame([(0,), (1,)], "doc_id long"))
    rows = sorted(pool.collect(), key=lambda r: r["key"])
    assert len(rows) == len({tuple(r["content"] + r["metadata"]) for r in rows}) == 297 + 1 + 3  # the same text of three sources
    x = [np.array([r[k] for r in rows], dtype=float) for k in ("content", "metadata")]
    views = [quality.fit_view(v, (np.arange(len(v)) % 3 == 0).astype(float)) for v in x]
    for view in views:
        view.weights *= 20  # so that some rows are sure and some are not
    find, free = quality.surest_of(pool), np.ones(len(rows), dtype=bool)
    for _ in range(3):
        got, used = find(views, 7, 11), []
        for teacher, pupil in ((0, 1), (1, 0)):
            odds = views[teacher].odds(x[teacher])
            order = sorted(np.flatnonzero(free), key=lambda k: (-odds[k], k))
            high = [k for k in order if odds[k] >= math.log(9)][:7]
            order = sorted(np.flatnonzero(free), key=lambda k: (odds[k], k))
            low = [k for k in order if odds[k] <= -math.log(9)][:11]
            want = sorted([(k, 1.0) for k in high] + [(k, 0.0) for k in low])
            assert want and got[teacher][1].tolist() == [told for _, told in want]
            assert np.allclose(got[teacher][0], x[pupil][[k for k, _ in want]])
            used += high + low
        free[used] = False
    empty = quality.surest_of(quality.unlabelled(make([]), spark.createDataFrame([], "doc_id long")))
    assert [len(told) for _, told in empty(views, 7, 11)] == [0, 0]


def test_quality_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int")
    judge = quality.train(make(["a b"]), none)
    assert judge is None
    assert [r["quality"] for r in quality.score(make(["a b", None]), judge).collect()] == [0.5, 0.5]
    assert quality.score(make([]), judge).count() == 0
