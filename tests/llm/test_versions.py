from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from areal_exposure.llm import versions
from texts import words


def paragraphs(text):
    return Counter(re.findall(r"[^\n.!?]{1,64}[\n.!? \t\r\f\v]*|[\n.!? \t\r\f\v]+", text))


def likeness(a, b):
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 1.0


def check(docs, texts, ids, **how):
    rows = sorted(versions.fingerprints(docs, **how).collect(), key=lambda r: (r["doc_id"], r["n_chars"]))
    known = sorted((i, t or "") for i, t in zip(ids, texts, strict=True))
    assert len(rows) == len(known)
    prints = {}
    for k, (i, text) in enumerate(known):
        following = known[(k + 1) % len(known)][1]
        quarter = len(text) // 4
        new = text[: len(text) - quarter] + following[:quarter]
        row = next(r for r in rows if r["doc_id"] == i and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest())
        assert row["n_chars"] == len(text)
        assert abs(row["near_edited"] - likeness(paragraphs(text), paragraphs(new))) < 1e-9
        assert abs(row["near_next"] - likeness(paragraphs(text), paragraphs(following))) < 1e-9
        for t, p in ((text, row["fingerprint"]), (new, row["edited_fingerprint"])):
            assert prints.setdefault(t, p) == p
    assert len(set(prints.values())) == len(prints)


def test_fingerprints(make, odd_texts):
    rng = random.Random(8)
    texts = ["\n".join(words(rng, 9) + "." for _ in range(rng.randint(1, 60))) for _ in range(40)] + odd_texts
    ids = rng.sample(range(-50, 10**9), len(texts))
    check(make(texts, ids), texts, ids)


def test_larger_tables_are_tried_when_cells_remain(make):
    rng = random.Random(9)
    texts = ["\n".join(words(rng, 5) for _ in range(150)) for _ in range(4)]
    check(make(texts), texts, range(4), factor=0.3)


def test_few_rows(make):
    assert versions.fingerprints(make([])).count() == 0
    check(make(["alone. here"]), ["alone. here"], [0])
    check(make(["b.", "a."], ids=[5, 5]), ["b.", "a."], [5, 5])
    assert versions.fingerprints(make(["x", "y"], ids=[None, 2])).where(F.col("doc_id").isNull()).count() == 1


def test_texts_are_dealt_out_once(spark):
    docs = spark.createDataFrame([(k, f"text {k}. more of it {k % 3}. end") for k in range(50)], "doc_id long, text string")
    found = versions._told(docs, 1.7)
    assert found.count() == 50
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"(?<!Reused)Exchange .*REPARTITION_BY_NUM", plan)) - len(re.findall(r"ReusedExchange .*REPARTITION_BY_NUM", plan)) == 1
