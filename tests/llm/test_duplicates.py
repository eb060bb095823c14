from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from areal_exposure.llm import near_copies, shingles
from texts import words


UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"


def brute_sets(texts):
    """Words are runs of letters, marks and numbers; characters of scripts without blanks are words each."""
    out = []
    for t in texts:
        w = regex.findall(rf"{UNSPACED}\p{{M}}*|(?:(?!{UNSPACED})[\p{{L}}\p{{M}}\p{{N}}])+", (t or "").lower())
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_classes(texts, least=0.8):
    sets, label = brute_sets(texts), list(range(len(texts)))

    def head(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        same = (texts[a] or "") == (texts[b] or "")
        if same or (sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least):
            x, y = sorted((head(a), head(b)))
            label[y] = x
    return [head(k) for k in range(len(texts))]


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


def test_shingles_equal_python_sets(odd_texts):
    texts = odd_texts + ["“one”\u00a0two—three four… five’s sixth", "私は東京に住んでいます。犬が好きです。", "ภาษาไทย x", "Cafe\u0301 é"]
    found = shingles.sets(pa.array([(t or "").lower() for t in texts]))
    assert [len(x) for x in found] == [len(x) for x in brute_sets(texts)]


def test_jaccard_is_exact():
    rng = random.Random(2)
    one = [words(rng, 120) for _ in range(20)]
    two = [edited(rng, t, k % 6) for k, t in enumerate(one)]
    want = [len(a & b) / len(a | b) for a, b in zip(brute_sets(one), brute_sets(two), strict=True)]
    assert np.allclose(shingles.jaccard(pa.array(one), pa.array(two)), want)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    equal = []
    for _ in range(60):
        common, own = rng.integers(0, 2**52, 80, dtype=np.uint64), rng.integers(0, 2**52, (2, 20), dtype=np.uint64)
        elements = np.concatenate([common, own[0], common, own[1]])
        home = np.repeat([0, 1], 100)
        kept = near_copies.signatures(home, elements, np.ones(200), 2)
        equal.append((kept[0] == kept[1]).mean())
    assert abs(np.mean(equal) - 80 / 120) < 0.03


def test_classes_equal_brute_force(make, odd_texts):
    rng = random.Random(4)
    base = [words(rng, 150) for _ in range(12)]
    # Around 0.8: members that are alike to the base but not to each other, and copies.
    texts = base + [edited(rng, b, e) for b in base for e in (1, 2, 3, 3, 4, 5)] + base[:3] * 4 + odd_texts
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[k] for k in order]
    found = {r["doc_id"]: r["class_id"] for r in near_copies.near_copies(make(texts)).collect()}
    assert [found[k] for k in range(len(texts))] == brute_classes(texts)


@pytest.mark.parametrize("block", [1_000, 1 << 19])
def test_group_around_the_threshold_in_blocks(make, monkeypatch, block):
    """Many texts of one origin, most pairs of which are just below 0.8: all meet in blocks, no class may change."""
    monkeypatch.setattr(near_copies, "_BLOCK", block)
    rng = random.Random(11)
    origin = words(rng, 150)
    texts = [edited(rng, origin, 3 + k % 4) for k in range(150)]
    found = {r["doc_id"]: r["class_id"] for r in near_copies.near_copies(make(texts)).collect()}
    assert [found[k] for k in range(len(texts))] == brute_classes(texts)


def test_blocks_give_a_forest_of_true_links():
    rng = random.Random(12)
    origin = words(rng, 150)
    texts = [edited(rng, origin, 1 + k % 3) for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["doc_id", "text"])
    (signed,), (held,) = near_copies.signature_rows(iter([batch])), near_copies.digest_rows(iter([batch]))
    members = [{**a, **b, "label": a["doc_id"]} for a, b in zip(signed.to_pylist(), held.to_pylist(), strict=True)]
    found = [x for band in range(near_copies.BANDS) for x in near_copies._forest(members, members, band, 0.8)]
    own = brute_sets(texts)
    assert all(len(own[x["a"]] & own[x["b"]]) / len(own[x["a"]] | own[x["b"]]) >= 0.8 for x in found)
    assert len({(x["a"], x["b"]) for x in found}) == len(found)
    assert all(len(near_copies._forest(members, members, band, 0.8)) < 60 for band in range(3))


def test_texts_are_dealt_out_only_where_a_pair_needs_them(make, spark):
    """Else each of the steps shuffles the whole input, which took more disk than the pipeline has."""
    rng = random.Random(13)
    docs = make([words(rng, 60) for _ in range(40)])

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    kept = plan(near_copies.one_of_each(docs))
    assert "BroadcastHashJoin" in kept and "SortMergeJoin" not in kept
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    assert plan(near_copies.verified(pairs, docs, 0.8)).count("LeftSemi") == 2


def test_plans_stay_small(make, monkeypatch):
    """One plan of thousands of nodes took the driver of the pipeline beyond its memory."""
    sizes, write = [], near_copies.written

    def written(df, purpose="table"):
        sizes.append(df._jdf.queryExecution().executedPlan().toString().count("\n"))
        return write(df, purpose)

    monkeypatch.setattr(near_copies, "written", written)
    near_copies.near_copies(make(["a b c d e f", "a b c d e f", None, "", "other words stand in this one"]))
    assert max(sizes) < 300


def test_components_end_when_all_are_stars(spark, monkeypatch):
    """A step more for each call, to see that nothing changes, was a third of the stage's jobs on small inputs."""
    steps, write = [], near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, *purpose: steps.append(1) or write(df, *purpose))
    for edges, most in (([(2, 1), (3, 1), (7, 5)], 1), ([], 1), ([(1, 2), (2, 3), (3, 4), (9, 4), (8, 9), (6, 5), (6, 6)], 4)):
        steps.clear()
        found = near_copies.components(spark.createDataFrame(edges, "a long, b long"))
        label = {n: n for e in edges for n in e}
        for _ in label:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert {r["node"]: r["label"] for r in found.collect()} == {n: x for n, x in label.items() if n != x}
        assert len(steps) <= most


def test_each_text_of_an_id_has_its_representative(spark):
    keys = [(5, 1, 1), (5, 1, 1), (3, 1, 1), (9, 1, 2), (5, 2, 2), (4, 2, 2), (7, 3, 3)]
    found = near_copies.representatives(spark.createDataFrame(keys, "doc_id long, k long, l long"))
    assert sorted(map(tuple, found.collect())) == [(3, 3), (4, 4), (5, 3), (5, 4), (7, 7), (9, 9)]


def test_only_members_with_a_pair_to_try_bring_their_shingles():
    rng = random.Random(14)
    origin = words(rng, 150)
    texts = [origin, edited(rng, origin, 1), *(words(rng, 150) for _ in range(20))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    (signed,) = near_copies.signature_rows(iter([batch]))
    members = [{**m, "label": m["doc_id"]} for m in signed.to_pylist()]
    tried = [near_copies._meeting(members, members, band) for band in range(near_copies.BANDS)]
    assert sorted(filter(None, tried)) == [[0, 1]]
    same = [{**m, "label": 0} for m in members]
    assert not any(near_copies._meeting(same, same, band) for band in range(near_copies.BANDS))


def test_texts_without_blanks_are_linked(make):
    text = "".join(chr(0x4E00 + 37 * k % 5000) for k in range(200))
    found = near_copies.near_copies(make([text, text[:100] + "。" + text[100:], text[:150] + "犬" + text[151:]])).collect()
    assert {r["class_id"] for r in found} == {0}


def test_one_of_each_keeps_heads_and_columns(make):
    docs = make(["a b c d e f", "a b c d e f", "other words stand in this one"], ids=[7, 3, None])
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 3), (True, None)]
    assert near_copies.near_copies(make([])).count() == 0
