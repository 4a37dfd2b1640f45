"""Near copies of the pipeline's stage against exact Jaccard similarity of all pairs."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from docstruct.llm import neardup, simhash


@pytest.mark.parametrize("block", [1000, 3])
def test_near_copies_beyond_two_bits_go_and_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(6))
    base = [word() for _ in range(150)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = word()
        return " ".join(words)

    texts = [" ".join(base), edited(base, 3)] + [edited(base, rng.randrange(1, 9)) for _ in range(60)]
    for _ in range(15):
        other = [word() for _ in range(80)]
        texts += [" ".join(other), " ".join(other).upper() + "\n", edited(other, 1), edited(other, 6)]
    texts += ["", None, " \n", "two words", "Two  words", "two words more"]
    first, second = (simhash.simhash(t.encode(), 3) for t in texts[:2])
    assert (first ^ second).bit_count() > simhash.RADIUS
    sets = [np.unique(simhash.shingles((t or "").encode(), 5)) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if not len(sets[a]) and not len(sets[b]) or len(sets[a]) and len(sets[b]) and neardup.similarity(sets[a], sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted({find(i) for i in range(len(texts))}) and kept.count(None) == 1
    assert 0 in kept and 1 not in kept
    other = " ".join(word() for _ in range(40))
    repeated = spark.createDataFrame([(1, "a " * 30, "en", "s", None), (5, "a " * 30, "en", "s", None), (5, other, "en", "s", None), (5, other, "en", "s", None)], docs.schema)
    assert sorted((r.doc_id, r.text == other) for r in corpus_pipeline.near_dedup(spark, repeated, "").collect()) == [(1, False), (5, True)]
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


@pytest.mark.parametrize("n", [300, 1500, 5000, 60_000])
def test_bitmaps_rule_out_unlike_sets_of_any_length_and_no_like_ones(spark, n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)

    def changed(m):
        return np.unique(np.concatenate([base[m:], rng.integers(0, 1 << 63, m, np.uint64)]))

    like, unlike = [np.unique(base), changed(n // 10), changed(n // 12)], [changed(n * 18 // 100), changed(n * 3 // 10)]
    rows = [(str(i).encode(), x.tobytes(), len(x)) for i, x in enumerate([*like, *unlike])]
    sets = spark.createDataFrame(rows, "same binary, set binary, n int")
    left = neardup.bitmaps(sets).join(sets.drop("set"), "same")
    right = left.select(*(left[c].alias(f"_{c}") for c in left.columns))
    coarse, fine = neardup.differing()
    found = left.crossJoin(right).where("same < _same").select("same", "_same", ((coarse <= (left.n + right._n) / 9 + 1e-6) & (fine <= (left.n + right._n) / 9 + 1e-6)).alias("ok"))
    for a, b, ok in found.collect():
        x, y = (np.frombuffer(rows[int(v)][1], np.uint64) for v in (a, b))
        if neardup.similarity(x, y) >= 0.8:
            assert ok
        elif neardup.similarity(x, y) < 0.71:
            assert not ok, (a, b)
