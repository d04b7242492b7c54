"""Hamming joins of words that aren't random: both ways of finding pairs, and nothing large on the driver."""

import random

import numpy as np
import pytest

from codeloom.operators import similarity


def _apart(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


@pytest.fixture(scope="module")
def words():
    """Words of one cluster, most of them within a few bits of others; signed, distinct."""
    r, out = random.Random(5), set()
    centre = r.getrandbits(64)
    while len(out) < 400:
        w = centre
        for _ in range(r.randrange(0, 12)):
            w ^= 1 << r.randrange(64)
        out.add(w - (1 << 64) if w >> 63 else w)
    return sorted(out)


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("top,itself", [(2, False), (3, True)])
def test_nearest_words_compared_in_blocks(spark, words, monkeypatch, top, itself):
    monkeypatch.setattr(similarity, "BLOCK", (40, 40))
    monkeypatch.setattr(similarity, "TILE", 100)
    asked = words[::3]
    table = lambda some: spark.createDataFrame([(w,) for w in [*some, None, some[0]]], "w long")
    near = similarity.nearest_words(table(asked), "w", table(words), "w", 12, top, itself)
    assert "MapInArrow" in _plan(near) and "Broadcast" not in _plan(near)
    expected = set()
    for a in asked:
        best = sorted((_apart(a, b), b) for b in words if (itself or a != b) and _apart(a, b) <= 12)[:top]
        expected |= {(a, b, d, i + 1) for i, (d, b) in enumerate(best)}
    got = [(x.a, x.b, x.distance, x["rank"]) for x in near.collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_a_block_gives_top_words_for_a_query(words):
    x = np.array(words, np.int64)
    a = np.concatenate([a for a, _, _ in similarity._nearest_within(x, x, 12, 2, False)])
    assert np.unique(a, return_counts=True)[1].max() == 2


def test_similar_rows_broadcasts_nothing(spark, words):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words + words[:7])], "i int, w long")
    near = similarity.similar_rows(df, "i", "w", 3)
    assert "Broadcast" not in _plan(near)
    rows = {x.i: (x.copies, x.near, x.nearest) for x in near.collect()}
    every = words + words[:7]
    for i, w in enumerate(every):
        apart = [_apart(v, w) for v in every if v != w and _apart(v, w) <= 3]
        copies = every.count(w) - 1
        assert rows.get(i) == ((copies, len(apart), min(apart, default=None)) if copies or apart else None)


def test_similar_words_of_a_cluster_compared_in_blocks(spark, words, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", (40, 40))
    monkeypatch.setattr(similarity, "TILE", 100)
    df = spark.createDataFrame([(w,) for w in [*words, None, words[0]]], "w long")
    near = similarity.similar_words(df, "w", 6)
    assert "MapInArrow" in _plan(near) and "Broadcast" not in _plan(near)
    got = [tuple(x) for x in near.collect()]
    expected = {(a, b, _apart(a, b)) for a in words for b in words if a < b and _apart(a, b) <= 6}
    assert len(got) == len(expected) and set(got) == expected
    some = df.filter("w % 3 = 0")
    got = [tuple(x) for x in similarity.similar_words(some, "w", 6, df, "w").collect()]
    expected = {(a, b, _apart(a, b)) for a in words if a % 3 == 0 for b in words if _apart(a, b) <= 6}
    assert len(got) == len(expected) and set(got) == expected
    bands = similarity.similar_words(df, "w", 6, bands=similarity.plan(6, len(words)))
    assert "Broadcast" not in _plan(bands) and bands.count() == near.count()
    assert similarity.similar_words(df.filter("w is null"), "w", 6).count() == 0
