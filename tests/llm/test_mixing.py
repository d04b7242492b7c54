"""Source mixing: targets by plain water-filling, fits by brute force and by bounds."""

import random

import numpy as np
import pytest
from brute import sample_docs, words
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import mixing
from codeloom.llm.mixing import fit_budget, mix_sources, mixed_documents


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 4), min_size=1, max_size=6), st.integers(0, 120), st.sampled_from([0, 5, 1 << 16]))
def test_fit_budget(histogram, budget, left):
    was, mixing.KNAPSACK_WORDS = mixing.KNAPSACK_WORDS, left
    try:
        sizes, counts = np.array(list(histogram)), np.array(list(histogram.values()))
        taken = fit_budget(sizes, counts, budget)
    finally:
        mixing.KNAPSACK_WORDS = was
    total = int((taken * sizes).sum())
    assert ((taken >= 0) & (taken <= counts)).all() and total <= budget
    if budget >= (sizes * counts).sum():
        assert (taken == counts).all()
    elif left == 1 << 16:
        # no remaining document fits in what is left
        assert all(budget - total < s for s, c, t in zip(sizes, counts, taken, strict=True) if t < c)


def test_fit_reaches_the_budget_where_sizes_allow():
    r = np.random.default_rng(1)
    sizes = np.arange(1, 3000)
    counts = r.integers(0, 30, len(sizes))
    for share in (0.01, 0.37, 0.99):
        budget = int(share * (sizes * counts).sum())
        assert (fit_budget(sizes, counts, budget) * sizes).sum() == budget


def water(sizes, weights, share, most):
    """Targets by resharing the excess until none is above its cap."""
    total, target = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] >= 0]
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w >= most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = most * sizes[i]
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(make_docs, seed):
    r = random.Random(seed)
    names = ["b", "a", "é", "Z", "z", None, "", "empty"]
    docs = [(d, t, r.choice(names[:5] if r.random() < 0.4 else names[:-1])) for d, t in sample_docs(n=200, seed=seed)]
    docs += [(5000, None, "empty"), (5001, " ", "empty")] + [(6000 + i, "same words here", "a") for i in range(150)]
    df = make_docs(docs)
    got = mix_sources(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(df.repartition(7)).collect()), key=str)
    assert len(got) == len(docs)
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len(words(t)) for _, t, q in docs if q == s) for s in sources]
    targets = dict(zip(sources, water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], 1.5, 2), strict=True))
    by_source = {}
    for x in got:
        assert x.source_size == sizes[sources.index(x.source)] and abs(x.target - targets[x.source]) < 1e-6 * max(1, x.target)
        assert x.taken == x.copies * x.size and x.copies in (0, 1, 2)
        by_source.setdefault(x.source, []).append(x)
    for s, rows in by_source.items():
        taken = sum(x.taken for x in rows)
        assert targets[s] - max(x.size for x in rows) - 1 <= taken <= targets[s] + 1
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(x.copies for x in got)
    taken = {}
    for x in got:
        key = (x.doc_id, x.source)
        taken[key] = taken.get(key, 0) + x.copies
    for x in mixed.groupBy("doc_id", "source").count().collect():
        assert taken[(x.doc_id, x.source)] == x["count"]


def test_mix_of_nothing(make_docs):
    assert mix_sources(make_docs([])).count() == 0 and mixed_documents(make_docs([])).count() == 0
    only = mix_sources(make_docs([(1, None), (2, "")])).collect()
    assert {(x.doc_id, x.taken, x.target) for x in only} == {(1, 0, 0.0), (2, 0, 0.0)}
