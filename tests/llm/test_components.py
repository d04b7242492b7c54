"""Few links are joined up in one task, many in steps; both give the same."""

import random

from codeloom import storage
from codeloom.llm import components as cc


def test_few_and_many_links(spark, monkeypatch):
    r = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 140)]
    links = [(r.randrange(-60, 60), r.randrange(-60, 60)) for _ in range(50)] + chain + [(7, 7)] + [(1 << 40, -(1 << 40))]
    least = {x: x for p in links if p[0] != p[1] for x in p}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(r.sample(links, len(links)), "a long, b long")
    made = len(storage._MADE)
    assert sorted(map(tuple, cc.components(df).collect())) == sorted(least.items())
    assert len(storage._MADE) - made == 2
    assert cc.components(df.filter("a = b")).count() == 0
    monkeypatch.setattr(cc, "FEW", 5)
    assert sorted(map(tuple, cc.components(df).collect())) == sorted(least.items())
