"""Connected components by alternating large-star and small-star steps, each written to the shared folder; of few links at once, in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import persisted

#: Most links that one task joins up (about 80 bytes a link).
FEW = 1 << 20


def joined_up(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id of the links, and the least id that it reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(ids))
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    return ids, ids[least]


def _of_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if columns:
        ids, least = joined_up(*(np.concatenate(c) for c in zip(*columns, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], names=["v", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """From links between long ids: v, component (the smallest id that v reaches), for every id that has a link to another one.

    Hubs are harmless: each step joins a node's links with the least of them, which is summed up
    before the shuffle.  Nothing but two sums of each step's links goes to the driver.  No more than
    FEW links go to one task instead: the steps' many shuffles would cost more than the links.
    """
    edges = persisted(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links")
    if edges.count() <= FEW:
        return persisted(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_of_one_task, "v long, component long"), "components")
    before = None
    while True:
        # large star: each node's larger neighbours go to the least of the node and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = persisted(large, "large-star")
        # small star: each node and its smaller neighbours go to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = persisted(small.filter("u > v").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("v"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", F.col("v").alias("component"))).distinct()
