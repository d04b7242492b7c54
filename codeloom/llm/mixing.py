"""Mixing sources to target weights by subset-sum budget fitting.

Sources get budgets of words by weight (water-filling under a cap of a multiple of their size).  A
source's documents are taken as often as whole passes fit in its budget; the remaining budget is
fitted from the histogram of exact document lengths: a proportional share of each length, then a
bounded knapsack by dynamic programming over what is left.  That gives a number of documents for
each length; which documents, a seeded hash of id and text decides.  Documents are counted and
ranked in hash buckets of each (source, length), so that no task ever ranks a whole hot group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..naming import exactly
from .common import fresh
from .storage import persisted

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 256
#: Words of a budget that are left to the dynamic programming; its table has about this many cells.
KNAPSACK_WORDS = 1 << 16


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, at most counts, so that their sizes add up to budget or just less.

    sizes must be positive and differ.  budget at or above the total takes all.
    """
    sizes, counts = [int(x) for x in sizes], [int(x) for x in counts]
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget >= total:
        return np.array(counts, dtype=np.int64)
    taken = [c * budget // total for c in counts]
    left = budget - sum(s * n for s, n in zip(sizes, taken, strict=True))
    for k in sorted(range(len(sizes)), key=lambda k: (-(counts[k] * budget % total), sizes[k])):
        if taken[k] < counts[k] and left - sizes[k] >= KNAPSACK_WORDS:
            taken[k] += 1
            left -= sizes[k]
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        more = min(counts[k] - taken[k], max(0, left - KNAPSACK_WORDS) // sizes[k])
        taken[k] += more
        left -= more * sizes[k]
    # bounded knapsack: reached[s] holds the item by which sum s was first reached
    reached = np.full(left + 1, -1, dtype=np.int64)
    reached[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        spare, part = min(counts[k] - taken[k], left // sizes[k]), 1
        while spare > 0 and reached[left] < 0:
            n = min(part, spare)
            step = n * sizes[k]
            items.append((k, n))
            new = (reached[:-step] >= 0) & (reached[step:] < 0)
            reached[step:][new] = len(items) - 1
            spare, part = spare - n, 2 * part
    at = int(np.flatnonzero(reached >= 0)[-1])
    while at:
        k, n = items[reached[at]]
        taken[k] += n
        at -= n * sizes[k]
    return np.array(taken, dtype=np.int64)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """From one row for each source (key, source, source_size): weight and target.

    Sources in code point order, null last, get the weights in turn.  The sum of targets is share
    times all sizes; no target is above most times its source's size, and what it can't use goes to
    the others by weight.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    fill = Window.orderBy("ratio", "key")
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(most))
    level = (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = sizes.withColumn("weight", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("level", level)
    full = F.col("ratio") <= F.col("level")
    water = F.min_by("level", F.when(~full, F.col("ratio"))).over(Window.partitionBy())
    return leveled.withColumn("water", water).withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("water") * F.col("weight"))).select("key", "source", "source_size", "weight", "target")


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    target, total = float(group["target"].iloc[0]), int(group["source_size"].iloc[0])
    passes = min(int(target // total), int(group["most"].iloc[0])) if total else 0
    rest = max(0, round(target) - passes * total)
    extra = np.zeros(len(group), dtype=np.int64)
    full = (group["size"] > 0).to_numpy()
    if rest and full.any():
        extra[full] = fit_budget(group["size"].to_numpy()[full], group["n"].to_numpy()[full], rest)
    return pd.DataFrame({"key": group["key"], "size": group["size"], "source_size": group["source_size"], "target": group["target"], "passes": passes, "extra": extra})


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    text = F.coalesce(exactly(text_col).cast("string"), F.lit(""))
    return [
        exactly(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), exactly(source_col)), F.lit("n")).alias("key"),
        exactly(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), exactly(id_col).cast("long"), exactly(text_col).isNull(), text).alias("h"),
    ]


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 20240607) -> DataFrame:
    """One row for each document: doc_id, source, size (words), source_size, target, copies (how often the mix takes it), taken (copies * size), h (its seeded hash).

    Null and empty texts have size 0 and are taken as often as whole passes are; a null source is a
    source of its own.  Documents that agree in id, text and source are interchangeable; ties of the
    hash are otherwise settled by the id.  Whole passes that a budget holds take every document
    once each; so none is taken more than ``most`` times.  Very long texts count whole, as one of their
    length; ids are cast to long, and what can't be fails.  Reruns agree.  An empty table gives no rows.
    """
    rows = persisted(docs.select(*_keyed(docs, id_col, text_col, source_col, seed)).withColumn("bucket", F.pmod(F.col("h"), F.lit(BUCKETS)).cast("int")), "mix-rows")
    counts = persisted(rows.groupBy("key", "source", "size", "bucket").agg(F.count("*").alias("n")), "mix-counts")
    sources = counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources, weights, share, most).select("key", "source_size", "target", F.lit(most).alias("most"))
    lengths = counts.groupBy("key", "size").agg(F.sum("n").alias("n")).join(targets, "key")
    fitted = lengths.groupBy("key").applyInPandas(_fit, "key string, size long, source_size long, target double, passes long, extra long")
    before = F.sum("n").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    quota = counts.select("key", "size", "bucket", "n", F.coalesce(before, F.lit(0)).alias("before")).join(fitted, ["key", "size"])
    quota = quota.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before")))).drop("n", "before")
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", "doc_id"))
    placed = rows.join(quota, ["key", "size", "bucket"]).withColumn("rank", rank)
    copies = F.col("passes") + (F.col("rank") <= F.col("extra")).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "h")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows and columns, each row as many times as the mix takes it.  Options as of mix_sources."""
    id_col, text_col, source_col, seed = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"), ("seed", 20240607)))
    names = {k: fresh(f"_{k}", docs.columns) for k in ("id", "h", "key", "rank", "copies")}
    keys = dict(zip(("id", "key", "source", "size", "h"), _keyed(docs, id_col, text_col, source_col, seed), strict=True))
    taken = mix_sources(docs, **options)
    same = ["id", "h", "key"]
    w = Window.partitionBy(*(names[k] for k in same))
    left = docs.select("*", *(keys[k].alias(names[k]) for k in same)).withColumn(names["rank"], F.row_number().over(w.orderBy(F.lit(0))))
    right = taken.select(F.col("doc_id").alias(names["id"]), F.col("h").alias(names["h"]), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias(names["key"]), F.col("copies").alias(names["copies"]))
    right = right.filter(F.col(names["copies"]) > 0).withColumn(names["rank"], F.row_number().over(w.orderBy(F.desc(names["copies"]))))
    on = F.lit(True)
    r = right.toDF(*(f"{c}_r" for c in right.columns))
    for k in (*same, "rank"):
        on = on & left[names[k]].eqNullSafe(r[f"{names[k]}_r"])
    joined = left.join(r, on)
    return joined.select(*(exactly(c) for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(f"{names['copies']}_r").cast("int"))).alias(names["copies"])).drop(names["copies"])
