"""Sharding by sampled splitters: shards of near-equal bytes, equal texts together.

Records are ordered by a hash of their text, so that equal texts are one key.  A size-weighted
sample of keys (an item is drawn when its own hash falls below its share of all bytes times the
sample size) gives quantile boundaries, which cut the key space into fine ranges of about equal
bytes; their exact bytes are then summed.  Ranges that a shard's end falls into, or that are
overfull, are cut again into equal parts of their key interval and summed again, down to single
keys where needed.  A key that alone holds more than a fraction of a shard (``heavy``) is placed
apart: whole, on the emptiest shard, while it is no larger than a shard; a larger one is cut into
parts by a hash of the records' ids, and the parts go to as few shards as can take them.  The other keys fill up what is left of each shard, in key order.

The driver gets only bounded things: the sample, sums of ranges (``ranges`` a round), heavy keys, of
which there are at most shards / heavy, and sums of the parts of keys larger than a shard, of which
there are fewer than shards.  Records are moved once, for the slots, without
their texts, in parts that are small whatever a key holds.  DataFrame functions only.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh
from .storage import persisted

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Plan:
    """cuts[i]: the first key of shard i + 1 among the light keys; heavy: key -> shard, or the shard of each of its parts."""

    shards: int
    cuts: list[int]
    heavy: dict[int, list[int]]


def _range_of(key: Column, bounds: list[int], low: int = 0, high: int | None = None) -> Column:
    """How many bounds are at most key: a balanced tree of comparisons."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key < F.lit(bounds[mid]), _range_of(key, bounds, low, mid)).otherwise(_range_of(key, bounds, mid + 1, high))


def _sums(keys: DataFrame, bounds: list[int]) -> list[int]:
    """Bytes in each of the len(bounds) + 1 ranges between bounds."""
    array = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<long>")
    # a sorted literal array is searched in the JVM; width of the answer is bounded by the bounds
    at = F.when(F.lit(not bounds), F.lit(0)).otherwise(_range_of(F.col("key"), bounds)) if len(bounds) <= 64 else F.size(F.filter(array, lambda b: b <= F.col("key")))
    out = [0] * (len(bounds) + 1)
    for r in keys.groupBy(at.alias("r")).agg(F.sum("bytes").alias("b")).collect():
        out[r.r] = int(r.b)
    return out


PARTS = 1024


def _part(ident: Column) -> Column:
    return F.pmod(F.xxhash64(ident, F.lit(3)), F.lit(PARTS)).cast("int")


def plan_shards(rows: DataFrame, shards: int, *, ranges: int = 512, sample: int = 8192, heavy: float = 0.01, tolerance: float = 0.001, seed: int = 7) -> Plan:
    """rows: doc_id, key and size of each record."""
    keys = persisted(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-keys")
    total = int(keys.agg(F.sum("bytes")).first()[0] or 0)
    if not total:
        return Plan(shards, [_HIGH] * (shards - 1), {})
    fair = total / shards
    load, placed = [0.0] * shards, {}
    large = sorted(keys.filter(F.col("bytes") > F.lit(heavy * fair)).select("key", "bytes").collect(), key=lambda r: (-r.bytes, r.key))
    beyond = [r.key for r in large if r.bytes > fair]
    sums = rows.filter(F.col("key").isin(beyond)).groupBy("key", _part(F.col("doc_id")).alias("part")).agg(F.sum("size").alias("b")).collect() if beyond else []
    for r in large:
        emptiest = sorted(range(shards), key=lambda s: (load[s], s))
        if r.bytes <= fair:
            placed[r.key] = emptiest[:1]
            load[emptiest[0]] += r.bytes
            continue
        among = emptiest[: int(-(-r.bytes // fair))]
        placed[r.key] = [among[0]] * PARTS
        for x in sorted((x for x in sums if x.key == r.key), key=lambda x: (-x.b, x.part)):
            s = min(among, key=lambda s: (load[s], s))
            placed[r.key][x.part] = s
            load[s] += x.b
    light = keys.filter(F.col("bytes") <= F.lit(heavy * fair))
    rest = total - sum(load)
    # what each shard still takes: heavy keys may have left some above the fair share
    level = fair
    room = [max(0.0, level - x) for x in load]
    room = [x * rest / sum(room) for x in room] if sum(room) else [rest / shards] * shards
    ends, run = [], 0.0
    for x in room[:-1]:
        run += x
        ends.append(run)
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) < F.col("bytes") * F.lit(sample * (1 << 40) / max(1.0, rest))
    drawn = sorted(r.key for r in light.filter(draw).select("key").collect())
    bounds = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
    cuts: dict[int, int] = {}
    spans = [(_LOW, _HIGH + 1, 0.0, list(range(shards - 1)))]  # key interval, bytes before it, shard ends inside it
    while spans:
        edges = sorted({b for b in bounds} | {x for low, high, _, _ in spans for x in (low, high) if _LOW < x <= _HIGH})
        sums = _sums(light, edges)
        before = [0.0]
        for s in sums:
            before.append(before[-1] + s)
        following, bounds = [], []
        for _, _, _, inside in spans:
            for e in inside:
                k = min(bisect.bisect_right(before, ends[e]) - 1, len(sums) - 1)
                low = edges[k - 1] if k else _LOW
                high = edges[k] if k < len(edges) else _HIGH + 1
                near_low, near_high = ends[e] - before[k], before[k + 1] - ends[e]
                if min(near_low, near_high) <= tolerance * fair or high - low <= 1:
                    cuts[e] = low if near_low <= near_high else high
                else:
                    following.append((low, high, before[k], [e]))
        parts = max(2, ranges // max(1, len(following)))
        for low, high, _, _ in following:
            bounds += [low + (high - low) * i // parts for i in range(1, parts)]
        spans = following
    ordered, last = [], _LOW
    for e in range(shards - 1):
        last = max(last, cuts[e])
        ordered.append(min(last, _HIGH))
    return Plan(shards, ordered, placed)


def _placed(rows: DataFrame, plan: Plan, key: str, ident: str, into: str) -> DataFrame:
    """rows with their shard."""
    shard = _range_of(F.col(key), plan.cuts)
    if not plan.heavy:
        return rows.withColumn(into, shard.cast("int"))
    other, among = fresh("_heavy", [*rows.columns, into]), fresh("_among", [*rows.columns, into])
    heavy = rows.sparkSession.createDataFrame(list(plan.heavy.items()), f"{other} long, {among} array<int>")
    joined = rows.join(F.broadcast(heavy), F.col(key) == F.col(other), "left")  # at most shards / heavy rows
    own = F.when(F.size(among) == 1, F.get(among, F.lit(0))).otherwise(F.get(among, _part(F.col(ident))))
    return joined.withColumn(into, F.when(F.col(among).isNotNull(), own).otherwise(shard).cast("int")).drop(other, among)


def assign_shards(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", parts: int = 64, **options) -> DataFrame:
    """One row for each row of docs: doc_id, size (UTF-8 bytes plus 1), text_crc32 (unsigned), shard, slot (gapless from 0 in each shard).

    A null text counts as empty.  Equal texts share a shard unless together they are larger than
    one.  Slots follow a hash of the id, then the text's hash, then the id; rows that agree in both
    are interchangeable.  A null id is an id like others.  No rows: no rows.  ``parts``: into how
    many parts each shard is dealt to number its slots; a part of ten million rows or fewer sorts
    in one task, so raise it beyond ten billion rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = persisted(rows, "shard-rows")
    placed = _placed(rows, plan_shards(rows, shards, **options), "key", "doc_id", "shard")
    placed = placed.select("doc_id", "size", "text_crc32", "key", "shard", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(parts)).cast("int").alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "part", offset.alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "doc_id", "text_crc32"))
    numbered = placed.withColumn("place", place)
    out = numbered.join(offsets, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", files: int = 8, **options) -> None:
    """Writes docs below path as shard=0, shard=1 and so on, each in up to ``files`` files (more for more data), without a task holding a shard."""
    name, spread = fresh("shard", docs.columns), fresh("_spread", docs.columns)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key, ident = fresh("_key", docs.columns), fresh("_id", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64(text)).withColumn(ident, F.col(id_col).cast("long"))
    sizes = persisted(keyed.select(F.col(ident).alias("doc_id"), F.col(key).alias("key"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size")), "shard-rows")
    placed = _placed(keyed, plan_shards(sizes, shards, **options), key, ident, name).withColumn(spread, F.pmod(F.xxhash64(ident), F.lit(files)))
    placed.drop(key, ident).repartition(shards * files, name, spread).drop(spread).write.partitionBy(name).parquet(path)
