"""Joins by Hamming distance over 64-bit words.

A word is cut into m bands, and band i gets a radius r[i] with the sum of all r[i] + 1 above k: two
words that differ in at most k bits are within r[i] in some band (pigeonhole).  Within r[i] means that
some value within r[i] // 2 of one word's band is within the rest of r[i] of the other's; so both
words list those values (each mask of so few bits, by xor), an equi-join on band and value finds all
pairs, and the exact distance is then checked.  Few wide bands make few candidates but many values;
the plan is chosen by the estimated cost for the number of words at hand.  Equal words are one row
throughout: copies multiply neither values nor pairs.

Words that aren't random (SimHashes of one language) agree in more bands than the estimate says.  So
the share of pairs that meet is taken from a sample, and where the join would cost more than comparing
all pairs, all pairs are compared: words are packed in blocks, and a task compares two blocks in numpy.
The sample chooses the way alone; both ways find every pair.  Listed values are never broadcast: they
are many times their words, which Spark's estimate doesn't see.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import persisted

#: Most values that a word lists in one band.
MOST_MASKS = 1000
#: What a candidate costs, in listed values: it is met several times, compared and sorted out.
CANDIDATE = 32
#: What a listed value, a row of the join and a pair within k bits (found several times, then shuffled) cost, in pairs of words compared in numpy.
LISTED, MET, FOUND = 300, 30, 1200
#: Words of a sample that says how many pairs meet.
SAMPLE = 2048
#: Least and most words of a block; between them, a sixteenth of the words.
BLOCK = 1 << 11, 1 << 16
#: Pairs compared at a time.
TILE = 1 << 17


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, j) for j in range(radius + 1))


def plan(k: int, words: int) -> list[tuple[int, int, int]]:
    """Bands (lowest bit, width, radius) of the least estimated cost: values listed, and candidates among so many random words."""
    best, cost = [], float("inf")
    for m in range(1, k + 2):
        spare = k + 1 - m  # radii add up to this
        bands = [(64 * i // m, 64 * (i + 1) // m - 64 * i // m, spare // m + (i < spare % m)) for i in range(m)]
        sides = [(_ball(w, r // 2), _ball(w, r - r // 2)) for _, w, r in bands]
        if any(r > w or max(s) > MOST_MASKS for (_, w, r), s in zip(bands, sides, strict=True)):
            continue
        estimate = words * sum(map(sum, sides)) + CANDIDATE * words**2 / 2 * sum(_ball(w, r) / 2.0**w for _, w, r in bands)
        if estimate < cost:
            best, cost = bands, estimate
    return best


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for j in range(radius + 1) for bits in combinations(range(width), j)]


def _of_band(band: int, bits: Column) -> Column:
    return F.struct(F.lit(band).alias("band"), bits.alias("bits"))


def _listed(word: Column, bands: list[tuple[int, int, int]], half) -> Column:
    """Of each band the values within half(radius): band, bits."""
    out = []
    for i, (low, width, radius) in enumerate(bands):
        value = F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        masks = F.array(*(F.lit(x).cast("long") for x in _masks(width, half(radius))))
        out.append(F.transform(F.transform(masks, value.bitwiseXOR), partial(_of_band, i)))
    return F.concat(*out) if len(out) > 1 else out[0]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _compares_all(left: DataFrame, n: int, right: DataFrame, m: int, k: int, bands: list[tuple[int, int, int]]) -> bool:
    """Whether comparing all pairs costs less than the join by bands, by how many pairs of a sample meet in each band."""
    drawn = lambda df, c, rows: np.array([x[0] for x in df.filter(F.pmod(F.xxhash64(c), F.lit(-(-rows // SAMPLE))) == 0).collect()], np.int64).view(np.uint64)
    x, y = drawn(left, "a", n), drawn(right, "b", m)
    if not len(x) or not len(y):
        return False
    differ = x[:, None] ^ y
    other = differ != 0
    share = sum(((np.bitwise_count(differ & np.uint64(((1 << w) - 1) << low)) <= r) & other).mean() for low, w, r in bands)
    listed = sum(n * _ball(w, r // 2) + m * _ball(w, r - r // 2) for _, w, r in bands)
    found = ((np.bitwise_count(differ) <= k) & other).mean()
    return n * m < LISTED * listed + (MET * share + FOUND * found) * n * m


def _packed(words: DataFrame, blocks: int) -> DataFrame:
    """Words by block: block, data (some of its words, 8 bytes each)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, word = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.argsort(block, kind="stable")
            ends = np.r_[np.flatnonzero(np.diff(block[order])) + 1, len(block)] if len(block) else np.zeros(0, np.int64)
            parts = np.split(word[order], ends[:-1]) if len(ends) else []
            yield pa.RecordBatch.from_arrays([pa.array(block[order][ends - 1], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "data"])

    word = words.columns[0]
    return words.select(F.pmod(F.xxhash64(word), F.lit(blocks)).cast("int").alias("block"), word).mapInArrow(pack, "block int, data binary")


def _by_blocks(left: DataFrame, n: int, right: DataFrame | None, m: int, pairs: Callable[[np.ndarray, np.ndarray], Iterator[tuple]]) -> DataFrame:
    """pairs(x, y) of the words of every two blocks, of left and right (without right: of left, each two once): a, b, distance."""
    count = lambda rows: -(-rows // min(max(BLOCK[0], rows // 16), BLOCK[1])) or 1
    p, q, one_table = count(n), count(m), right is None
    every = lambda rows: F.sequence(F.lit(0), F.lit(rows - 1))
    cell = lambda low, high, side: F.struct(low.alias("low"), high.alias("high"), F.lit(side).alias("side"))
    block = F.col("block")
    if one_table:
        of_pair = lambda j: F.struct(F.least(block, j).alias("low"), F.greatest(block, j).alias("high"), (block > j).cast("int").alias("side"))
        rows = _packed(left, p).select(F.explode(F.transform(every(p), of_pair)).alias("at"), "data")
        cells = p * (p + 1) // 2
    else:
        rows = _packed(left, p).select(F.explode(F.transform(every(q), lambda j: cell(block, j, 0))).alias("at"), "data")
        rows = rows.union(_packed(right, q).select(F.explode(F.transform(every(p), lambda j: cell(j, block, 1))).alias("at"), "data"))
        cells = p * q

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def found() -> Iterator[pa.RecordBatch]:
            x, y = (np.sort(np.frombuffer(b"".join(s), np.int64)) for s in sides)
            if one_table and at[0] == at[1]:
                y = x
            if len(x) and len(y):
                for a, b, d in pairs(x, y):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.int32())], names=["a", "b", "distance"])

        for batch in batches:
            for low, high, side, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (low, high) != at:
                    if at is not None:
                        yield from found()
                    at, sides = (low, high), ([], [])
                sides[side].append(data)
        if at is not None:
            yield from found()

    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(cells, 64))
    dealt = rows.select("at.*", "data").repartition(tasks, "low", "high").sortWithinPartitions("low", "high")
    return dealt.mapInArrow(compare, "a long, b long, distance int")


def _tiles(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of some x to all y at a time: the first x's place, distances."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    step = max(1, TILE // len(y))
    for i in range(0, len(x), step):
        yield i, np.bitwise_count(x[i : i + step, None] ^ y)


def _within(x: np.ndarray, y: np.ndarray, k: int, itself: bool, ordered: bool) -> Iterator[tuple]:
    """Pairs of x and y at most k apart; ordered: a < b, each once."""
    for i, d in _tiles(x, y):
        at = np.flatnonzero(d <= k)
        if not len(at):
            continue
        a, b, d = x[i + at // len(y)], y[at % len(y)], d.ravel()[at]
        if ordered:
            keep = a < b if x is y else slice(None)
            a, b = np.minimum(a, b), np.maximum(a, b)
        else:
            keep = slice(None) if itself else a != b
        yield a[keep], b[keep], d[keep]


def _nearest_within(x: np.ndarray, y: np.ndarray, k: int, top: int, itself: bool) -> Iterator[tuple]:
    """For each x the top nearest y at most k apart, ties by the word: y ascends, and argmin takes the first."""
    for i, d in _tiles(x, y):
        if not itself:
            d[d == 0] = 255
        rows, out = np.arange(len(d)), []
        for _ in range(min(top, len(y))):
            j = d.argmin(axis=1)
            least = d[rows, j]
            d[rows, j] = 255
            near = least <= k
            if not near.any():
                break
            out.append((x[i + rows[near]], y[j[near]], least[near]))
        if out:
            yield tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _by_bands(left: DataFrame, right: DataFrame, k: int, bands: list[tuple[int, int, int]]) -> DataFrame:
    """Pairs at most k apart that meet in a band: a, b, distance; some of them repeatedly."""
    listed = left.select("a", F.inline(_listed(F.col("a"), bands, lambda r: r // 2))).hint("merge")
    met = listed.join(right.select("b", F.inline(_listed(F.col("b"), bands, lambda r: r - r // 2))), ["band", "bits"])
    return met.select("a", "b", distance(F.col("a"), F.col("b")).alias("distance")).filter(F.col("distance") <= k)


def _words(df: DataFrame, word: str, name: str) -> DataFrame:
    return persisted(df.select(F.col(word).cast("long").alias(name)).filter(F.col(name).isNotNull()).distinct(), "words")


def similar_words(words: DataFrame, word: str, k: int, others: DataFrame | None = None, other: str | None = None, bands: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Pairs of different words (a < b; with others: a of words, b of others, also equal) at most k bits apart: a, b, distance.

    Distinct words are written to the shared folder first: they are counted, and read twice.  Given
    bands are joined; without, that or comparing all pairs, whichever costs less.
    """
    if not 0 <= k < 64:
        raise ValueError("k must be 0 to 63")
    left = _words(words, word, "a")
    right = _words(others, other or word, "b") if others is not None else left.select(F.col("a").alias("b"))
    n = left.count()
    m = right.count() if others is not None else n
    if bands is None:
        bands = plan(k, max(n, m))
        if not bands or _compares_all(left, n, right, m, k, bands):
            return _by_blocks(left, n, right if others is not None else None, m, partial(_within, k=k, itself=True, ordered=others is None))
    near = _by_bands(left, right, k, bands)
    if others is None:
        near = near.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    return near.distinct()


def similar_rows(df: DataFrame, ident: str, word: str, k: int) -> DataFrame:
    """For every row with near rows: id, copies (other rows of its word), near (rows of other words within k bits), nearest (least distance to those).

    Ids and words are written to the shared folder first, as they are read four times.
    """
    df = persisted(df.select(ident, word), "words")
    counts = df.filter(F.col(word).isNotNull()).groupBy(F.col(word).alias("w")).agg(F.count("*").alias("rows"))
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "distance")
    both = similar_words(df, word, k).select(F.inline(F.array(F.struct("a", "b", "distance"), turned)))
    near = both.join(counts.select(F.col("w").alias("b"), "rows").hint("merge"), "b").groupBy(F.col("a").alias("w")).agg(F.sum("rows").alias("near"), F.min("distance").alias("nearest"))
    found = counts.hint("merge").join(near, "w", "left").filter("rows > 1 or near is not null")
    return df.select(F.col(ident), F.col(word).alias("w")).join(found.hint("merge"), "w").select(ident, (F.col("rows") - 1).alias("copies"), F.coalesce("near", F.lit(0)).cast("long").alias("near"), "nearest")


def nearest_words(queries: DataFrame, query: str, words: DataFrame, word: str, k: int, top: int, itself: bool = True) -> DataFrame:
    """For each query word the ``top`` nearest words within k bits (not itself: only different ones): a, b, distance, rank (ties by the word).

    Where all pairs are compared, a task gives no more than ``top`` words for each of its queries.
    """
    if not 0 <= k < 64 or top < 1:
        raise ValueError("k must be 0 to 63, top 1 or more")
    left, right = _words(queries, query, "a"), _words(words, word, "b")
    n, m = left.count(), right.count()
    bands = plan(k, max(n, m))
    if not bands or _compares_all(left, n, right, m, k, bands):
        near = _by_blocks(left, n, right, m, partial(_nearest_within, k=k, top=top, itself=itself))
    else:
        near = _by_bands(left, right, k, bands).filter(F.lit(itself) | (F.col("a") != F.col("b"))).distinct()
    rank = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= top)


def compare_units(left: DataFrame, right: DataFrame, pair: str) -> DataFrame:
    """Unit by unit comparison of many pairs of composites, as a join.

    left and right: rows of units (pair, main, sub, version, body), one row for each unit.  For each
    pair: <main>_dist of units of the same kind, instance_match and id_match; null where a side lacks the unit.
    """
    on = [pair, "main", "sub", "version"]
    both = left.select(*on, F.col("body").alias("x")).join(right.select(*on, F.col("body").alias("y")), on)
    word = lambda c, i: F.conv(F.substring(F.hex(c), 16 * i + 1, 16), 16, -10).cast("long")
    same_size = F.length("x") == F.length("y")
    bits = sum((F.coalesce(F.bit_count(word("x", i).bitwiseXOR(word("y", i))), F.lit(0)) for i in range(4)), F.lit(0))
    d = both.select(pair, "main", F.when(same_size, bits).alias("d"), (F.col("x") == F.col("y")).alias("same"))
    names = {0: "meta_dist", 1: "semantic_dist", 2: "content_dist", 3: "data_dist", 6: "id_dist", 7: "flake_dist"}
    equal = {4: "instance_match", 6: "id_match"}
    return d.groupBy(pair).agg(*(F.max(F.when(F.col("main") == m, F.col("d"))).alias(n) for m, n in names.items()), *(F.max(F.when(F.col("main") == m, F.col("same"))).alias(n) for m, n in equal.items()))
