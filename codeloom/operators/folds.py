"""Codes of groups of rows, as aggregates: what is folded inside of one value elsewhere, here goes over a table.

Sums and minima are formed before the shuffle, those of many places at once in numpy over each Arrow
batch, so one group may hold any share of the rows (but see audio_digest_by).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions import native
from ..functions.columns import Functions
from ..functions.constants import FRAME_VALUES, Content, Main
from ..functions.sketches import minhash_groups


def _majority(bits: int, word: Column, base: int = 0) -> list[Column]:
    """For each bit from the highest on, whether at least half of the rows have it."""
    return [(2 * F.sum(F.shiftrightunsigned(word, bits - 1 - k).bitwiseAND(F.lit(1).cast("long"))) >= F.count(word)).alias(f"b{base + k}") for k in range(bits)]


def _number(names: list[str]) -> Column:
    return F.concat(*(F.col(n).cast("int").cast("string") for n in names))


def _grouped(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An order of a batch's rows by key, and where each key begins in it."""
    code = keys.dictionary_encode()
    code = code.indices.fill_null(len(code.dictionary)).to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.r_[True, np.diff(code[order]) != 0]) if len(code) else order


def simhash_by(df: DataFrame, key: str, words: list[str], into: str = "digest") -> DataFrame:
    """SimHash of each group's digests, which are given as 64-bit words.  Rows with null words don't count."""
    kind, places = df.schema[key].dataType, range(64 * len(words))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if any(c.null_count for c in b.columns[1:]):
                b = b.filter(reduce(pc.and_, [pc.is_valid(c) for c in b.columns[1:]]))
            order, start = _grouped(b.column(0))
            data = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[1:]])[order]
            bits = np.unpackbits(np.ascontiguousarray(data, dtype=">i8").view(np.uint8), axis=1)
            ones = list(np.add.reduceat(bits, start, axis=0, dtype=np.int64)) if len(start) else []
            n = np.diff(np.r_[start, len(order)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(order[start])), pa.array(n, pa.int64()), pa.array(ones, pa.list_(pa.int64()))], names=[key, "n", "ones"])

    # nulls go inside of partial: a filter would be pushed below what words are made of, and make them twice
    rows = df.select(key, *(F.col(w).cast("long") for w in words))
    parts = rows.mapInArrow(partial, StructType([StructField(key, kind), StructField("n", LongType()), StructField("ones", ArrayType(LongType()))]))
    found = parts.groupBy(key).agg(*((2 * F.sum(F.get("ones", F.lit(k))) >= F.sum("n")).alias(f"b{k}") for k in places))
    parts = [F.lpad(F.conv(_number([f"b{64 * i + k}" for k in range(64)]), 2, 16), 16, "0") for i in range(len(words))]
    return found.select(key, F.unhex(F.concat(*parts)).alias(into))


def minhash_by(df: DataFrame, key: str, feature: str, into: str = "minhash") -> DataFrame:
    """Least values of each group's features (integers of up to 64 bits) under the 64 permutations: within each batch first, then by key."""
    kind = df.schema[key].dataType

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order, start = _grouped(b.column(0))
            values = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[order]
            least = list(minhash_groups(values, start).astype(np.int64)) if len(values) else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(order[start])), pa.array(least, pa.list_(pa.int64()))], names=[key, "least"])

    rows = df.filter(F.col(feature).isNotNull()).select(key, F.col(feature).cast("long"))
    parts = rows.mapInArrow(partial, StructType([StructField(key, kind), StructField("least", ArrayType(LongType()))]))
    least = parts.groupBy(key).agg(*(F.min(F.get("least", F.lit(k))).alias(f"m{k}") for k in range(64)))
    return least.select(key, F.array(*(f"m{k}" for k in range(64))).alias(into))


def pack_minhash(values: Column | str, bits: int = 4) -> Column:
    """The digest of an array of 64 least values: bit 0 of each, then bit 1 and so on."""
    v = F.col(values) if isinstance(values, str) else values
    plane = lambda k: F.lpad(F.conv(F.concat(*(F.shiftright(F.get(v, F.lit(i)), k).bitwiseAND(F.lit(1).cast("long")).cast("string") for i in range(64))), 2, 16), 16, "0")
    return F.unhex(F.concat(*(plane(k) for k in range(bits))))


def frame_code_by(frames: DataFrame, key: str, signature: str, bits: int = 64, into: str = "code") -> DataFrame:
    """Video code of each group of frame signatures: of different signatures, the sum at each place."""
    size = F.size(signature)
    checked = frames.select(key, F.when(size >= FRAME_VALUES, F.col(signature)).otherwise(F.raise_error(F.lit(f"frame signatures must have {FRAME_VALUES} values"))).alias("s"))
    distinct = checked.dropDuplicates([key, "s"])
    kind = StructType([StructField(key, frames.schema[key].dataType), StructField("s", ArrayType(LongType()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order, start = _grouped(b.column(0))
            values = b.column(1)
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = pc.list_value_length(values).to_numpy(zero_copy_only=False)
            rows = flat[(np.cumsum(size) - size)[:, None] + np.arange(FRAME_VALUES)] if len(order) else flat.reshape(0, FRAME_VALUES)
            sums = list(np.add.reduceat(rows[order], start, axis=0)) if len(order) else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(order[start])), pa.array(sums, pa.list_(pa.int64()))], names=[key, "s"])

    # a row for each group and batch, summed up place by place
    placed = distinct.select(key, "s").mapInArrow(partial, kind).select(key, F.posexplode("s").alias("place", "x")).groupBy(key, "place").agg(F.sum("x").alias("x"))
    sums = placed.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("s"))
    return sums.select(key, native.unit_code(Main.CONTENT, Content.VIDEO, 0, bits, native.frame_bits("s", bits)).alias(into))


def audio_digest_by(features: DataFrame, key: str, position: str, value: str, into: str = "digest") -> DataFrame:
    """256 bits of each group's signed 32-bit features: of all, of quarters by position, of thirds by value."""
    own = Window.partitionBy(key)
    rows = features.select(
        key,
        F.col(value).cast("long").alias("x"),
        F.row_number().over(own.orderBy(position)).alias("by_place"),
        F.row_number().over(own.orderBy(value, position)).alias("by_value"),
        F.count("*").over(own).alias("n"),
    )
    bucket = lambda rank, parts: F.floor((F.col(rank) - 1) / F.ceil(F.col("n") / parts)).cast("int")
    parts = rows.select(key, F.col("x").bitwiseAND(F.lit(0xFFFFFFFF)).alias("x"), F.explode(F.array(F.lit(0), 1 + bucket("by_place", 4), 5 + bucket("by_value", 3))).alias("part"))
    hashed = parts.groupBy(key, "part").agg(*_majority(32, F.col("x"))).select(key, "part", F.lpad(F.conv(_number([f"b{k}" for k in range(32)]), 2, 16), 8, "0").alias("h"))
    by_part = hashed.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col("part") == p, F.col("h"))), F.lit("0" * 8)).alias(f"p{p}") for p in range(8)))
    return by_part.select(key, F.unhex(F.concat(*(f"p{p}" for p in range(8)))).alias(into))


def compose_by(units: DataFrame, key: str, code: str, into: str = "code", wide: bool = False) -> DataFrame:
    """Composite of each group's units: a handful of rows, one of each kind."""
    f = Functions()
    return units.groupBy(key).agg(F.sort_array(F.collect_set(code)).alias("units")).select(key, f.compose("units", F.lit(wide)).alias(into))


def mixed_code_by(units: DataFrame, key: str, code: str, bits: int = 64, into: str = "code") -> DataFrame:
    """Mixed code of each group's content codes of ``bits`` bits and more: the majority of header byte and body."""
    if not 32 <= bits <= 256 or bits % 32:
        raise ValueError("32 to 256 bits, in steps of 32")
    f = Functions()
    words = units.select(key, f.code_decode(code).alias("c"))
    head = F.lpad(F.hex(F.col("c.main") * 16 + F.col("c.sub")), 2, "0")
    n = -(-bits // 64)
    digits = F.rpad(F.concat(head, F.substring(F.hex("c.body"), 1, bits // 4 - 2)), 16 * n, "0")
    fits = (F.col("c.main") == int(Main.CONTENT)) & (F.length("c.body") * 8 >= bits)
    checked = words.select(key, F.when(fits, digits).otherwise(F.raise_error(F.lit(f"only content codes of {bits} bits and more can be mixed"))).alias("x"))
    rows = checked.select(key, *(F.conv(F.substring("x", 16 * i + 1, 16), 16, -10).cast("long").alias(f"w{i}") for i in range(n)))
    return simhash_by(rows, key, [f"w{i}" for i in range(n)], "d").select(key, native.unit_code(Main.CONTENT, Content.MIXED, 0, bits, F.col("d")).alias(into))
