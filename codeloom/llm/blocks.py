"""Blocks of documents below the shared folder, and passes over them.

Some operators must look at the texts more than once, and between passes learn little about them:
which fingerprints occur elsewhere, say.  The documents are written once, in blocks of a few MB, as
files that all executors can read; then only fingerprints travel, packed, and each pass takes the
answers for a block together with the block's name.  A block's file has a name of its own, and the
manifest that lists it is written before anything reads it; so any later task can run again anywhere.

Fingerprints go to parts of the key space.  A block sends to COARSE parts at most, whatever the size
of the corpus.  Where more parts are needed so that each fits in a task, the rows of BUNDLE blocks
for one coarse part are put together and cut finer on the way, and answers return by the same two hops.
So what a block sends doesn't grow with the number of parts, and the rows of either hop stay long.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..naming import exactly
from .common import release
from .storage import open_input, persisted, scratch, write_file
from .wordscan import slices

BLOCK_BYTES = 4 << 20
PART_BYTES = 8 << 20
#: Most parts that a block sends to, and how many blocks' rows are cut finer together.
COARSE = 1024
BUNDLE = 1024
#: Most tasks of a pass; parts and blocks beyond that go through a task one after the other.
MOST_TASKS = 20_000
#: Stands for a null id between the stages.
NO_ID = -(1 << 63)


def write_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Manifest with a row for each document: block, row (in it), doc_id (NO_ID for null), n_bytes, key (MD5 of the text; null counts as empty)."""
    root = scratch(docs.sparkSession, "blocks")
    rows = docs.select(F.coalesce(exactly(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(exactly(text_col).cast("string"), F.lit("")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            path = f"{root}/{uuid.uuid4().hex}.parquet"
            keys = pa.array([hashlib.md5(x.as_buffer()).digest() for x in t["text"]], pa.binary())
            t = t.append_column("key", keys)
            write_file(path, lambda out: pq.write_table(t, out, compression="zstd", use_dictionary=False, write_statistics=False))
            n = t.num_rows
            return pa.RecordBatch.from_arrays(
                [pa.array([path] * n), pa.array(np.arange(n, dtype=np.int32)), pa.concat_arrays(t["doc_id"].chunks), pc.binary_length(pa.concat_arrays(t["text"].chunks)).cast(pa.int64()), keys],
                names=["block", "row", "doc_id", "n_bytes", "key"],
            )

        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                held.append(part)
                size += part.column(1).nbytes
                if size >= BLOCK_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return persisted(rows.mapInArrow(write, "block string, row int, doc_id long, n_bytes long, key binary"), "manifest")


def read_block(path: str, skip: list[int] | None) -> pa.Table:
    """A block's documents (doc_id, text, key) without the rows to skip."""
    with open_input(path) as f:
        t = pq.read_table(f)
    if skip is not None and len(skip):
        keep = np.ones(t.num_rows, dtype=bool)
        keep[np.asarray(skip)] = False
        t = t.filter(pa.array(keep))
    return t.combine_chunks()


def _numbered(rows: DataFrame) -> DataFrame:
    """rows, which have an id of monotonically_increasing_id in ``mid``, numbered without gaps from 0 as ``no``."""
    pid, place = F.shiftright("mid", 33), F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    # a row for each partition of a written table: at most MOST_TASKS or so
    sizes = rows.groupBy(pid.alias("pid")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("pid", pid).join(sizes.select("pid", before.alias("before")), "pid").withColumn("no", F.col("before") + place).drop("pid", "before", "mid")


class Blocks:
    """The blocks of some documents, each text once.

    copies: a row for each document that isn't the first of its text, with its place.  First is the
    least id; a null id is less than any.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.manifest = write_blocks(docs, id_col, text_col)
        spark = docs.sparkSession
        who = F.struct("doc_id", "block", "row")
        # read from a table, so that the join can split a text of very many copies
        groups = persisted(self.manifest.groupBy("key").agg(F.min(who).alias("first"), F.count("*").alias("n")).filter("n > 1"), "groups")
        self.copies = persisted(
            self.manifest.join(groups, "key").filter(who != F.col("first")).select("doc_id", "block", "row", "key"), "copies"
        )
        skips = self.copies.groupBy("block").agg(F.collect_list("row").alias("skip"))  # at most a block's rows
        per_block = self.manifest.groupBy("block").agg(F.sum("n_bytes").alias("n_bytes"))
        #: a row for each block: no (from 0 on, without gaps), block, n_bytes, skip
        self.control = _numbered(persisted(per_block.join(skips, "block", "left").withColumn("mid", F.monotonically_increasing_id()), "control"))
        n = self.control.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()
        #: tasks of a pass over blocks, and parts that fingerprints are dealt to
        self.tasks = max(1, min(n.n, 12), min(n.n // 4, MOST_TASKS))
        self.coarse, self.fine = levels(max(1, n.b // PART_BYTES))
        self.spark = spark

    def map(self, fn: Callable[[int, str, list[int] | None], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """fn(no, block, skip) for each block."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                for r in batch.to_pylist():
                    yield from fn(r["no"], r["block"], r["skip"])

        return self.control.select("no", "block", "skip").repartition(self.tasks).mapInArrow(run, schema)

    def map_with(self, answers: DataFrame, fn: Callable[[int, str, list[int] | None, pa.Table], pa.Table], schema: str) -> DataFrame:
        """fn(no, block, skip, the answers for it) for each block."""
        control = self.control.select("no", "block", "skip").repartition(self.tasks, "no")
        own = answers.repartition(self.tasks, "no")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            release()
            r = left.to_pylist()[0]
            return fn(r["no"], r["block"], r["skip"], right)

        return control.groupBy("no").cogroup(own.groupBy("no")).applyInArrow(run, schema)

    def exchange(self, sent: DataFrame, bits: int, values: tuple[str, ...], answer: Callable[..., np.ndarray]) -> DataFrame:
        """Answers to part_rows: part, no, answer (packed, along the keys of the row sent).

        answer(keys, **values) gets the keys of all blocks in a part of the key space, one block's
        behind the other's, with the values sent along, and returns one answer for each.
        """
        coarse, fine, together = self.coarse, self.fine, BUNDLE

        def decide(group: pa.Table) -> pa.Table:
            release()
            keys = [unpack_sorted(x) for x in group["keys"].to_pylist()]
            found = answer(np.concatenate(keys), **{c: np.concatenate([unpack(x) for x in group[c].to_pylist()]) for c in values})
            ends = np.cumsum([len(k) for k in keys])[:-1]
            return group.drop(["keys", *values]).append_column("answer", pa.array([pack(x) for x in np.split(found, ends)], pa.binary()))

        if fine == 1:
            return sent.repartition(part_tasks(coarse), "part").groupBy("part").applyInArrow(decide, "part int, no long, answer binary")

        def bundle(group: pa.Table) -> pa.Table:
            """Rows of BUNDLE blocks for one coarse part: one row for each finer part."""
            release()
            part, no = group["part"][0].as_py(), group["no"].to_numpy()
            keys = [unpack_sorted(x) for x in group["keys"].to_pylist()]
            origin = np.repeat((no % together).astype(np.uint32), [len(k) for k in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            keys, more = keys[order], {"origin": origin[order]} | {c: np.concatenate([unpack(x) for x in group[c].to_pylist()])[order] for c in values}
            at = np.r_[0, np.searchsorted(keys, fine_bounds(bits, coarse, fine, part)), len(keys)]
            full = np.flatnonzero(np.diff(at))
            columns = {"part": pa.array(np.full(len(full), part), pa.int32()), "fine": pa.array(full, pa.int32()), "bundle": pa.array(np.full(len(full), no[0] // together), pa.int64()), "keys": pa.array([pack_sorted(keys[at[p] : at[p + 1]]) for p in full], pa.binary())}
            return pa.table(columns | {c: pa.array([pack(v[at[p] : at[p + 1]]) for p in full], pa.binary()) for c, v in more.items()})

        def unbundle(group: pa.Table) -> pa.Table:
            release()
            group = group.sort_by("fine")
            part, number = group["part"][0].as_py(), group["bundle"][0].as_py()
            origin, found = (np.concatenate([unpack(x) for x in group[c].to_pylist()]) for c in ("origin", "answer"))
            order = np.argsort(origin, kind="stable")
            slots, start = np.unique(origin[order], return_index=True)
            return pa.table({"part": pa.array(np.full(len(slots), part), pa.int32()), "no": pa.array(number * together + slots.astype(np.int64), pa.int64()), "answer": pa.array([pack(x) for x in np.split(found[order], start[1:])], pa.binary())})

        plan = "part int, fine int, bundle long, keys binary, origin binary" + "".join(f", {c} binary" for c in values)
        many = part_tasks(coarse * fine)
        bundled = sent.withColumn("bundle", F.floor(F.col("no") / together)).repartition(many, "part", "bundle").groupBy("part", "bundle").applyInArrow(bundle, plan)
        decided = bundled.repartition(many, "part", "fine").groupBy("part", "fine").applyInArrow(decide, "part int, fine int, bundle long, origin binary, answer binary")
        return decided.repartition(many, "part", "bundle").groupBy("part", "bundle").applyInArrow(unbundle, "part int, no long, answer binary")


_ZSTD = zstandard.ZstdCompressor(level=1)


def pack(values: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane, compressed; of 8 bytes each if unsigned 64-bit, else of 4."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + _ZSTD.compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view({8: np.uint64, 4: np.uint32, 1: np.uint8}[width]).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers as differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def levels(parts: int) -> tuple[int, int]:
    """Coarse parts, and finer parts in each."""
    coarse = max(1, min(parts, COARSE))
    return coarse, -(-parts // coarse)


@lru_cache(8)
def coarse_bounds(bits: int, coarse: int) -> np.ndarray:
    """First keys of all coarse parts but the first."""
    return np.array([-(-(p << bits) // coarse) for p in range(1, coarse)], dtype=np.uint64)


def fine_bounds(bits: int, coarse: int, fine: int, part: int) -> np.ndarray:
    low, high = -(-(part << bits) // coarse), -(-((part + 1) << bits) // coarse)
    return np.array([low + -(-f * (high - low) // fine) for f in range(1, fine)], dtype=np.uint64)


def part_rows(no: int, keys: np.ndarray, bits: int, coarse: int, **more: np.ndarray) -> pa.RecordBatch:
    """One row for each of the coarse parts that has keys (ascending, of so many bits): part, no (of the block), keys packed, and other arrays along the keys packed."""
    at = np.r_[0, np.searchsorted(keys, coarse_bounds(bits, coarse)), len(keys)]
    full = np.flatnonzero(np.diff(at))
    return pa.RecordBatch.from_pydict(
        {"part": pa.array(full, pa.int32()), "no": pa.array(np.full(len(full), no), pa.int64()), "keys": pa.array([pack_sorted(keys[at[p] : at[p + 1]]) for p in full], pa.binary())}
        | {k: pa.array([pack(v[at[p] : at[p + 1]]) for p in full], pa.binary()) for k, v in more.items()}
    )


def part_tasks(parts: int) -> int:
    """Tasks that parts are dealt to: a few parts each, and not fewer tasks than a small cluster has cores."""
    return max(1, min(parts, 12), min(parts // 4, MOST_TASKS))


CENSUS = "part int, no long, keys binary, counts binary"


def totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each key how often all blocks have it."""
    every, at = np.unique(keys, return_inverse=True)
    return np.minimum(np.bincount(at, weights=counts, minlength=len(every)), 0xFFFFFFFF).astype(np.uint32)[at]


def answers_in_order(answers: pa.Table) -> np.ndarray:
    """A block's answers of all parts, one behind the other as its keys were."""
    found = [unpack(x) for x in answers.sort_by("part")["answer"].to_pylist()]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)
