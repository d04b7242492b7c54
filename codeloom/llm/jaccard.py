"""Self-join of documents by Jaccard similarity of word shingles, with adaptive multi-match prefixes.

Every document is its set of shingles; equal sets are one node.  With shingles in one global order,
rare ones first, two sets of similarity t share at least l shingles among the first
n - ceil(t n) + l of each (n: a set's size), for every l that isn't more than they share; at least
ceil(t n), which bounds the l of each.  A longer prefix costs more lookups but
asks for more matches before two sets are compared in full.  Each document picks its l by the
estimated cost: lookups (the sum of its prefix shingles' document counts) and full comparisons
(that sum over l), and posts the prefix of that l alone.

Two similar sets whose choices are l and m share min(l, m) of the shingles they have posted, so they
meet in some list.  A pair that meets becomes a candidate only if the prefixes of max(l, m), which
stand with the nodes, share max(l, m) shingles; and only candidates are compared by their full sets.

Document counts come from a census of all shingles' fingerprints, sent packed.  A document with
more shingles of its own than may differ can have no partner, and posts nothing.  Lists of postings
are split in blocks where long; two entries of a list meet only if sizes fit and the
parities of their shingles in 1024 cells differ in no more cells than the sets may in shingles (both
tests never lose a pair).  As the result is the groups of linked documents, pairs come in
rounds: neighbours in each list first; then for each entry the nearest one of another group, as long
as that finds links; at last every pair of a list that still isn't in one group.  In a list that one
group has most of, only the others are compared with all: its entries' pairs can't join anything.
No pair within a group of copies is ever written out more than needed to hold the group together,
and none is skipped whose link could join two groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..naming import exactly
from .blocks import CENSUS, NO_ID, Blocks, answers_in_order, part_rows, read_block, totals
from .common import fresh
from .components import components
from .storage import persisted
from .wordscan import NOT_BLANK, scan, slices, window_hashes

CELLS = 1024
LONGEST = 3
#: How many lookups a full comparison is worth.
COMPARE = 4
#: Longest list that one task compares; longer ones are compared block by block.
LIST_BLOCK = 512
_BITS = 48


def shingle_sets(texts: pa.Array | pa.ChunkedArray, width: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, ascending.  A text with fewer words than a shingle has one of all its words."""
    for part in slices(pa.table({"text": texts}).combine_chunks(), "text"):
        words = scan(part["text"], NOT_BLANK, lower)
        windows = window_hashes(words.hashes, width)
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            if b - a >= width:
                yield np.unique(windows[a : b - width + 1])
            else:
                yield window_hashes(words.hashes[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64)


def cells(shingles: np.ndarray) -> bytes:
    """The parity of the number of shingles in each of CELLS cells."""
    return np.packbits(np.bincount((shingles >> np.uint64(20)).astype(np.int64) % CELLS, minlength=CELLS).astype(np.uint8) & 1).tobytes()


def prefix(shingles: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int, int] | None:
    """The shared shingles of the longest prefix in order, how many of them belong to the prefix of l = 1 (each further l has one more), and the l chosen; None if no partner is possible.

    The prefix of l is the first base + l - 1 of the shingles returned.
    """
    n = len(shingles)
    least = -(-percent * n // 100)  # that a partner shares
    shared = np.flatnonzero(counts > 1)
    base = n - least + 1 - (n - len(shared))
    if base <= 0:
        return None
    order = shared[np.lexsort((shingles[shared], counts[shared]))][: base + LONGEST - 1]
    lookups = np.cumsum(counts[order].astype(np.int64))
    costs = [lookups[min(base + m - 1, len(order)) - 1] * (1 + COMPARE / m) for m in range(1, max(1, min(LONGEST, least)) + 1)]
    return shingles[order], base, 1 + int(np.argmin(costs))


def _posted(blocks: Blocks, width: int, percent: int) -> DataFrame:
    """A row for each distinct text: key, doc_id, size; and where a partner is possible digest, ell, base, tokens, cells, items."""

    def send(no: int, block: str, skip: list[int] | None) -> Iterator[pa.RecordBatch]:
        sets = list(shingle_sets(read_block(block, skip)["text"], width))
        if sets:
            keys, counts = np.unique(np.concatenate(sets) >> np.uint64(64 - _BITS), return_counts=True)
            yield part_rows(no, keys, _BITS, parts, counts=counts.astype(np.uint32))

    def post(no: int, block: str, skip: list[int] | None, answers: pa.Table) -> pa.Table:
        t = read_block(block, skip)
        sets = list(shingle_sets(t["text"], width))
        keys = np.unique(np.concatenate(sets) >> np.uint64(64 - _BITS)) if sets else np.zeros(0, dtype=np.uint64)
        counts = answers_in_order(answers)
        rows = []
        for doc_id, key, s in zip(t["doc_id"].to_pylist(), t["key"].to_pylist(), sets, strict=True):
            found = prefix(s, counts[np.searchsorted(keys, s >> np.uint64(64 - _BITS))], percent) if len(s) else None
            if found is None:
                rows.append((key, doc_id, len(s), None, None, None, None, None, None))
            else:
                tokens, base, ell = found
                rows.append((key, doc_id, len(s), hashlib.md5(s.tobytes()).digest(), ell, base, tokens.view(np.int64), cells(s), s.view(np.int64)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_POSTED), _POSTED, strict=True)], schema=_POSTED)

    parts = blocks.coarse
    counts = persisted(blocks.exchange(blocks.map(send, CENSUS), _BITS, ("counts",), totals), "census")
    return persisted(blocks.map_with(counts, post, from_arrow_schema(_POSTED)), "posted")


_POSTED = pa.schema(
    {"key": pa.binary(), "doc_id": pa.int64(), "size": pa.int64(), "digest": pa.binary(), "ell": pa.int32(), "base": pa.int32(), "tokens": pa.list_(pa.int64()), "cells": pa.binary(), "items": pa.list_(pa.int64())}
)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _fits(size_a, size_b, differ, percent: int) -> np.ndarray:
    """Whether sets can be similar, by sizes and by a lower bound of how many shingles differ: |A xor B| <= (1 - t) / (1 + t) (|A| + |B|)."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return (100 * small >= percent * large) & ((100 + percent) * differ <= (100 - percent) * (small + large))


def _cell_words(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=np.uint64).reshape(-1, CELLS // 64)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group of rows (neighbours that agree in by) ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[c].to_numpy(zero_copy_only=False) for c in by]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts_new = bool(held) and any(held[-1][c][-1].as_py() != batch[c][0].as_py() for c in by)
        if starts_new:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(change):
            held.append(batch.slice(0, change[-1]))
            yield pa.Table.from_batches(held).combine_chunks()
            held = [batch.slice(change[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _neighbours(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs that stand side by side in a list ordered by size; a long list is dealt to several."""
    salted = postings.withColumn("salt", F.pmod(F.hash("node"), F.ceil(F.col("n") / LIST_BLOCK).cast("int")))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, ["token", "salt"]):
            token, salt, size, node = (t[c].to_numpy() for c in ("token", "salt", "size", "node"))
            at = np.flatnonzero((token[1:] == token[:-1]) & (salt[1:] == salt[:-1]) & (100 * size[:-1] >= percent * size[1:]))
            if len(at):
                x = _cell_words(t["cells"].combine_chunks())
                at = at[_fits(size[at], size[at + 1], _differ(x[at], x[at + 1]), percent)]
                yield _pairs_batch(node[at], node[at + 1])

    dealt = salted.repartition(_tasks(postings), "token", "salt").sortWithinPartitions("token", "salt", "size", "node")
    return dealt.select("token", "salt", "size", "node", "cells").mapInArrow(pairs, "a long, b long").distinct()


_CELL = ["token", "kind", "low", "high"]


def _mixed(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings of lists with entries of two groups and more: with component, whether the list's largest group has it (most), and blocks of either kind (main_blocks, rest_blocks)."""
    grouped = persisted(postings.join(groups, postings["node"] == groups["v"], "left").drop("v").withColumn("component", F.coalesce("component", "node")), "grouped")
    sizes = grouped.groupBy("token", "component").agg(F.count("*").alias("c"))
    lists = sizes.groupBy("token").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("groups")).filter("groups > 1")
    blocks = lambda c: F.ceil(c / LIST_BLOCK).cast("int")
    found = grouped.join(lists.select("token", "top"), "token").withColumn("most", F.col("component") == F.col("top.component"))
    found = found.withColumn("main_blocks", blocks(F.col("top.c"))).withColumn("rest_blocks", blocks(F.col("n") - F.col("top.c")))
    return persisted(found.drop("top"), "mixed")


def _in_cells(mixed: DataFrame) -> DataFrame:
    """Rows to compare, dealt to tasks by cells of at most two blocks: of a list's largest group with others (kind 0), and of others with others (kind 1).

    Rows of one cell are compared where their sides differ; a cell's rows stand together, by size.
    """
    h = F.hash("node")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda kind, low, high, side: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), side.cast("long").alias("side"))
    main, own = F.pmod(h, F.col("main_blocks")), F.pmod(h, F.col("rest_blocks"))
    of_main = F.transform(every(F.col("rest_blocks")), lambda j: cell(0, main, j, F.lit(0)))
    of_rest = F.concat(
        F.transform(every(F.col("main_blocks")), lambda i: cell(0, i, own, F.lit(1))),
        F.transform(every(F.col("rest_blocks")), lambda k: cell(1, F.least(own, k), F.greatest(own, k), F.when(own == k, F.col("node")).otherwise(own))),
    )
    dealt = mixed.select("token", "node", "size", "ell", "component", "cells", F.explode(F.when(F.col("most"), of_main).otherwise(of_rest)).alias("at"))
    dealt = dealt.select("token", "node", "size", "ell", "component", "cells", "at.*")
    return dealt.repartition(_tasks(mixed), *_CELL).sortWithinPartitions(*_CELL, "size", "node")


def _across(t: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (rows i, rows j behind them) of whole cells that belong to two groups and may link, and in how many cells of parity they differ.

    All cells at once: first each row with the next one, then with the one after that, and so on.
    """
    size, group, side = (t[c].to_numpy() for c in ("size", "component", "side"))
    x = _cell_words(t["cells"].combine_chunks())
    keys = [t[c].to_numpy() for c in _CELL]
    begin = np.r_[0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1, t.num_rows]
    end = np.repeat(begin[1:], np.diff(begin))
    i, step = np.flatnonzero(end > np.arange(t.num_rows) + 1), 1
    while len(i):
        i = i[100 * size[i] >= percent * size[i + step]]  # sizes ascend: no later row fits, either
        at = i[(group[i] != group[i + step]) & (side[i] != side[i + step])]
        if len(at):
            differ = _differ(x[at], x[at + step])
            fit = _fits(size[at], size[at + step], differ, percent)
            if fit.any():
                yield at[fit], at[fit] + step, differ[fit]
        step += 1
        i = i[i + step < end[i]]


def _nearest(mixed: DataFrame, percent: int) -> DataFrame:
    """For each entry of a list the one of another group that differs in the fewest cells."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, _CELL):
            node = t["node"].to_numpy()
            least, best = np.full(len(node), CELLS + 1), np.full(len(node), -1)
            for i, j, d in _across(t, percent):
                for x, y in ((i, j), (j, i)):
                    nearer = d < least[x]
                    least[x[nearer]], best[x[nearer]] = d[nearer], y[nearer]
            at = np.flatnonzero(best >= 0)
            if len(at):
                yield _pairs_batch(node[at], node[best[at]])

    return _in_cells(mixed).mapInArrow(pairs, "a long, b long").distinct()


def _all_across(mixed: DataFrame, percent: int) -> DataFrame:
    """All pairs of two groups that meet in as many lists as the smaller ell of the two."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, _CELL):
            node, ell = t["node"].to_numpy(), t["ell"].to_numpy()
            for i, j, _ in _across(t, percent):
                yield pa.RecordBatch.from_arrays([*_pairs_batch(node[i], node[j]).columns, pa.array(np.minimum(ell[i], ell[j]), pa.int64())], names=["a", "b", "ell"])

    found = _in_cells(mixed).mapInArrow(pairs, "a long, b long, ell long")
    return found.groupBy("a", "b").agg(F.count("*").alias("lists"), F.first("ell").alias("ell")).filter("lists >= ell").select("a", "b")


def candidates(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs that met in a list those whose prefixes, of the larger ell of the two, share that many shingles.

    Also puts the end with more pairs in b: it is joined last, so that what a hub has isn't sent once for each of its pairs.
    """
    met = persisted(met, "met")
    degree = met.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    known = met.join(degree.toDF("a", "degree_a"), "a").join(degree.toDF("b", "degree_b"), "b")
    turned = known.select(F.when(F.col("degree_a") > F.col("degree_b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).otherwise(F.struct("a", "b")).alias("p")).select("p.*")
    end = lambda c: nodes.select(F.col("node").alias(c), F.struct("ell", "base", "tokens").alias(f"of_{c}"))
    most = F.greatest("of_a.ell", "of_b.ell")
    own = lambda c: F.slice(F.col(f"of_{c}.tokens"), F.lit(1), F.col(f"of_{c}.base") + most - 1)
    both = turned.join(end("a"), "a").join(end("b"), "b")
    return both.filter(F.size(F.array_intersect(own("a"), own("b"))) >= most).select("a", "b")


def _verified(met: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the candidates among met that are similar, by their full sets."""
    left = nodes.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    both = candidates(met, nodes).join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("items_a", "items_b")))
    return both.filter(100 * F.col("common") >= percent * (F.size("items_a") + F.size("items_b") - F.col("common"))).select("a", "b")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """A row for each document (NO_ID for a null id): doc_id, key (of its text), size, group (equal for linked texts), least (id in the group)."""
    blocks = Blocks(docs, id_col, text_col)
    texts = _posted(blocks, width, percent)
    shared = texts.filter("digest is not null")
    nodes = persisted(
        shared.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first(F.struct("size", "ell", "base", "tokens", "cells", "items")).alias("x")).select("digest", "first", "x.*").withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    entries = nodes.select("node", "size", F.col("ell").cast("long").alias("ell"), F.explode(F.slice(F.col("tokens"), F.lit(1), F.col("base") + F.col("ell") - 1)).alias("token"))
    lists = entries.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    postings = persisted(entries.join(lists, "token"), "postings")
    cells_of = nodes.select("node", "cells")  # many postings of a node share its cells: they are joined where a pass needs them
    joined = components(persisted(_verified(_neighbours(postings.join(cells_of, "node"), percent), nodes, percent), "links"))
    while True:
        mixed = _mixed(postings, joined)
        compared = mixed.join(cells_of, "node")
        near = persisted(_verified(_nearest(compared, percent), nodes, percent), "links")
        more = bool(near.head(1))
        if not more:
            near = _verified(_all_across(compared, percent), nodes, percent)
        joined = components(joined.select(F.col("v").alias("a"), F.col("component").alias("b")).union(near))
        if not more:
            break
    members = nodes.join(joined, nodes["node"] == joined["v"], "left").select("digest", "first", F.coalesce("component", "node").alias("component"))
    least = members.groupBy("component").agg(F.min("first").alias("least"))
    by_digest = members.join(least, "component").select("digest", "component", "least")
    by_text = texts.select("key", "doc_id", "size", "digest").join(by_digest, "digest", "left")
    by_text = by_text.select("key", "size", F.coalesce(F.col("component").cast("string"), F.hex("key")).alias("group"), F.coalesce("least", "doc_id").alias("least"))
    return blocks.manifest.select("doc_id", "key").join(by_text, "key")


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (least id that links reach, its own included).

    Two documents link when 100 |A and B| >= percent |A or B| for their sets of shingles of
    ``width`` words (longest runs without blanks, A-Z lower-cased).  A text of fewer words has one
    shingle of all of them.  A text without words (null, empty, blank) has no shingle and links with
    nothing, not even its copies.  Repeated rows, also of one id, are rows like others, each with
    the group of its own text; a null id is smaller than any other.  Ids are cast to long; what can't
    be fails.  Very long texts take part whole: a set of n shingles needs about 30 n bytes in a task.
    Other columns aren't read, whatever their names.  An empty table gives no rows.
    """
    every = _grouped(docs, id_col, text_col, width, percent)
    own = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("least"))
    real = lambda c: F.when(c != F.lit(NO_ID), c)
    return every.select(real(F.col("doc_id")).alias("doc_id"), F.col("size").alias("n_shingles"), real(own).alias("component_id"))


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs' rows and columns, with one document of each group of similar_groups: that of the least id, then of the least MD5 of the text.

    Texts without words belong to no group and stay.  Rows that agree in id and text are one document, of which one row stays.
    """
    ident, key = fresh("_id", docs.columns), fresh("_key", docs.columns)
    every = _grouped(docs, id_col, text_col, width, percent)
    first = every.filter("size > 0").groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("x")).select("x.doc_id", "x.key").union(every.filter("size = 0").select("doc_id", "key")).distinct()
    text = F.coalesce(exactly(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(ident, F.coalesce(exactly(id_col).cast("long"), F.lit(NO_ID))).withColumn(key, F.unhex(F.md5(text.cast("binary"))))
    kept = rows.join(first.toDF(ident, key), [ident, key], "left_semi")
    return kept.dropDuplicates([ident, key]).select(*(exactly(c) for c in docs.columns))
