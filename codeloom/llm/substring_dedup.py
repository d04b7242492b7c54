"""Removal of repeated word windows, found by difference-cover anchors.

A window is ``width`` consecutive words of one document.  Take a period p and a difference cover D
of it: residues such that every difference modulo p is one of two of them.  For any two places i
and j there is then a k < p with i + k and j + k both at residues of D.  So two equal windows share
an anchor, a shorter window of width - p + 1 words that begins at a place whose residue is in D in
both documents, at the same distance.  Only anchors are hashed and counted across the corpus (a
third of all places, with period 13); where an anchor occurs again, the match is extended to the
windows around it: those that hold a recurring anchor are compared by two independent hashes of all
their words (128 bits, within a block as across blocks), and of equal windows the first, by
document id and place, stays.

Each distinct text takes part once: every window of a later copy begins earlier in the first one.
Blocks send packed fingerprints, one for each distinct anchor or window in them, and get one answer
for each; so a passage that a third of all documents hold is one entry in each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import CENSUS, NO_ID, Blocks, answers_in_order, part_rows, read_block, totals
from .storage import persisted
from .wordscan import NOT_BLANK, Words, scan, slices, window_hashes

#: Perfect difference sets by period.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 6, 15, 22, 26, 45, 55)}
_BITS = 48


def period_for(width: int) -> int:
    """The longest period that leaves anchors of two fifths of the window."""
    return max(p for p in COVERS if 5 * (width - p + 1) >= 2 * width)


def _sorted_block(path: str, skip: list[int] | None) -> tuple[pa.Table, np.ndarray]:
    """A block's documents by id, then text key; and which of them are copies of earlier documents."""
    t = read_block(path, None)
    copy = np.zeros(t.num_rows, dtype=bool)
    if skip is not None and len(skip):
        copy[np.asarray(skip)] = True
    t = t.append_column("copy", pa.array(copy)).sort_by([("doc_id", "ascending"), ("key", "ascending")]).combine_chunks()
    return t, t["copy"].to_numpy()


class _Scan:
    """The words of a block's first copies, part by part, and what can be asked about their windows."""

    def __init__(self, path: str, skip: list[int] | None, width: int):
        t, copy = _sorted_block(path, skip)
        self.table = t.filter(pa.array(~copy)).combine_chunks()
        self.width, self.period = width, period_for(width)
        cover = np.zeros(self.period, dtype=bool)
        cover[[d % self.period for d in COVERS[self.period]]] = True
        self.cover, self.anchor_width = cover, width - self.period + 1

    def parts(self) -> Iterator[tuple[pa.Table, Words]]:
        for part in slices(self.table, "text"):
            yield part, scan(part["text"], NOT_BLANK, False)

    def anchors(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors (in the part's words) and their fingerprints."""
        n = len(words.hashes)
        place = np.arange(n) - np.repeat(words.first[:-1], words.counts)
        left = np.repeat(words.first[1:], words.counts) - np.arange(n)
        at = np.flatnonzero(self.cover[place % self.period] & (left >= self.anchor_width))
        return at, window_hashes(words.hashes, self.anchor_width)[at] >> np.uint64(64 - _BITS) if len(at) else np.zeros(0, dtype=np.uint64)

    def anchor_census(self) -> tuple[np.ndarray, np.ndarray]:
        found = [self.anchors(w)[1] for _, w in self.parts()]
        return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))

    def candidates(self, words: Words, again: np.ndarray) -> np.ndarray:
        """Places where a window begins that holds an anchor among again (ascending fingerprints)."""
        at, prints = self.anchors(words)
        if not len(at) or not len(again):
            return np.zeros(0, dtype=np.int64)
        near = np.minimum(np.searchsorted(again, prints), len(again) - 1)
        at = at[again[near] == prints]
        cover = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        np.add.at(cover, np.maximum(at - self.period + 1, 0), 1)
        np.add.at(cover, at + 1, -1)
        held = np.cumsum(cover[:-1]) > 0
        left = np.repeat(words.first[1:], words.counts) - np.arange(len(words.hashes))
        return np.flatnonzero(held & (left >= self.width))


def _recurring(scanned: _Scan, answers: pa.Table) -> np.ndarray:
    keys, _ = scanned.anchor_census()
    return keys[answers_in_order(answers) > 1] if len(keys) else keys


def _windows(scanned: _Scan, again: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of each part; and for all of them in a row: hash, second hash, row of the document."""
    places, first, second, rows, base = [], [], [], [], 0
    for part, words in scanned.parts():
        at = scanned.candidates(words, again)
        places.append(at)
        if len(at):
            first.append(window_hashes(words.hashes, scanned.width)[at])
            second.append(window_hashes(words.hashes, scanned.width, second=True)[at])
            rows.append(words.text_of()[at] + base)
        base += part.num_rows
    if not first:
        return places, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return places, np.concatenate(first), np.concatenate(second), np.concatenate(rows)


def _distinct(key: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The first place of each different window (by both hashes), in the order of the hashes."""
    order = np.lexsort((np.arange(len(key)), second, key))
    k, s = key[order], second[order]
    return order[np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]] if len(key) else order


def _first_ones(keys: np.ndarray, second: np.ndarray, doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """For each block's distinct windows, whether its document is the first of all that hold the window."""
    order = np.lexsort((tie, doc, second, keys))
    same = (keys[order[1:]] == keys[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
    first = np.zeros(len(keys), dtype=np.uint8)
    first[order[np.r_[True, ~same]]] = 1
    return first


def _joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words, each followed by a space, and where each text begins in them."""
    size = (words.end - words.start)[keep]
    out = np.full(int(size.sum()) + len(size), 0x20, dtype=np.uint8)
    ends = np.cumsum(size + 1)
    target = np.ones(len(out), dtype=bool)
    target[ends - 1] = False
    source = np.zeros(len(words.data) + 1, dtype=np.int8)
    source[words.start[keep]] = 1
    source[words.end[keep]] -= 1
    out[target] = words.data[np.cumsum(source[:-1], dtype=np.int8) > 0]
    kept = np.r_[0, np.cumsum(keep)][words.first]
    return out, np.r_[0, ends][kept]


_RESULT = pa.schema({"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))})


def _result(t: pa.Table, words: Words, gone: np.ndarray, wanted_spans: bool) -> pa.Table:
    out, at = _joined(words, ~gone)
    data, bounds = out.tobytes(), at.tolist()
    kept = [data[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    total = np.r_[0, np.cumsum(gone)]
    spans: list | None = None
    if wanted_spans:
        spans = []
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            change = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False]))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(change[::2], change[1::2], strict=True)])
    return pa.Table.from_arrays(
        [t["doc_id"].combine_chunks(), pa.array(words.counts, pa.int64()), pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()), pa.array(kept, pa.string()), pa.array(spans if spans is not None else [None] * t.num_rows, _RESULT.field("spans").type)],
        schema=_RESULT,
    )


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50, spans: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept (remaining words joined by one space), spans (removed words; on request).

    A word goes if some window over it also begins earlier: in a document of smaller id, or earlier
    in the same one.  Windows are judged on the input.  Words are longest runs without blanks, as
    they are.  Null and empty texts have no words; shorter texts than a window keep all.  A null id
    is smaller than any other.  Rows of one id are told apart by their text's MD5, and of rows equal
    in both one is the first; so the rows returned are the same in every run.  Ids are cast to long;
    what can't be fails.  Very long texts stand alone in a block and are scanned whole, in about 20
    bytes of memory for each of theirs.  Other columns aren't read.  No rows: no rows.
    """
    blocks = Blocks(docs, id_col, text_col)
    parts = blocks.coarse
    repeated_ids = bool(blocks.manifest.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").head(1))

    def send_anchors(no: int, block: str, skip: list[int] | None) -> Iterator[pa.RecordBatch]:
        keys, counts = _Scan(block, skip, width).anchor_census()
        if len(keys):
            yield part_rows(no, keys, _BITS, parts, counts=counts.astype(np.uint32))

    def send_windows(no: int, block: str, skip: list[int] | None, answers: pa.Table) -> pa.Table:
        scanned = _Scan(block, skip, width)
        _, key, second, row = _windows(scanned, _recurring(scanned, answers))
        at = _distinct(key, second)  # the first of each: documents and places are in order
        doc = scanned.table["doc_id"].to_numpy().view(np.uint64)[row[at]] ^ np.uint64(1 << 63)
        tie = np.array([int.from_bytes(k[:8], "big") for k in scanned.table["key"].to_pylist()] if repeated_ids else np.zeros(scanned.table.num_rows), dtype=np.uint64)[row[at]]
        return pa.Table.from_batches([part_rows(no, key[at], 64, parts, second=second[at], doc=doc, tie=tie)])

    def finish(no: int, block: str, skip: list[int] | None, answers: pa.Table) -> pa.Table:
        scanned = _Scan(block, skip, width)
        kind = answers["kind"].to_numpy()
        places, key, second, row = _windows(scanned, _recurring(scanned, answers.filter(pa.array(kind == 0))))
        again = np.ones(len(key), dtype=bool)
        again[_distinct(key, second)[answers_in_order(answers.filter(pa.array(kind == 1))) == 1]] = False
        out, base = [], 0
        for (part, words), at in zip(scanned.parts(), places, strict=True):
            cover = np.zeros(len(words.hashes) + 1, dtype=np.int64)
            begin = at[again[base : base + len(at)]]
            base += len(at)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + width, -1)
            out.append(_result(part, words, np.cumsum(cover[:-1]) > 0, spans))
        t, copy = _sorted_block(block, skip)
        for part in slices(t.filter(pa.array(copy)).combine_chunks(), "text"):
            words = scan(part["text"], NOT_BLANK, False)
            out.append(_result(part, words, np.repeat(words.counts >= width, words.counts), spans))
        return pa.concat_tables([_RESULT.empty_table(), *out])

    anchors = persisted(blocks.exchange(blocks.map(send_anchors, CENSUS), _BITS, ("counts",), totals), "anchors")
    windows = blocks.map_with(anchors, send_windows, "part int, no long, keys binary, second binary, doc binary, tie binary")
    first = persisted(blocks.exchange(windows, 64, ("second", "doc", "tie"), _first_ones), "windows")
    answers = anchors.withColumn("kind", F.lit(0)).unionByName(first.withColumn("kind", F.lit(1)))
    done = blocks.map_with(answers, finish, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: long, end: long>>")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(NO_ID), F.col("doc_id")))
