"""Benchmark decontamination by an FM-index for each shard of the training texts.

Benchmark texts become phrases: all windows of ``width`` words, or the whole text where it has
fewer.  Phrases are prepared once, in blocks of bounded size, and written below the shared folder; a
task holds one block at a time.  Each task cuts its documents into shards of a few MB and indexes all
words of a shard (a separator behind each text); all blocks' phrases are then found in it by
backward search, each occurrence is located from sampled suffix positions, and the covered words are
merged into spans.  With several blocks, a task indexes some tens of MB before it goes through the
blocks, so that a block is read once for all of those.  No shuffle; nothing goes to the driver but
the names of the blocks.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..naming import exactly
from .common import fresh, held, with_arrow
from .fm_index import FMIndex
from .storage import open_input, scratch, write_file
from .wordscan import LETTERS_DIGITS, scan, slices

#: Text of one shard, and of the shards that a task holds while it goes through several blocks of phrases.
SHARD_BYTES = 2 << 20
GROUP_BYTES = 32 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
_ARROW_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


class Phrases:
    """One block of the benchmark: its vocabulary (hashes, ascending), its distinct phrases (places in the vocabulary, filled up with its size), and the items of each."""

    def __init__(self, vocabulary: np.ndarray, patterns: np.ndarray, lengths: np.ndarray, items: np.ndarray, ids: np.ndarray):
        self.vocabulary, self.patterns, self.lengths, self.items = vocabulary, patterns, lengths, items
        self.ids = np.array(json.loads(ids.tobytes()), dtype=object)
        self.begin = np.searchsorted(items[:, 0], np.arange(len(patterns) + 1))

    @staticmethod
    def prepare(ids: list[str], texts: pa.Array, width: int) -> bytes:
        words = scan(texts, LETTERS_DIGITS, True)
        vocabulary, symbols = np.unique(words.hashes, return_inverse=True)
        rows, items = [np.zeros((0, width), dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            m = min(width, b - a)
            if m:
                found = np.lib.stride_tricks.sliding_window_view(symbols[a:b].astype(np.int32), m)
                rows.append(np.pad(found, ((0, 0), (0, width - m)), constant_values=len(vocabulary)))
                items.append(np.full(len(found), i))
        patterns, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        out = io.BytesIO()
        np.savez(
            out,
            vocabulary=vocabulary,
            patterns=patterns,
            lengths=np.count_nonzero(patterns < len(vocabulary), axis=1),
            items=np.unique(np.stack([of.ravel(), np.concatenate(items)], axis=1), axis=0),
            ids=np.frombuffer(json.dumps(ids).encode(), dtype=np.uint8),
        )
        return zstandard.ZstdCompressor(level=1).compress(out.getvalue())

    @classmethod
    def read(cls, path: str) -> Phrases:
        with open_input(path) as f:
            return cls(**np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(f.read()))))


class Shard:
    """The index of some texts' words, and what has been found in them."""

    def __init__(self, texts: pa.Array):
        words = scan(texts, LETTERS_DIGITS, True)
        self.first, n = words.first, len(words.first) - 1
        self.vocabulary, symbols = np.unique(words.hashes, return_inverse=True)
        sequence = np.zeros(len(symbols) + n, dtype=np.int64)
        text_of = words.text_of()
        sequence[np.arange(len(symbols)) + text_of] = symbols + 1
        self.index = FMIndex(sequence, len(self.vocabulary) + 1) if len(symbols) else None
        self.ends = words.first[1:] + np.arange(1, n + 1)  # behind each text's separator
        self.cover, self.items = np.zeros(len(symbols) + 1, dtype=np.int32), [[] for _ in range(n)]

    def search(self, p: Phrases) -> None:
        if self.index is None or not len(p.patterns):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, p.vocabulary), len(self.vocabulary) - 1)
        known = np.r_[self.vocabulary[at] == p.vocabulary, True]
        live = np.arange(len(p.patterns))
        for column in p.patterns.T:  # phrases of words that the shard has, all of them
            live = live[known[column[live]]]
        symbols = np.r_[at + 1, 0]
        low, high = self.index.search(symbols[p.patterns[live]], p.lengths[live])
        count = np.maximum(high - low, 0)
        nth = np.repeat(np.arange(len(count)), count)
        place = self.index.locate(low[nth] + np.arange(len(nth)) - np.repeat(np.cumsum(count) - count, count))
        text, phrase = np.searchsorted(self.ends, place, side="right"), live[nth]
        word = place - text
        np.add.at(self.cover, word, 1)
        np.add.at(self.cover, word + p.lengths[phrase], -1)
        for t, k in zip(*np.divmod(np.unique(text * len(p.patterns) + phrase), len(p.patterns)), strict=True):
            self.items[t].extend(p.ids[p.items[p.begin[k] : p.begin[k + 1], 1]])

    def found(self) -> pa.Array:
        first = self.first
        hit = np.cumsum(self.cover[:-1]) > 0
        hits = np.r_[0, np.cumsum(hit)]
        change = np.flatnonzero(np.diff(np.r_[False, hit, False]))
        spans: list[list] = [[] for _ in self.items]
        for a, b in zip(change[::2], change[1::2], strict=True):
            t = int(np.searchsorted(first, a, side="right")) - 1
            while a < b:  # a run of hit words may go on in the next text
                stop = min(b, first[t + 1])
                if a < stop:
                    spans[t].append({"start": int(a - first[t]), "end": int(stop - first[t])})
                a, t = stop, t + 1
        return pa.StructArray.from_arrays(
            [pa.array(np.diff(first), pa.int64()), pa.array(hits[first[1:]] - hits[first[:-1]], pa.int64()), pa.array([sorted(set(x)) for x in self.items], pa.list_(pa.string())), pa.array(spans, _ARROW_FOUND.field("spans").type)],
            fields=list(_ARROW_FOUND),
        )


def write_phrases(benchmark: DataFrame, id_col: str, text_col: str, width: int, block_bytes: int = 8 << 20) -> list[str]:
    """Blocks of the benchmark's phrases below the shared folder, of about block_bytes of text each (a longer text stands alone)."""
    root = scratch(benchmark.sparkSession, "phrases")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                path = f"{root}/{uuid.uuid4().hex}.phrases"
                data = Phrases.prepare(part.column(0).to_pylist(), part.column(1), width)
                write_file(path, lambda out, data=data: out.write(data))
                yield pa.RecordBatch.from_pydict({"path": [path]})

    rows = benchmark.select(F.coalesce(exactly(id_col).cast("string"), F.lit("")).alias("id"), exactly(text_col).cast("string").alias("text"))
    return sorted(r.path for r in rows.coalesce(8).mapInArrow(write, "path string").collect())


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, into: str = "found", block_bytes: int = 8 << 20) -> DataFrame:
    """docs with one more column, the struct FOUND: number of words, words inside phrases, ids of the items found, and merged spans of words to remove.

    Words are longest runs of letters, digits and bytes from 0x80 on, A-Z lower-cased.  Null and
    empty texts have no words and no hits; benchmark texts without words have no phrases; an item
    without an id counts as the id ''; repeated items or ids count once; repeated documents are
    judged one by one.  A text longer than a shard is a shard of its own, indexed whole (about 60
    bytes a word while it is built).  With an empty benchmark nothing is hit.  If docs has a column
    named as ``into``, underscores are added to the new column's name, which is always the last.
    """
    into = fresh(into, docs.columns)
    paths = write_phrases(benchmark, item_id, item_text, width, block_bytes)
    together = GROUP_BYTES if len(paths) > 1 else 1

    def find(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[pa.RecordBatch, Shard]] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            for path in paths:
                phrases = held(("phrases", path), lambda path=path: Phrases.read(path))
                for _, shard in waiting:
                    shard.search(phrases)
            for part, shard in waiting:
                yield pa.RecordBatch.from_arrays([*part.columns, shard.found()], names=[*part.schema.names, "a0"])

        for batch in batches:
            for part in slices(batch, batch.schema.names[at], SHARD_BYTES):
                waiting.append((part, Shard(part.column(at))))
                size += part.column(at).nbytes
                if size >= together:
                    yield from done()
                    waiting, size = [], 0
        yield from done()

    return with_arrow(docs, text_col, find, [T.StructField(into, FOUND)])
