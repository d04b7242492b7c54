"""Similarity join, substring removal, decontamination and line chunks against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from brute import contaminated, groups, order, sample_docs, shingles, without_repeats, words
from pyspark.sql import functions as F

from codeloom.llm import blocks, jaccard, wordscan
from codeloom.llm.decontamination import find_contamination, write_phrases
from codeloom.llm.fm_index import FMIndex
from codeloom.llm.jaccard import drop_similar, prefix, similar_groups
from codeloom.llm.line_dedup import remove_repeated_chunks
from codeloom.llm.substring_dedup import COVERS, period_for, remove_repeats


@pytest.mark.parametrize("seed, width, percent", [(1, 3, 90), (2, 2, 60), (3, 5, 80)])
def test_similar_groups(make_docs, seed, width, percent):
    docs = sample_docs(seed=seed)
    got = [tuple(r) for r in similar_groups(make_docs(docs), width=width, percent=percent).collect()]
    assert order(got) == order(groups(docs, width, percent))


def test_similar_groups_in_small_blocks(make_docs, monkeypatch):
    """Many blocks and parts, and lists that are compared block by block."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(blocks, "PART_BYTES", 1000)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 3)
    docs = sample_docs(seed=5, vocabulary=12, most=30)
    got = [tuple(r) for r in similar_groups(make_docs(docs), width=2, percent=60).collect()]
    assert order(got) == order(groups(docs, 2, 60))


def test_prefixes_meet():
    """Any two sets as similar as asked share l shingles of their prefixes, for every l; and of what they post the smaller of their own."""
    r = random.Random(3)
    chosen = set()
    for _ in range(600):
        base = r.sample(range(1000), r.randrange(1, 40))
        a, b = (np.unique(np.array([x if r.random() > 0.08 else r.randrange(1000) for x in base], dtype=np.uint64)) for _ in range(2))
        count = {int(x): int(x) % 5 * r.choice((1, 40)) + 2 for x in (*a, *b)}
        common = len(set(a.tolist()) & set(b.tolist()))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        (ta, na, la), (tb, nb, lb) = (prefix(s, np.array([count[int(x)] for x in s]), 80) for s in (a, b))
        chosen |= {la, lb}
        for m in range(1, jaccard.LONGEST + 1):
            assert len({*ta[: na + m - 1].tolist()} & {*tb[: nb + m - 1].tolist()}) >= min(m, common)
        assert len({*ta[: na + la - 1].tolist()} & {*tb[: nb + lb - 1].tolist()}) >= min(la, lb)
    assert len(chosen) > 1


@pytest.mark.parametrize("percent", [1, 34, 50, 60, 66, 67, 80, 90, 100])
def test_prefixes_ask_for_no_more_than_pairs_share(percent):
    """Small sets, each size and overlap: those that link share as many prefix shingles as the larger l of the two asks."""
    for n in range(1, 12):
        for m in range(1, n + 1):
            for common in range(1, m + 1):
                if 100 * common < percent * (n + m - common):
                    continue
                a = np.arange(n, dtype=np.uint64)
                b = np.r_[a[:common], np.arange(100, 100 + m - common)].astype(np.uint64)
                (x, n_x, l_x), (y, n_y, l_y) = (prefix(s, np.full(len(s), 5), percent) for s in (a, b))
                most = max(l_x, l_y)
                assert len({*x[: n_x + most - 1].tolist()} & {*y[: n_y + most - 1].tolist()}) >= most, (n, m, common)


def test_candidates_share_enough(make_docs, monkeypatch):
    """What is compared in full: pairs whose prefixes of the larger l share that many shingles, fewer than the pairs that met in a list."""
    seen, real = [], jaccard.candidates

    def kept(met, nodes):
        found = real(met, nodes)
        seen.append(({tuple(sorted(r)) for r in met.collect()}, {tuple(sorted(r)) for r in found.collect()}, {r.node: r for r in nodes.collect()}))
        return found

    monkeypatch.setattr(jaccard, "candidates", kept)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 4)
    # long texts, so that the parities tell little: twins share 600 rare words, any others one
    docs = []
    for i in range(12):
        rare = [f"pair{min(i, j)}_{max(i, j)}" for j in range(12) if j // 2 != i // 2] + [f"twin{i // 2}_{k}" for k in range(600)]
        docs.append((i, " ".join([*rare, *(f"common{k}" for k in range(1400))])))
    got = [tuple(x) for x in similar_groups(make_docs(docs), width=1, percent=70).collect()]
    assert order(got) == order(groups(docs, 1, 70)) and [len({r[2] for r in got})] == [6]
    met, compared = set().union(*(m for m, _, _ in seen)), set().union(*(c for _, c, _ in seen))
    nodes = seen[-1][2]
    assert max(x.ell for x in nodes.values()) > 1 and all(len(x.tokens) <= x.base + jaccard.LONGEST - 1 for x in nodes.values())
    for a, b in met:
        x, y = nodes[a], nodes[b]
        most = max(x.ell, y.ell)
        shared = len({*x.tokens[: x.base + most - 1]} & {*y.tokens[: y.base + most - 1]})
        assert ((a, b) in compared) == (shared >= most)
    assert len(compared) < len(met)


@pytest.mark.parametrize("parts", [64, 1024, 4096, 131_072])
def test_what_a_block_sends_does_not_grow_with_the_parts(parts):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 200_000, dtype=np.uint64))
    sent = blocks.part_rows(7, keys, 48, blocks.levels(parts)[0], counts=np.ones(len(keys), dtype=np.uint32))
    assert sent.num_rows <= blocks.COARSE and sent.nbytes < 6 * len(keys)
    assert np.concatenate([blocks.unpack_sorted(x) for x in sent["keys"].to_pylist()]).tolist() == keys.tolist()


def test_finer_parts(make_docs, monkeypatch):
    """Two hops of the exchange give the same rows as one."""
    for name, value in (("BLOCK_BYTES", 4000), ("PART_BYTES", 1500), ("COARSE", 4), ("BUNDLE", 3)):
        monkeypatch.setattr(blocks, name, value)
    docs = sample_docs(seed=12, vocabulary=40)
    got = [tuple(r) for r in similar_groups(make_docs(docs), width=3, percent=80).collect()]
    assert order(got) == order(groups(docs, 3, 80))
    removed = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(make_docs(docs), width=12).collect()]
    assert order(removed) == order(without_repeats(docs, 12))




def test_drop_similar(make_docs):
    docs = sample_docs(seed=7)
    df = make_docs(docs)
    got = drop_similar(df, width=3, percent=80)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept))
    group = dict(zip(docs, groups(docs, 3, 80, numbers=True), strict=True))
    linked = {k for k in group if shingles(k[1], 3)}
    assert sorted(group[k] for k in kept if k in linked) == sorted({group[k] for k in linked})
    assert {k for k in kept if k not in linked} == group.keys() - linked


@pytest.mark.parametrize("seed, width", [(1, 20), (2, 5), (3, 12)])
def test_remove_repeats(make_docs, seed, width):
    docs = sample_docs(seed=seed, vocabulary=15 if width < 10 else 60)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(make_docs(docs), width=width).collect()]
    assert order(got) == order(without_repeats(docs, width))


def test_remove_repeats_in_small_blocks_with_spans(make_docs, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(blocks, "PART_BYTES", 700)
    docs = sample_docs(seed=9)
    got = remove_repeats(make_docs(docs), width=10, spans=True).collect()
    assert order((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == order(without_repeats(docs, 10))
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_covers():
    for p, cover in COVERS.items():
        assert {(a - b) % p for a in cover for b in cover} == set(range(p))
    assert period_for(20) == 13 and period_for(50) == 31 and period_for(2) == 1


@pytest.mark.parametrize("seed, width", [(1, 10), (2, 4)])
def test_contamination(spark, make_docs, seed, width):
    docs = sample_docs(seed=seed, vocabulary=12)
    items = [(i, " ".join(words(t)[:14])) for i, (_, t) in enumerate(docs[:25])] + [(7, "again W5 w6"), (None, "w1 w2"), (90, None), (91, "!?"), (92, docs[3][1]), (92, docs[3][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(make_docs(docs), benchmark, width=width)
    assert found.columns[-1] == "found_" and found.columns[:-1] == make_docs([]).columns
    got = [(r.doc_id, r["found_"].n_words, r["found_"].n_hit, list(r["found_"]["items"]), [tuple(s) for s in r["found_"].spans]) for r in found.collect()]
    assert order(got) == order(contaminated(docs, items, width))


def test_contamination_by_several_blocks(spark, make_docs):
    """Blocks of phrases of a few items each, more shards than one, and a column whose name has a dot."""
    docs = sample_docs(seed=3, vocabulary=12)
    items = [(i, " ".join(words(t)[:14])) for i, (_, t) in enumerate(docs[:25])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    found = find_contamination(make_docs(docs).withColumnRenamed("found", "meta.lang"), benchmark, width=5, block_bytes=500)
    assert "meta.lang" in found.columns
    got = [(r.doc_id, r["found"].n_words, r["found"].n_hit, list(r["found"]["items"]), [tuple(s) for s in r["found"].spans]) for r in found.collect()]
    assert order(got) == order(contaminated(docs, items, 5))
    assert len(write_phrases(benchmark, "item_id", "text", 5, 500)) >= 3


def test_long_texts(spark, make_docs):
    """A text of a million words, and a word of a million characters."""
    r = random.Random(1)
    long = " ".join(r.choices([f"w{i}" for i in range(5000)], k=1_000_000))
    docs = [(1, long), (2, "x" * 1_000_000), (3, " ".join(long.split(" ")[500_000:500_030]))]
    benchmark = spark.createDataFrame([(7, docs[2][1])], "item_id long, text string")
    got = {x.doc_id: x["found_"] for x in find_contamination(make_docs(docs), benchmark).collect()}
    assert [(got[i].n_words, got[i].n_hit) for i in (1, 2, 3)] == [(1_000_000, 30), (1, 0), (30, 30)]
    removed = {x.doc_id: (x.n_words, x.n_removed) for x in remove_repeats(make_docs(docs), width=20).collect()}
    assert removed == {1: (1_000_000, 0), 2: (1, 0), 3: (30, 30)}


def test_contamination_without_rows(spark, make_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(make_docs([(1, "a b"), (2, None)]), nothing).select("found_.n_hit").distinct().collect() == [(0,)]
    assert find_contamination(make_docs([]), nothing).count() == 0


def test_fm_index():
    import random

    import numpy as np

    r = random.Random(2)
    for _ in range(40):
        runs = [[r.randrange(1, 5) for _ in range(r.randrange(1, 60))] for _ in range(r.randrange(1, 6))]
        symbols = np.array([x for run in runs for x in (*run, 0)])
        index = FMIndex(symbols, 6)
        patterns = np.array([[r.randrange(1, 6) for _ in range(3)] for _ in range(30)])
        low, high = index.search(patterns, np.full(30, 3))
        for p, a, b in zip(patterns, low, high, strict=True):
            expected = [i for i in range(len(symbols) - 2) if (symbols[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected if b > a else not expected


def test_wordscan():
    import pyarrow as pa

    texts = [t for _, t in sample_docs(seed=4)]
    scanned = wordscan.scan(pa.array(texts), wordscan.NOT_BLANK, False)
    flat = [w for t in texts for w in words(t)]
    assert [bytes(scanned.data[a:b]).decode() for a, b in zip(scanned.start, scanned.end, strict=True)] == flat
    assert scanned.counts.tolist() == [len(words(t)) for t in texts]
    assert len(set(scanned.hashes.tolist())) == len(set(flat)) and len({(h, w) for h, w in zip(scanned.hashes.tolist(), flat, strict=True)}) == len(set(flat))
    windows = wordscan.window_hashes(scanned.hashes, 4)
    pairs = {(int(h), tuple(flat[i : i + 4])) for i, h in enumerate(windows)}
    assert len(pairs) == len({h for h, _ in pairs}) == len({w for _, w in pairs})


def test_line_chunks(make_docs):
    docs = [(d, t.replace(" w", "\nw")) if t and i % 2 else (d, t) for i, (d, t) in enumerate(sample_docs(seed=6))]
    docs = [x for x in docs if x[0] is not None and x[0] >= 1000] + [(i, t) for i, (d, t) in enumerate(docs) if d is not None and d < 1000]
    from codeloom.llm.q02_line_dedup import SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    expected = {(r[0], r[1], r[2], r[3]) for r in con.execute(SQL).fetchall()}
    got = remove_repeated_chunks(make_docs(docs))
    assert got.columns[-1] == "deduped_"
    rows = {(r.doc_id, r["deduped_"].n_lines, r["deduped_"].n_removed, hashlib.sha256(r["deduped_"].text.encode()).hexdigest()) for r in got.collect()}
    assert rows == expected and any(r[2] for r in rows)


def test_line_chunks_of_odd_rows(make_docs):
    same = "a\nb\nc\nd\ne\nf\ng\nh\ni\nj"
    docs = [(None, same), (None, same), (1, same), (2, None), (3, ""), (4, "\n" * 50), (5, "x\n" * 5000)]
    got = remove_repeated_chunks(make_docs(docs))
    rows = {(r.doc_id, r["deduped_"].n_lines): r["deduped_"] for r in got.collect()}
    assert got.count() == 7 and rows[(None, 10)].n_removed == 0 and rows[(1, 10)].n_removed > 0 and rows[(2, 1)].text == ""
    assert remove_repeated_chunks(make_docs([])).count() == 0


def test_line_chunks_of_two_lines_at_least(make_docs):
    """The cut in plain Python; and of passages behind other lines it finds more than a cut with longer roll and chunks."""
    r = random.Random(4)
    docs = [(i, "\n".join(r.choices("abcdefgh", k=r.randrange(1, 40)))) for i in range(150)] + [(200, "a"), (201, "a\nb"), (202, "a\nb"), (203, "a\nb\nc"), (204, None), (205, "x\n" * 3000)]
    passages = ["\n".join(f"{p} {k}" for k in range(10)) for p in range(30)]
    docs += [(300 + i, f"before {i}\n{passages[i % 30]}\nbehind {i}") for i in range(60)]
    first, expected = set(), {}
    for d, text in docs:
        lines = (text or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        ends, start = [], 0
        for i in range(len(lines) - 1):
            if ((h[i - 1] if i else 0) * 31 + h[i]) % 1_000_003 % 2 == 0 and i - start >= 1 and i < len(lines) - 2:
                ends.append(i)
                start = i + 1
        kept, start = [], 0
        for e in [*ends, len(lines) - 1]:
            chunk = tuple(lines[start : e + 1])
            if len(chunk) == 1 or chunk not in first:
                kept += chunk
            first.add(chunk)
            start = e + 1
        expected[d] = "\n".join(kept)
    got = remove_repeated_chunks(make_docs(docs))
    rows = {r.doc_id: r["deduped_"] for r in got.collect()}
    assert {d: r.text for d, r in rows.items()} == expected
    coarse = {r.doc_id: r["deduped_"].n_removed for r in remove_repeated_chunks(make_docs(docs), average=4, roll=3, least=1).collect()}
    again = range(330, 360)
    assert sum(rows[d].n_removed for d in again) > sum(coarse[d] for d in again)
    with pytest.raises(ValueError):
        remove_repeated_chunks(make_docs(docs), least=3)


def test_empty_tables(make_docs):
    empty = make_docs([])
    assert similar_groups(empty).count() == 0 and drop_similar(empty).count() == 0 and remove_repeats(empty).count() == 0


def test_digests_of_nothing(make_docs):
    got = {r.doc_id: r for r in remove_repeats(make_docs([(1, None), (2, ""), (3, " \n ")]), width=20).withColumn("h", F.sha2("kept", 256)).collect()}
    assert all(r.h == hashlib.sha256(b"").hexdigest() and r.n_words == 0 for r in got.values())
