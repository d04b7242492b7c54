"""The registered queries themselves, on a small folder of tables: against their SQL, and against brute force where there is none."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from brute import counts, order, sample_docs, words
from pyspark.sql import functions as F

from codeloom.llm import queries as llm
from codeloom.llm.quality_rules import MEASURES, learn_from, measure, statistics
from codeloom.llm.token_counts import counter
from codeloom.llm.token_shards import encoder

TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with ids of their own (copies, near copies, hot passages, null, empty, long texts), pages, items and labels."""
    d, r = str(tmp_path_factory.mktemp("small")), random.Random(21)
    texts = [t for _, t in sample_docs(n=220, seed=21, vocabulary=200, most=120)]
    texts += [" ".join(f"junk{i}x{k}###" for k in range(30)) for i in range(60)]
    texts += ["\n".join(r.choices(["a line", "another line", "the third", ""], k=40)), "x" * 30_000, "é ſ  \x0b字 " * 40, " ".join(r.choices([f"v{i}" for i in range(3000)], k=20_000))]
    docs = [(i, t, "en", r.choice(["web", "web", "web", "books", "é", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    bodies = ["<p>" + "é" * r.randrange(500, 900) for _ in range(5)] + ["short", "y" * 1000, "y" * 999, "", None]
    pages = [(i, r.choice(["http://www.A.org/x", "https://b.example.net/de/7?q=1&r#top", "http://www2.c.com:8080", "http://d.com:80/?", "e.org/p?x", "", None, f"https://m.f.org/{i}/"]), r.choice(bodies)) for i in range(150)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{d}/pages.parquet")
    items = [(i, " ".join(words(t)[3:18])) for i, t in enumerate(texts[:25])] + [(90, None), (91, "!?"), (92, "w5 w6")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, 0 if "junk" in (t or "") else 1, 0) for i, t in enumerate(texts) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return spark, d, [row[:2] for row in docs], docs


def _rows(records, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(r[i]) for i in at) for r in records)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(small, name):
    spark, d = small[:2]
    df = llm.queries()[name](spark, d)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    found = con.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns) and _rows(df.collect(), df.columns) == _rows(found.fetchall(), columns)


def _query(small, name):
    return llm.queries()[name](*small[:2]).collect()


def test_sharding(small):
    docs, got = small[2], _query(small, "op1_sharding")
    assert order((r.doc_id, r.size, r.text_crc32) for r in got) == order((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and {r.shard for r in got} <= {*range(16)}
    by_shard = {s: [r for r in got if r.shard == s] for s in range(16)}
    assert all(sorted(r.slot for r in rows) == [*range(len(rows))] for rows in by_shard.values())
    loads, most = [sum(r.size for r in rows) for rows in by_shard.values()], sum(r.size for r in got) / 16
    oversized = sum(r.size > most for r in got)  # such a text is a shard of its own
    assert sorted(loads)[15 - oversized] <= 1.3 * most
    homes, held = {}, {}
    for r in got:
        key = (r.text_crc32, r.size)
        homes.setdefault(key, set()).add(r.shard)
        held[key] = held.get(key, 0) + r.size
    assert max(held.values()) > 2000 and all(len(homes[k]) == 1 for k in homes if held[k] <= most)


def test_token_counts(small):
    model, got = counter("piece_bpe_32k.model").model, {r.doc_id: r for r in _query(small, "op5_token_counts")}
    assert len(got) == len(small[2])
    for i, t in small[2]:
        n = len(model.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    assert any(r.over_limit for r in got.values())


def _targets(sizes):
    """Targets by resharing the excess by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mixing(small):
    got, source = _query(small, "op6_mixing"), {row[0]: row[3] for row in small[3]}
    size = {i: len(words(t)) for i, t in small[2]}
    assert {r.doc_id: r.size for r in got} == size
    of = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    target = _targets(of)
    taken = dict.fromkeys(of, 0)
    for r in got:
        assert r.source_size == of[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]]) and 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(50, 0.02 * target[s]) for s in of)
    assert order(map(tuple, _query(small, "op6_mixing"))) == order(map(tuple, got))


def test_token_shards(small):
    tokenizer, at = encoder("byte_bpe_50k.json").tokenizer, 0
    got = {r.doc_id: r for r in _query(small, "op7_token_shards")}
    assert len(got) == len(small[2])
    for i, t in small[2]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got[i]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_quality_rules(small):
    """Base counts by plain Python; the verdict by the learned rules' own covers over plain measures."""
    spark, d = small[:2]
    got, text = {r.doc_id: r for r in _query(small, "op8_quality_rules")}, dict(small[2])
    assert got.keys() == text.keys()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rules = learn_from(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert rules
    values = {r.doc_id: r.asDict() for r in docs.withColumn("s", statistics(F.col("text"))).select("doc_id", *(measure(F.col("s"), m).alias(m) for m in MEASURES)).collect()}
    for i, t in text.items():
        n, chars, symbols, lines, repeated = counts(t)
        failed = n < 10 or 100 * repeated > 20 * n
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeated, failed)
        refused = any(rule.covers({m: np.array([values[i][m]], dtype=float) for m in MEASURES})[0] for rule in rules)
        assert r.kept == (not failed and not refused), t
    assert not any(got[i].kept for i, t in text.items() if "junk" in (t or "")) and any(r.kept for r in got.values())
