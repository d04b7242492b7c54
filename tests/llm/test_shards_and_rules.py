"""Sharding, quality rules, archives."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from brute import counts, sample_docs
from pyspark.sql import functions as F

from codeloom.llm import warc
from codeloom.llm.loser_tree import LoserTree
from codeloom.llm.quality_rules import base_failed, judge, learn_from, learn_rules, rejected, statistics
from codeloom.llm.sharding import assign_shards, write_shards


def check_shards(rows, docs, shards, near):
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    loads, slots, homes = [0] * shards, {}, {}
    for r in rows:
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads) - min(loads) <= near
    return homes


def test_shards(make_docs):
    docs = sample_docs(n=400, seed=2, most=40)
    docs = [x for x in docs if x[0] != 2006]
    got = assign_shards(make_docs(docs), 4).collect()
    total = sum(r.size for r in got)
    homes = check_shards(got, docs, 4, near=0.02 * total / 4 + 2 * max(r.size for r in got))
    group = {}
    for r in got:
        group[(r.text_crc32, r.size)] = group.get((r.text_crc32, r.size), 0) + r.size
    assert all(len(h) == 1 for k, h in homes.items() if group[k] <= total / 4)


def test_shards_of_one_large_group(make_docs):
    r = random.Random(1)
    docs = [(i, "the same text for a third of all") for i in range(1000)] + [(1000 + i, "".join(r.choices("abcdefgh ", k=r.randrange(20, 60)))) for i in range(2000)]
    got = assign_shards(make_docs(docs), 16).collect()
    homes = check_shards(got, docs, 16, near=250)
    assert sum(len(h) > 1 for h in homes.values()) == 1


def test_shards_of_few_or_no_rows(make_docs):
    assert assign_shards(make_docs([]), 16).count() == 0
    for docs in ([(1, None)], [(None, None), (None, ""), (1, "a"), (1, "a")], [(1, "x" * 5000)] * 3):
        check_shards(assign_shards(make_docs(docs), 16).collect(), docs, 16, near=max(len(t or "") + 1 for _, t in docs) * len(docs))


def test_written_shards(spark, make_docs, tmp_path):
    docs = sample_docs(seed=5)
    write_shards(make_docs(docs), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(docs) and "shard_" in back.columns
    assert back.groupBy("text").agg(F.countDistinct("shard_").alias("n")).filter("n > 1 and text is not null").count() <= 1


def test_statistics(make_docs):
    docs = sample_docs(seed=8, vocabulary=9) + [(3000, "a b c d e " * 40), (3001, "#*$ %&| <>\n#*$ %&| <>"), (3002, "é\x0bb\x0cc\rd"), (3003, "x\n\nx\n \nx")]
    df = make_docs(docs)
    for r in df.select("text", statistics(F.col("text")).alias("s")).collect():
        s = r.s
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == counts(r.text), r.text
    judged = judge(df, [])
    assert judged.columns == [*df.columns, "quality_"]
    for r in judged.collect():
        n, repeat = counts(r.text)[0], counts(r.text)[4]
        q = r["quality_"]
        assert q.base_failed == (n < 10 or 100 * repeat > 20 * n) and q.kept == (not q.base_failed)


def test_learned_rules():
    r = np.random.default_rng(3)
    n = 3000
    values = {"words": r.integers(10, 500, n).astype(float), "symbols_a_word": r.random(n), "upper_case": r.random(n), "digits": r.random(n)}
    bad = (values["symbols_a_word"] > 0.8) | ((values["upper_case"] > 0.7) & (values["words"] < 100))
    rules = learn_rules(values, bad)
    found = np.logical_or.reduce([rule.covers(values) for rule in rules])
    assert 2 <= len(rules) <= 12 and (found & bad).sum() > 0.95 * bad.sum() and (found & ~bad).sum() < 0.01 * n
    noise = r.random(n) < 0.3
    assert all(rule.covers(values)[~noise].sum() < 100 for rule in learn_rules(values, noise))
    assert learn_rules(values, np.zeros(n, dtype=bool)) == [] and learn_rules(values, np.ones(n, dtype=bool)) == []


def test_rules_need_support_where_they_were_not_grown():
    values, bad = {"words": np.arange(90.0)}, np.isin(np.arange(90), (30, 31, 33, 34))  # none in the third held out
    assert learn_rules({"words": np.where(bad, 500, values["words"])}, bad) == []
    assert len(learn_rules(values, values["words"] >= 61)) == 1


def test_rules_as_expressions_and_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    rules = learn_from(docs, labels.filter("doc_id % 2 = 0"))
    s = docs.join(labels.filter("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("y")), "doc_id").withColumn("s", statistics(F.col("text")))
    rows = s.select("y", base_failed(F.col("s")).alias("b"), rejected(F.col("s"), rules).isNotNull().alias("r")).collect()
    good, bad = [x for x in rows if x.y == 1 and not x.b], [x for x in rows if x.y == 0 and not x.b]
    assert sum(x.r for x in good) <= 0.01 * len(good) and sum(x.r for x in bad) >= 0.9 * len(bad)


def test_no_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert learn_from(make_docs(sample_docs()), none) == []
    null = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert learn_from(make_docs(sample_docs()), null) == []


def test_loser_tree():
    r = random.Random(1)
    for _ in range(300):
        runs = [sorted((r.randrange(20),) for _ in range(r.randrange(0, 8))) for _ in range(r.randrange(0, 9))]
        assert list(LoserTree(runs)) == sorted(sum(runs, []))
    tied = [[(1, "a"), (2, "a")], [(1, "b")]]
    assert list(LoserTree([[(k, i, v) for k, v in run] for i, run in enumerate(tied)])) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "a")]


@pytest.mark.parametrize("small", [False, True])
def test_archives(spark, monkeypatch, small):
    if small:
        for name, value in (("RUN_ENTRIES", 7), ("FAN_IN", 3), ("RANGE_ENTRIES", 10), ("SAMPLES", 2), ("BLOCK_ENTRIES", 3), ("ARCHIVE_BYTES", 3000)):
            monkeypatch.setattr(warc, name, value)
    r = random.Random(4)
    long = ["<p>" + "é" * r.randrange(500, 900) for _ in range(6)]
    rows = [(i, f"http://www.Site{r.randrange(4)}.org/p/{r.randrange(9)}?q={r.randrange(3)}", r.choice([*long, "short", "é" * 499, None, "", "y" * 1000])) for i in range(90)]
    rows += [(500, None, long[0]), (None, "http://x.org/", long[0]), (501, "not a url", "z" * 3000), (10, "http://again.org", long[1]), (502, "http://a.org/\r\nX: 1", "b"), *[(600 + i, "http://hot.org/", "hot") for i in range(60)]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("refers_to", F.lit(2)).repartition(5)
    got = warc.capture_history(pages).orderBy("part").collect()
    data = [(i, (h or "").encode()) for i, _, h in rows]
    last = {}
    for i, b in data:
        if len(b) >= 1000 and i is not None:
            last[b] = max(last.get(b, i), i)
    expected = []
    for i, b in data:
        to = last[b] if len(b) >= 1000 and i is not None and last[b] != i else None
        expected.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted(map(str, expected)) == sorted(str((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to)) for x in got)
    keys = [(x.part, x.url_key, x.timestamp, x.archive, x.offset) for x in got]
    bare = sorted((k[1:] for k in keys))
    by_part = {}
    for k in keys:
        by_part.setdefault(k[0], []).append(k[1:])
    assert [k for p in sorted(by_part) for k in by_part[p]] == bare
    assert not small or (len(by_part) > 3 and max(map(len, by_part.values())) < 60)
    assert warc.capture_history(pages.limit(0)).count() == 0


def test_captures_by_time(spark):
    """Captures of one page come by their time column; a revisit tells its response's time."""
    rows = [(i, "http://a.org/", "z" * 2000, f"2024-03-{1 + i * 3 % 28:02d} 10:00:00") for i in range(20)] + [(99, "http://a.org/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `seen.at` string").repartition(3)
    got = warc.capture_history(pages, time_col="seen.at").orderBy("part").collect()
    assert [r.page_id for r in got if r.page_id != 99] == [r[0] for r in sorted(rows[:20], key=lambda r: (r[3], r[0]))]
    assert [r.timestamp for r in got if r.page_id == 99] == [warc.timestamp_of(99)]


def test_records_by_themselves():
    out = io.BytesIO()
    w = warc.ArchiveWriter(out)
    w.add(1, "http://a.b/c", b"payload", None)
    w.add(2, None, b"", None)
    w.add(3, "http://a.b/d", b"payload" * 200, 9)
    records = list(warc.read_archive(io.BytesIO(out.getvalue())))
    assert [x["payload"] for x in records] == [b"payload", b"", None] and records[2]["head"]["warc-payload-length"] == "1400"
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(out.getvalue()[:-5])))
    assert warc.url_key("https://www.Example.org:8080/A?b=C") == "org,example:8080)/a?b=c" and warc.url_key(None) == "" and warc.url_key("http://x.org") == "org,x)/"
