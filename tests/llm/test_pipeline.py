"""The pipeline's stages against brute force, and its queries as they are registered."""

import numpy as np
from brute import contaminated, counts, groups, order, sample_docs, words

import corpus_pipeline
from codeloom.llm.mixing import mix_sources
from codeloom.llm.quality_rules import learn_from
from codeloom.llm.token_shards import encoder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _input(spark, tmp_path):
    docs = [(d, t) for d, t in sample_docs(n=150, seed=11, vocabulary=300, most=120)]
    docs += [(7000 + i, " ".join(f"junk{i}x{k}###" for k in range(30))) for i in range(40)]
    rows = [(d, t, "en", f"s{(d or 0) % 4}", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(d, 0 if d >= 7000 else 1, 0) for d, _ in docs if d is not None and d not in (2000, 2001)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(i, " ".join(words(t)[3:18])) for i, (_, t) in enumerate(docs[:12])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return items


def test_stages(spark, tmp_path):
    items = _input(spark, tmp_path)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        before, rows = [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]
        if name != "token_shards":
            assert out.columns == COLUMNS
            path = f"{d}/{name}"
            out.write.parquet(path)
        if name == "quality_rules":
            rules = learn_from(docs, spark.read.parquet(f"{d}/labels.parquet"))
            assert rules
            good = [r for r in before if counts(r[1])[0] >= 10 and 100 * counts(r[1])[4] <= 20 * counts(r[1])[0] and (r[0] is None or r[0] < 7000)]
            assert order(rows) == order(good)
        elif name == "jaccard_join":
            pairs = [r[:2] for r in before]
            number = dict(zip(pairs, groups(pairs, 5, 80, numbers=True), strict=True))
            assert sorted(number[r[:2]] for r in rows) == sorted(set(number.values())) and len(rows) < len(before)
        elif name == "decontamination":
            found = contaminated([r[:2] for r in before], items, 10)
            assert any(f[2] for f in found) and order(rows) == order(r for r, f in zip(before, found, strict=True) if not f[2])
        elif name == "mixing":
            taken = mix_sources(docs).collect()
            assert sum(r.copies for r in taken) == len(rows) and {*rows} <= {*before}
            copies = {r.doc_id: r.copies for r in taken}
            assert order(r for r in rows if r[0] is not None) == order(r for r in before if r[0] is not None for _ in range(copies[r[0]]))
        else:
            tokenizer = encoder("byte_bpe_50k.json").tokenizer
            assert sorted((r[0], r[2]) for r in rows) == sorted((r[0], len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1) for r in before)
            starts = sorted((r[1], r[2]) for r in rows)
            assert [s for s, _ in starts] == np.cumsum([0, *(n for _, n in starts[:-1])]).tolist()
        seen.append(name)
        if name != "token_shards":
            docs = spark.read.parquet(path)
    assert len(seen) == 5
    assert order(map(tuple, corpus_pipeline.run(spark, d).collect())) == order(rows)


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
