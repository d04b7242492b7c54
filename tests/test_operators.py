"""Operators over small tables against plain Python, and streams against tables."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from codeloom.functions import codec, codes, compare, native, sketches, text
from codeloom.functions.columns import Functions, register
from codeloom.operators import coded, duplicates, folds, similarity
from codeloom.plans import queries
from codeloom.sources import files
from codeloom.streaming import blocks as sb
from codeloom.streaming import events as ev

STRINGS = ["", "a", " a b\n c ", "Hello  World", "é" * 40, "a💩b", "﻿x ", "data: x", None, "tab\tline\rend "]


@pytest.fixture(scope="module")
def strings(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(STRINGS)], "i int, s string")


def test_native_text(strings):
    rows = strings.select(
        "s",
        native.remove_newlines("s").alias("line"),
        native.trim("s", 9).alias("cut"),
        native.utf16_length("s").alias("units"),
        native.sliding_window("s", 3).alias("grams"),
        native.chunk_string("s", 3).alias("pieces"),
        native.b64url_encode("s").alias("b64"),
        native.b64url_decode(native.b64url_encode("s")).alias("back"),
        native.data_url_payload(native.data_url("s")).alias("payload"),
        native.base32(F.encode("s", "UTF-8")).alias("b32"),
        native.cid(F.encode("s", "UTF-8")).alias("cid"),
    ).collect()
    for r in rows:
        if r.s is None:
            assert r.line is None and r.cut is None and r.cid is None
            continue
        assert r.line == text.remove_newlines(r.s) and r.cut == text.trim(r.s, 9) and r.units == text.utf16_length(r.s)
        assert r.grams == text.sliding_window(r.s, 3) and r.pieces == text.chunk_string(r.s, 3)
        assert r.b64 == text.b64url_encode(r.s) and r.back == r.s == r.payload
        assert r.b32 == codec.base32(r.s.encode()) and r.cid == compare.cid(r.s.encode())


def test_native_codes(spark):
    r = random.Random(4)
    rows = [(i, r.randbytes(32), r.randbytes(32), r.randrange(1 << 52), r.randrange(4096)) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, a binary, b binary, t long, hub int")
    got = df.select(
        "i",
        *(native.unit_code(3, 0, 0, bits, "a").alias(f"u{bits}") for bits in (32, 64, 96, 256)),
        native.hamming(native.words64("a", 256), native.words64("b", 256)).alias("d"),
        native.similarity(native.words64("a", 256), native.words64("b", 256), 256).alias("s"),
        native.time_id("t", F.col("hub"), 1).alias("id"),
        native.base32hex("a").alias("hex32"),
        native.cid_from_digest(native.cid_digest(native.cid("a"))).alias("cid"),
    ).collect()
    for g, (_, a, b, t, hub) in zip(got, rows, strict=True):
        for bits in (32, 64, 96, 256):
            assert g[f"u{bits}"] == "ISCC:" + codec.unit(3, 0, 0, bits, a)
        assert g.d == compare.hamming(a, b) and g.s == (256 - g.d) * 100 // 256 and g.hex32 == codec.base32hex(a)
        assert g.id == codes.time_id(t, hub, 1)["code"] and g.cid == compare.cid(a)
    shapes = spark.createDataFrame([("ISCC:KACYPXW445FTYNJ3",), ("iscc: AA-AA",), ("x:y:z",), ("http:x",), ("uAb-c",)], "c string")
    assert [tuple(x) for x in shapes.select(native.clean_code("c"), native.has_code_shape("c")).collect()] == [("KACYPXW445FTYNJ3", True), ("AAAA", False), (None, False), (None, False), ("uAb-c", False)]


def test_arrow_functions(spark, strings):
    f = Functions(errors="null")
    got = strings.select("s", f.text_code("s").alias("t"), f.meta_code("s").alias("m"), f.instance_code(F.encode("s", "UTF-8")).alias("x"), f.text_collapse("s").alias("c"), f.is_json("s").alias("j")).collect()
    for r in got:
        if r.s is None:
            assert r.c is None
            continue
        assert r.t.code == codes.text_code(r.s)["code"] and r.c == text.collapse(r.s) and r.j is False
        assert r.x.datahash == codes.instance_code(r.s.encode())["datahash"]
        assert (r.m.code is None) == (not text.remove_newlines(text.clean(r.s)))
    names = register(spark)
    assert "loom_text_code" in names
    assert spark.sql("SELECT loom_text_code('Hello World') AS c, loom_code_distance('ISCC:EAASKDNZNYGUUF5A', 'ISCC:EAASKDNZNYGUUF5A') AS d").first() == ("ISCC:EAASKDNZNYGUUF5A", 0)
    full = "ISCC:KACYPXW445FTYNJ3CYSXHAFJMA2HUWULUNRFE3BLHRSCXYH2M5AEGQY"
    one = spark.createDataFrame([(full, "nonsense")], "a string, b string").select(f.code_inspect("a").alias("i"), f.code_compare("a", "a").alias("c"), f.code_normalize("b").alias("n"), f.code_decompose("a").alias("u")).first()
    assert one.i.type_id == "ISCC-TEXT-V0-MCDI" and one.c.instance_match and one.c.semantic_dist is None and one.n is None and len(one.u) == 4


def test_table_functions(spark):
    from codeloom.functions.tables import register_tables

    assert register_tables(spark) == ["loom_chunks", "loom_units", "loom_windows", "loom_buckets"]
    full = "ISCC:KACYPXW445FTYNJ3CYSXHAFJMA2HUWULUNRFE3BLHRSCXYH2M5AEGQY"
    assert [r.unit for r in spark.sql(f"SELECT * FROM loom_units('{full}') ORDER BY no").collect()] == codec.decompose(full)
    assert [r.gram for r in spark.sql("SELECT gram FROM loom_windows('abcd', 3) ORDER BY no").collect()] == ["abc", "bcd"]
    rows = spark.sql("SELECT i, c.* FROM VALUES (1, CAST(repeat('xyz', 2000) AS BINARY)) AS t(i, d), LATERAL loom_chunks(d) c ORDER BY no").collect()
    assert sum(r.size for r in rows) == 6000 and rows[0].offset == 0
    assert [(r.bucket, r.value) for r in spark.sql("SELECT * FROM loom_buckets(array(1L, 2L, 3L), 2) ORDER BY bucket, no").collect()] == [(0, 1), (0, 2), (1, 3)]


def test_folds(spark):
    r = random.Random(3)
    rows = [(r.randrange(6), i, r.randrange(-(1 << 31), 1 << 31)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i int, x long")
    by = {}
    for k, _, x in rows:
        by.setdefault(k, []).append(x)
    assert {g.k: bytes(g.digest) for g in folds.audio_digest_by(df, "k", "i", "x").collect()} == {k: codes.soft_hash_audio(v, 256) for k, v in by.items()}
    assert {g.k: bytes(g.digest) for g in folds.simhash_by(df, "k", ["x"]).collect()} == {k: sketches.simhash([(x & (1 << 64) - 1).to_bytes(8, "big") for x in v]) for k, v in by.items()}
    odd = spark.createDataFrame([(1, 5, 7), (1, None, 3), (None, 5, 8), (2, -1, None), (3, -1, 0), (None, 4, 8)], "k int, x long, y int")
    assert {g.k: bytes(g.digest).hex() for g in folds.simhash_by(odd, "k", ["x", "y"]).collect()} == {1: f"{5:016x}{7:016x}", None: f"{5:016x}{8:016x}", 3: "f" * 16 + "0" * 16}
    assert folds.simhash_by(odd.limit(0), "k", ["x"]).count() == 0
    least = folds.minhash_by(df.withColumn("x", F.abs("x")), "k", "x")
    assert {g.k: bytes(g.d) for g in least.select("k", folds.pack_minhash("minhash").alias("d")).collect()} == {k: sketches.minhash_256([abs(x) for x in v]) for k, v in by.items()}
    frames = [(k, [r.randrange(100) for _ in range(380)]) for k in (1, 1, 2)]
    frames.append(frames[0])
    got = folds.frame_code_by(spark.createDataFrame(frames, "k int, f array<int>"), "k", "f", 256)
    assert {g.k: g.code for g in got.collect()} == {k: codes.video_code([f for q, f in frames if q == k], 256)["code"] for k in (1, 2)}
    texts = [(i % 3, codes.text_code(f"some text {i}")["code"]) for i in range(12)]
    mixed = folds.mixed_code_by(spark.createDataFrame(texts, "k int, c string"), "k", "c")
    assert {g.k: g.code for g in mixed.collect()} == {k: codes.mixed_code([c for q, c in texts if q == k])["code"] for k in range(3)}
    units = [(1, u) for u in ("GAAQQICFKJYKY4KU", "IADWIK7A7JTUAQ2D6QARX7OBEIK3OOUAM42LOBLCZ4ZOGDLRHMDL6TQ")]
    assert folds.compose_by(spark.createDataFrame(units, "k int, c string"), "k", "c").first().code == "ISCC:KUAAQICFKJYKY4KUMQV6B6THIBBUG"


@pytest.mark.parametrize("k", [0, 1, 3, 7])
def test_similar_words(spark, k):
    r = random.Random(k)
    base = [r.randrange(-(1 << 63), 1 << 63) for _ in range(20)]
    words = base + [w ^ sum(1 << b for b in r.sample(range(63), r.randrange(0, 9))) for w in base for _ in range(6)] + base[:5]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w long")
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    distinct = sorted(set(words))
    expected = {(a, b, apart(a, b)) for a in distinct for b in distinct if a < b and apart(a, b) <= k}
    assert {tuple(p) for p in similarity.similar_words(df, "w", k).collect()} == expected
    rows = {x.i: x for x in similarity.similar_rows(df, "i", "w", k).collect()}
    for i, w in enumerate(words):
        copies, near = words.count(w) - 1, sum(1 for v in words if v != w and apart(v, w) <= k)
        assert (i in rows) == bool(copies or near) and (i not in rows or (rows[i].copies, rows[i].near) == (copies, near))


def test_duplicates(spark, strings):
    two = strings.union(strings.select(F.col("i") + 100, "s"))
    marked = {r.i: r.duplicate_of for r in duplicates.mark_duplicates(two, "i", "s").collect()}
    assert all(marked[i] is None and marked[i + 100] == (i if s is not None else None) for i, s in enumerate(STRINGS))
    assert duplicates.unknown_content(two, strings.filter("i > 2"), "s", "s").count() == 8
    assert duplicates.known_content(two, strings.filter("i > 2"), "s", "s").count() == 12


def test_units_and_chunks(spark):
    docs = spark.createDataFrame([(1, "a name", "some text " * 400), (2, "b name", "x")], "i int, n string, t string")
    both = coded.with_asset_code(docs, "n", "t")
    rows = {(r.i, r.main) for r in coded.units(both, "i", "asset_code").collect()}
    assert rows == {(i, m) for i in (1, 2) for m in (0, 2, 3, 4)}
    data = docs.select("i", F.encode("t", "UTF-8").alias("d"))
    for r in coded.chunks(data, "i", "d").groupBy("i").agg(F.sum("size").alias("n"), F.max(F.col("offset") + F.col("size")).alias("end")).collect():
        assert r.n == r.end == {1: 4000, 2: 1}[r.i]


def test_asset_codes_of_whole_first_lines_and_null_texts(spark, tmp_path):
    line = "short words only " * 5  # 85 characters
    docs = [(1, "web", "en", f"{line}one two\nsame"), (2, "web", "en", f"{line}other ending\nsame"), (3, "web", "en", None)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.asset_codes(spark, str(tmp_path))
    codes = {r.doc_id: r.asset_code for r in got.collect()}
    assert codes.keys() == {1, 2, 3} and codes[3] is None
    units = {(r.doc_id, r.main): r.body for r in coded.units(got.filter("asset_code is not null"), "doc_id", "asset_code").collect()}
    assert units[1, 0] != units[2, 0]


def test_blocks_in_batches_and_streams(spark, tmp_path):
    assets = [(i, bytes((i * k) % 251 for k in range(n))) for i, n in enumerate((0, 1, 5000, 20_000))]
    df = spark.createDataFrame(assets, "i int, d binary")
    parts = files.blocks(df, "i", "d", 1500)
    expected = {i: ("ISCC:" + codes.DataHasher(d).code() if d else codes.data_code(d)["code"], codes.instance_code(d)["code"], len(d)) for i, d in assets}
    assert {r.i: (r.code_data, r.code_instance, r.filesize) for r in sb.batch_codes(parts, "i").collect()} == expected
    rows = parts.collect()
    random.Random(2).shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k::3], parts.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sb.stream_codes(stream, "i").writeStream.format("memory").queryName("coded_assets").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {r.i: (r.code_data, r.code_instance, r.filesize) for r in spark.table("coded_assets").collect()} == expected


def test_event_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3) for i in range(60)] + [(0, "2024-01-01 00:00:00", 0)]
    events = spark.createDataFrame(rows, "id int, at string, kind int").withColumn("ts", F.to_timestamp("at"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ev.first_seen(stream, "ts", ["id"], "2 hours").writeStream.format("memory").queryName("first_events").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("first_events").count() == 60
    assert ev.tumbling_counts(events, "ts", "kind", "30 minutes").agg(F.sum("n")).first()[0] == 61
    assert ev.sliding_counts(events, "ts", "kind", "30 minutes", "15 minutes").agg(F.sum("n")).first()[0] == 122
    assert ev.sessions(events, "ts", "kind", "10 minutes").count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert files.binary_files(spark, str(tmp_path), "*.bin").first().content == b"abc"
    records = {"gen_text_code": {"test_1": {"inputs": ["Hello World", 64], "outputs": {"iscc": "ISCC:EAASKDNZNYGUUF5A"}}}}
    (tmp_path / "g.json").write_text(json.dumps(records))
    r = files.golden_records(spark, str(tmp_path / "g.json")).first()
    assert codes.text_code(*map(files.golden_value, json.loads(r.inputs)))["code"] == json.loads(r.outputs)["iscc"]
    assert files.golden_value("stream:00ff") == b"\x00\xff"
    rgb = bytes([255, 255, 255] * 64 * 64)
    assert spark.createDataFrame([(rgb, 64, 64)], "d binary, w int, h int").select(files.grey_pixels("d", "w", "h").alias("p")).first().p == [255.0] * 1024


def test_queries_match_sql(spark):
    """Every query with SQL gives the same rows as DuckDB on the smallest tables."""
    from codeloom.plans.queries import QUERIES
    from codeloom.plans.sql import ORACLES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")

    def rows(records, columns):
        at = sorted(range(len(columns)), key=columns.__getitem__)
        return sorted(tuple(str(r[i]) for i in at) for r in records)

    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, d)
        cur = con.execute(sql)
        assert rows(df.collect(), df.columns) == rows(cur.fetchall(), [c[0] for c in cur.description]), name


def test_blocks_that_are_missing(spark):
    from codeloom.streaming.blocks import batch_codes

    rows = [("whole", 0, b"ab", False), ("whole", 1, b"c", True), ("whole", 1, b"c", True), ("no end", 0, b"ab", False), ("no middle", 0, b"ab", False), ("no middle", 2, b"c", True)]
    got = {r.k: r.datahash for r in batch_codes(spark.createDataFrame(rows, "k string, seq int, block binary, last boolean"), "k").collect()}
    assert len(got) == 3 and got["no end"] is None and got["no middle"] is None and got["whole"]


def test_columns_that_helpers_might_use(spark):
    from codeloom.operators.duplicates import known_content, mark_duplicates, unknown_content

    df = spark.createDataFrame([(1, "a", "x", 5, 6), (2, "a", "y", 7, 8), (3, None, "z", 9, 0)], "i int, t string, digest string, first int, `a.b` int")
    got = mark_duplicates(df, "i", "t")
    assert got.columns == [*df.columns, "duplicate_of"] and sorted((r.i, r.digest, r.duplicate_of) for r in got.collect()) == [(1, "x", None), (2, "y", 1), (3, "z", None)]
    assert unknown_content(df, df, "t", "t").columns == df.columns and known_content(df, df, "t", "t").count() == 2


def test_bands_make_few_candidates():
    from codeloom.operators.similarity import _ball, plan

    for k, words in ((12, 4000), (12, 10**6), (6, 10**6), (3, 10**9)):
        bands = plan(k, words)
        assert sum(r + 1 for _, _, r in bands) > k and sum(w for _, w, _ in bands) == 64
        assert sum(_ball(w, r) / 2.0**w for _, w, r in bands) < 0.01


def test_similar_words_by_any_plan(spark):
    import random

    from codeloom.operators.similarity import similar_words

    r, words = random.Random(2), []
    for _ in range(150):
        w = r.getrandbits(64) if r.random() < 0.5 or not words else r.choice(words)
        for _ in range(r.randrange(0, 9)):
            w ^= 1 << r.randrange(64)
        words.append(w)
    signed = sorted({w - (1 << 64) if w >> 63 else w for w in words})
    df = spark.createDataFrame([(w,) for w in signed], "w long")
    for k, bands in ((6, None), (6, [(0, 32, 3), (32, 32, 2)]), (3, None), (0, None)):
        got = {(x.a, x.b): x.distance for x in similar_words(df, "w", k, bands=bands).collect()}
        assert got == {(a, b): (a ^ b).bit_count() if a ^ b >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count() for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= k}


def test_flakes_of_makers_side_by_side():
    from codeloom.functions.codes import Flake

    makers = [Flake(part=p, parts=8) for p in range(8)]
    made = [m.digest(1.0, 64) for m in makers for _ in range(9000)]
    assert len(set(made)) == len(made) and max(int.from_bytes(d[:6], "big") for d in made) > 1000
