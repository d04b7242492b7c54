"""One query for each operator over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native
from ..functions.columns import Functions
from ..functions.constants import FRAME_VALUES, Content, Main, Plain
from ..operators import coded, duplicates, folds, similarity
from ..sources.files import blocks
from ..storage import persisted
from ..streaming import events as ev
from ..streaming.blocks import batch_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asset_codes(spark, d):
    """Flagship: composite of each document's name (its source and first line, trimmed by the meta code), text and bytes; null without a text."""
    name = F.concat_ws(" ", "source", "lang", F.split("text", "\n")[0])
    docs = _table(spark, d, "documents").select("doc_id", name.alias("name"), "text")
    return coded.with_asset_code(docs, "name", "text").select("doc_id", "asset_code")


def text_codes(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    return coded.with_text_code(docs, "text").select("doc_id", "text_code.code", "text_code.characters")


def meta_codes(spark, d):
    f = Functions()
    parts = _table(spark, d, "part")
    meta = F.to_json(F.struct("p_brand", "p_size", "p_retailprice"))
    m = parts.select("p_partkey", f.meta_code("p_name", "p_type", meta).alias("m"))
    return m.select("p_partkey", "m.code", "m.metahash", "m.name", "m.meta")


def data_codes(spark, d):
    f = Functions()
    docs = _table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return docs.select("doc_id", f.data_code("data")["code"].alias("code"))


def instance_codes(spark, d):
    f = Functions()
    docs = _table(spark, d, "documents").select("doc_id", f.instance_code(F.encode("text", "UTF-8")).alias("i"))
    return docs.select("doc_id", "i.code", "i.datahash", "i.filesize")


def block_codes(spark, d):
    """Data and instance codes again, from blocks of 4 KiB."""
    pages = _table(spark, d, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("data"))
    return batch_codes(blocks(pages, "page_id", "data", 4096), "page_id")


def data_chunks(spark, d):
    pages = _table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("data"))
    return coded.chunks(pages, "page_id", "data")


def image_codes(spark, d):
    """Vectors as pictures: their values, repeated to 32 x 32."""
    f = Functions()
    v = _table(spark, d, "embeddings").select("vec_id", F.slice(F.flatten(F.array_repeat(F.transform("embedding", lambda x: x.cast("double")), 1024)), 1, 1024).alias("p"))
    return v.select("vec_id", f.image_code("p")["code"].alias("code"))


def _frames(spark, d):
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int"))
    frame = F.slice(F.flatten(F.array_repeat(values, FRAME_VALUES)), 1, FRAME_VALUES)
    return _table(spark, d, "embeddings").select("label", frame.alias("frame"))


def frame_codes(spark, d):
    return folds.frame_code_by(_frames(spark, d), "label", "frame", 128)


def frame_sums(spark, d):
    """The fold inside of frame codes: sums over different frames."""
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int"))
    frames = _table(spark, d, "embeddings").select("label", values.alias("v")).dropDuplicates()
    return frames.select("label", F.posexplode("v").alias("place", "x")).groupBy("label", "place").agg(F.sum("x").alias("total")).select("label", F.col("place").cast("long").alias("place"), "total")


def audio_digests(spark, d):
    """Part keys of an order as features, in line order."""
    lines = _table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), "l_partkey")
    found = folds.audio_digest_by(lines, "l_orderkey", "at", "l_partkey")
    coded_ = found.select("l_orderkey", "digest", native.unit_code(Main.CONTENT, Content.AUDIO, 0, 64, F.col("digest")).alias("code"))
    return coded_.select("l_orderkey", F.lower(F.hex("digest")).alias("digest"), "code")


def minhashes(spark, d):
    found = folds.minhash_by(_table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")
    total = F.aggregate("minhash", F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("l_orderkey", F.get("minhash", F.lit(0)).alias("m0"), F.get("minhash", F.lit(63)).alias("m63"), total.alias("total"), F.lower(F.hex(folds.pack_minhash("minhash", 1))).alias("digest_64"))


def _word_hashes(spark, d):
    words = _table(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "[ \n]")).alias("w")).filter("w <> ''")
    return words.select("doc_id", F.conv(F.substring(F.md5("w"), 1, 16), 16, -10).cast("long").alias("h"))


def _simhashes(spark, d):
    found = folds.simhash_by(_word_hashes(spark, d), "doc_id", ["h"])
    return found.select("doc_id", F.lower(F.hex("digest")).alias("digest"), F.conv(F.hex("digest"), 16, -10).cast("long").alias("word"))


def simhashes(spark, d):
    return _simhashes(spark, d).select("doc_id", "digest")


def similar_documents(spark, d):
    """Documents with copies or near ones: within 3 bits of each other's SimHash."""
    return similarity.similar_rows(_simhashes(spark, d), "doc_id", "word", 3)


def similar_pairs(spark, d):
    """Different SimHashes within 6 bits."""
    pairs = similarity.similar_words(_simhashes(spark, d), "word", 6)
    return pairs.select("a", "b", F.col("distance").cast("long").alias("distance"))


def nearest_documents(spark, d):
    """For each SimHash the two nearest others within 12 bits."""
    s = persisted(_simhashes(spark, d).select("word").distinct(), "words")
    near = similarity.nearest_words(s, "word", s, "word", 12, 2, itself=False)
    return near.select("a", "b", F.col("distance").cast("long").alias("distance"), F.col("rank").cast("long").alias("rank"))


def compared_assets(spark, d):
    """Each part against the next one: codes of both, compared unit by unit."""
    f = Functions()
    data = F.encode(F.concat_ws(" ", "p_name", "p_type"), "UTF-8")
    parts = _table(spark, d, "part").select("p_partkey", f.meta_code("p_name")["code"].alias("m"), f.text_code("p_type")["code"].alias("t"), f.data_code(data)["code"].alias("x"), f.instance_code(data)["code"].alias("i"))
    codes = parts.select("p_partkey", f.compose(F.array("m", "t", "x", "i"), F.lit(False)).alias("code"))
    rows = coded.units(codes, "p_partkey", "code", f)
    left = rows.withColumn("pair", F.col("p_partkey"))
    right = rows.withColumn("pair", F.col("p_partkey") - 1)
    return similarity.compare_units(left, right, "pair")


def explained_codes(spark, d):
    f = Functions()
    parts = _table(spark, d, "part").select("p_partkey", f.text_code("p_name")["code"].alias("code"))
    return parts.select("p_partkey", "code", f.code_explain("code").alias("explained"), f.code_type_id("code").alias("type_id"), f.code_multiformat("code", F.lit("z")).alias("base58btc"), native.has_code_shape("code").alias("shaped"), f.code_validate("code").alias("valid"), f.code_normalize(f.code_multiformat("code", F.lit("u"))).alias("again"))


def mixed_codes(spark, d):
    """For each brand, the mix of its parts' text codes."""
    f = Functions()
    units = _table(spark, d, "part").select("p_brand", f.text_code("p_name")["code"].alias("code"))
    return folds.mixed_code_by(units, "p_brand", "code")


def wallet_ids(spark, d):
    f = Functions()
    customers = _table(spark, d, "customer").select("c_custkey", "c_name", f.instance_code(F.encode("c_name", "UTF-8"))["code"].alias("code"))
    ids = customers.select("c_custkey", "c_name", f.wallet_id("code", F.lit(2), "c_name", F.lit(0)).alias("id"))
    return ids.select("c_custkey", "id", f.next_wallet_id("id").alias("next"), f.wallet_id_simhash("id", "c_name").alias("simhash"))


def byte_cuts(spark, d):
    """Texts cut to 61 bytes of UTF-8, inside of characters too, trimmed, and without some letters at the end."""
    docs = _table(spark, d, "documents")
    cut = native.cut_utf8("text", 61)
    return docs.select("doc_id", cut.alias("cut"), native.trim("text", 61).alias("trimmed"), native.rtrim(cut, "aeiou.").alias("stem"))


def part_text_codes(spark, d):
    """Text codes of part names, and the 256 bits they are cut from."""
    f = Functions()
    parts = _table(spark, d, "part").select("p_partkey", f.text_code("p_name").alias("t"), f.soft_hash_text(f.text_collapse("p_name")).alias("h"))
    return parts.select("p_partkey", "t.code", F.col("t.characters").cast("long").alias("characters"), F.lower(F.hex("h")).alias("digest"))


def customer_instances(spark, d):
    f = Functions()
    return _table(spark, d, "customer").select("c_custkey", f.instance_code(F.encode("c_name", "UTF-8")).alias("i")).select("c_custkey", "i.code", "i.datahash", "i.filesize")


def unit_views(spark, d):
    """Units of SHA-256 digests: header, all bases, views, validation, and the comparison of two."""
    f = Functions()
    digest = lambda c: F.unhex(F.sha2(F.encode(c, "UTF-8"), 256))
    unit = lambda c: native.unit_code(Main.DATA, Plain.NONE, 0, 64, digest(c))
    parts = _table(spark, d, "part").select("p_partkey", unit("p_name").alias("code"), unit("p_type").alias("other"), native.unit_code(Main.META, Plain.NONE, 0, 256, digest("p_name")).alias("long_code"))
    rows = parts.withColumn("i", f.code_inspect("code")).withColumn("c", f.code_decode("code")).withColumn("p", f.prefix_similarity(f.code_decode("code")["body"], F.substring(f.code_decode("other")["body"], 1, 6)))
    dashed = F.lower(F.concat(F.substring("code", 1, 9), F.lit("-"), F.substring(F.col("code"), 10, 99)))
    return rows.select(
        "p_partkey", "code", "c.main", "c.sub", "c.version", "c.length", F.lower(F.hex("c.body")).alias("body"), "i.type_id", F.col("i.explain").alias("explained"), "i.uint", "i.hash_uint",
        F.col("i.mf_base16").alias("base16"), F.col("i.mf_base58btc").alias("base58btc"), F.col("i.mf_base32").alias("mf_base32"), F.col("i.mf_base64url").alias("base64url"), "i.base32hex",
        f.code_normalize(dashed).alias("again"), f.code_validate("code").alias("valid"), f.code_validate(F.expr("substr(code, 1, length(code) - 2)")).alias("cut_valid"), f.code_validate_mf("i.mf_base58btc").alias("valid_mf"),
        f.code_distance("code", "other").alias("distance"), f.code_similarity("code", "other").alias("similarity"), F.col("p.common_prefix_bits").alias("common"), F.col("p.similarity").alias("prefix_similarity"),
        "long_code", f.code_type_id("long_code").alias("long_type"),
    )


def composites(spark, d):
    """Composites of units of digests, wide ones and of Data and Instance alone; their units, and the way back from these one behind the other."""
    f = Functions()
    unit = lambda main, bits, *c: native.unit_code(main, 0, 0, bits, F.unhex(F.sha2(F.encode(F.concat(*c), "UTF-8"), 256)))
    parts = _table(spark, d, "part").select("p_partkey", unit(Main.META, 64, "p_name").alias("m"), unit(Main.CONTENT, 64, "p_type").alias("t"), unit(Main.DATA, 128, "p_brand").alias("x"), unit(Main.INSTANCE, 128, "p_name", "p_type").alias("i"))
    rows = parts.withColumn("code", f.compose(F.array("m", "i", "t", "x"), F.lit(False))).withColumn("wide", f.compose(F.array("x", "i"), F.lit(True))).withColumn("sum_code", f.compose(F.array("i", "x"), F.lit(False))).withColumn("units", f.code_decompose("code"))
    back = f.compose("units", F.lit(False)) == F.col("code")
    return rows.select("p_partkey", "code", "wide", "sum_code", F.array_join("units", " ").alias("units"), f.code_type_id("code").alias("type_id"), back.alias("again"), (F.concat(F.lit("ISCC:"), f.code_decompose("wide")[0]) == F.col("x")).alias("wide_units"))


def token_ids(spark, d):
    """Content identifiers as token numbers, and back."""
    f = Functions()
    cids = _table(spark, d, "documents").select("doc_id", native.cid(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("cid")).filter("cid is not null")
    token = f.cid_to_token("cid")
    return cids.select("doc_id", "cid", (f.cid_from_token(token) == F.col("cid")).alias("same"), (native.cid_from_digest(native.cid_digest("cid")) == F.col("cid")).alias("sound"))


def time_ids(spark, d):
    found = ev.mint_time_ids(_table(spark, d, "events"), "ts", "user_id")
    return found.select("event_id", "time_id")


def content_ids(spark, d):
    return _table(spark, d, "documents").select("doc_id", native.cid(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("cid"))


def instance_units(spark, d):
    """Units of SHA-256 digests, built by Catalyst alone."""
    data = F.encode("c_name", "UTF-8")
    return _table(spark, d, "customer").select("c_custkey", native.unit_code(Main.INSTANCE, Plain.NONE, 0, 64, F.unhex(F.sha2(data, 256))).alias("code"), native.base32hex(data).alias("name_base32hex"))


def exact_duplicates(spark, d):
    return duplicates.duplicate_groups(_table(spark, d, "documents"), "doc_id", "text")


def marked_duplicates(spark, d):
    return duplicates.mark_duplicates(_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "duplicate_of")


def unknown_turns(spark, d):
    """Turns of conversations whose text no other role has said."""
    turns = _table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    others = turns.filter("role <> 'user'")
    return duplicates.unknown_content(turns.filter("role = 'user'"), others, "text", "text").select("conv_id", "turn")


def known_turns(spark, d):
    turns = _table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return duplicates.known_content(turns.filter("role = 'user'"), turns.filter("turn = 0"), "text", "text").select("conv_id", "turn")


def duplicates_rollup(spark, d):
    """Documents and different texts by source and language, with totals."""
    docs = _table(spark, d, "documents").select("source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return docs.rollup("source", "lang").agg(F.count("*").alias("documents"), F.countDistinct("h").alias("texts"))


def text_windows(spark, d):
    """How often each run of three characters occurs in part names."""
    grams = _table(spark, d, "part").select(F.explode(native.sliding_window("p_name", 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def plain_text(spark, d):
    """White space to single blanks, cut to 64 bytes, and lengths."""
    docs = _table(spark, d, "documents").filter("text is not null")
    one_line = native.remove_newlines("text")
    return docs.select("doc_id", one_line.alias("line"), native.utf16_length(one_line).cast("long").alias("units"), F.char_length(native.trim(F.regexp_replace(one_line, r"[^\x20-\x7e]", ""), 64)).cast("long").alias("cut"))


def name_pieces(spark, d):
    """Names in pieces of four characters, quarters of the list of pieces, and both ends interleaved."""
    parts = _table(spark, d, "part").select("p_partkey", native.chunk_string("p_name", 4).alias("q"), "p_name", "p_type")
    quarters = native.divide("q", 4)
    return parts.select("p_partkey", F.array_join("q", "|").alias("pieces"), F.array_join(F.transform(quarters, lambda q: F.array_join(q, "+")), "|").alias("quarters"), F.array_join(native.interleave(F.array("p_name", F.lit("x")), F.array("p_type", F.lit("y"))), "|").alias("mixed"))


def data_urls(spark, d):
    props = _table(spark, d, "events").select("event_id", "props")
    url = native.data_url("props")
    return props.select("event_id", url.alias("url"), native.data_url_payload(url).alias("payload"), native.b64url_encode("props").alias("b64url"))


def hourly_events(spark, d):
    return ev.tumbling_counts(_table(spark, d, "events"), "ts", "event_type")


def sliding_events(spark, d):
    return ev.sliding_counts(_table(spark, d, "events"), "ts", "event_type")


def event_sessions(spark, d):
    return ev.sessions(_table(spark, d, "events"), "ts", "user_id", "10 minutes").select("user_id", "start", "n")


QUERIES = {
    f.__name__: f
    for f in (
        asset_codes,
        text_codes,
        meta_codes,
        data_codes,
        instance_codes,
        block_codes,
        data_chunks,
        image_codes,
        frame_codes,
        frame_sums,
        audio_digests,
        minhashes,
        simhashes,
        similar_documents,
        similar_pairs,
        nearest_documents,
        compared_assets,
        explained_codes,
        mixed_codes,
        wallet_ids,
        byte_cuts,
        part_text_codes,
        customer_instances,
        unit_views,
        composites,
        token_ids,
        time_ids,
        content_ids,
        instance_units,
        exact_duplicates,
        marked_duplicates,
        unknown_turns,
        known_turns,
        duplicates_rollup,
        text_windows,
        plain_text,
        name_pieces,
        data_urls,
        hourly_events,
        sliding_events,
        event_sessions,
    )
}
