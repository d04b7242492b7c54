"""Golden values of the code format, and properties of the kernels."""

import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom import options
from codeloom.functions import codec, codes, compare, hashing, sketches, text
from codeloom.functions.constants import FRAME_PAIRS, GEAR, Main

TEXT_A = """
    Their most significant and usefull property of similarity-preserving
    fingerprints gets lost in the fragmentation of individual, propietary and
    use case specific implementations. The real benefit lies in similarity
    preservation beyond your local data archive on a global scale accross
    vendors.
"""
TEXT_B = TEXT_A.replace("Their", "The", 1)
TEXT_C = """
    A need for open standard fingerprinting. We don´t need the best
    Fingerprinting algorithm just an accessible and widely used one.
"""
MID_64, CID_64, DID_128 = "AAAYPXW445FTYNJ3", "EAARMJLTQCUWAND2", "GABVVC5DMJJGYKZ4ZBYVNYABFFYXG"
IID_256, DID_64 = "IADWIK7A7JTUAQ2D6QARX7OBEIK3OOUAM42LOBLCZ4ZOGDLRHMDL6TQ", "GAAQQICFKJYKY4KU"
FULL = "ISCC:KACYPXW445FTYNJ3CYSXHAFJMA2HUWULUNRFE3BLHRSCXYH2M5AEGQY"


def static_bytes(n=1 << 20):
    return np.arange(1, n // 4 + 1, dtype="<u4").tobytes()


def test_tables_from_rules():
    assert (GEAR[0], GEAR[1], GEAR[255]) == (1553318008, 574654857, 854125182)
    assert FRAME_PAIRS[0] == (292, 16) and FRAME_PAIRS[255] == (28, 351) and len(FRAME_PAIRS) == 256


@pytest.mark.parametrize(
    "value, digest",
    [
        (TEXT_A, "5f869a775c18bfbc3a117ab0114e13b2bf92614cda91513ee1f889fef3d6985f"),
        (TEXT_B, "5f869a775c18bdfc3a117ab0114e13f2bf92610cda91513ee1f889bef3d6985f"),
        (TEXT_C, "377b2f7b099a6df6bbc4a2ee4ff957b944c6434fa0e78842e7aad1169b71dd07"),
    ],
)
def test_soft_hash_text(value, digest):
    assert codes.soft_hash_text(value).hex() == digest


@pytest.mark.parametrize(
    "value, bits, code, characters",
    [
        (TEXT_A, 64, "ISCC:EAAZHFKU6PNI7UVW", 249),
        (TEXT_A, 32, "ISCC:EAAJHFKU6M", 249),
        (TEXT_B, 128, "ISCC:EABZHFKU6PNIXUVWYEEIQLOYHILX6", 247),
        (TEXT_C, 256, "ISCC:EADQE77SQ5NHKYPCDXT3E2NTB2EGV7VSKEUJDNXG2MICLCFZOPSDI4I", 108),
        ("", 128, "ISCC:EABSL4F2WZY7KBXBYUZPREWZ26IXU", 0),
        ("Hello World", 0, "ISCC:EAASKDNZNYGUUF5A", 10),
    ],
)
def test_text_code(value, bits, code, characters):
    assert codes.text_code(value, bits) == {"code": code, "characters": characters}


def test_collapse_and_clean():
    assert text.collapse("  Iñtërnâtiôn\nàlizætiøn☃💩 –  is a tric\t ky   thing!\r") == "internationalizætiøn☃💩isatrickything"
    assert text.collapse(" ") == "" and text.collapse("Hello\nWorld") == "helloworld"
    assert text.clean("# Some\n\n\n description") == "# Some\n\n description"
    assert text.clean("a\r\nb\tc\x00") == "a\n\nbc"
    assert text.remove_newlines(" a \n\t b ") == "a b"
    assert text.trim("äb", 1) == "�"
    assert text.utf16_length("a💩") == 3


def test_meta_code():
    m = codes.meta_code("Hello World")
    assert m["code"] == "ISCC:AAAWN77F727NXSUS" and m["metahash"] == "1e2041f8394111eb713a22165c46c90ab8f0fd9399c92028fd6d288944b23ff5bf76"
    m = codes.meta_code("Hello  World", "# Some\n\n\n description")
    assert m["name"] == "Hello World" and m["code"] == "ISCC:AAAWN77F72MBZZK3" and m["metahash"] == "1e20bd06bd79a3df82b163e346e5a477062aed41c2a9cf1e5812cf8947e2e3555a38"
    m = codes.meta_code("hello", None, '{"hello": "metadata"}')
    assert m["meta"] == "data:application/json;base64,eyJoZWxsbyI6Im1ldGFkYXRhIn0=" and m["code"] == "ISCC:AAAWKLHFXMFCA2OC"
    assert m["metahash"] == "1e200c6f9a94eb08835a957ffc9a7c80cf3fb54d1c6a8f13a41a6573a57ba146b0d2"
    again = codes.meta_code("hello", None, m["meta"])
    assert again["code"] == m["code"] and again["metahash"] == m["metahash"]
    for bad in (("",), ("x", None, "neither"), ("x", None, None, 64, 1)):
        with pytest.raises(ValueError):
            codes.meta_code(*bad)


@pytest.mark.parametrize(
    "values, digest",
    [
        ([], "00" * 32),
        ([1], "0000000100000001000000000000000000000000000000010000000000000000"),
        ([1, 2], "0000000300000001000000020000000000000000000000010000000200000000"),
        ([-1, 0, 1], "00000001ffffffff000000000000000100000000ffffffff0000000000000001"),
    ],
)
def test_soft_hash_audio(values, digest):
    assert codes.soft_hash_audio(values, 256).hex() == digest


def test_image():
    white, black = [255] * 1024, [0] * 1024
    assert codes.image_code(white, 64)["code"] == "ISCC:EEAYAAAAAAAAAAAA"
    assert codes.image_code(white, 96)["code"] == "ISCC:EEBIAAAAAAAAAAAAAAAAAAA"
    assert codes.image_code(white, 256)["code"] == "ISCC:EEDYAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"
    assert codes.soft_hash_image(black, 64).hex() == "00" * 8
    assert sketches.dct(np.arange(64.0))[0] == 2016 and sketches.dct(np.ones(64)).tolist() == [64.0] + [0.0] * 63
    for bad in (np.zeros(0), np.zeros(6)):
        with pytest.raises(ValueError):
            sketches.dct(bad)


def test_video():
    fa, fb = [0, 1, 0, 2, 1] * 76, [1, 2, 1, 0, 2] * 76
    assert codes.video_code([[0] * 380])["code"] == "ISCC:EMAQAAAAAAAAAAAA"
    assert codes.video_code([list(range(380))], 128)["code"] == "ISCC:EMBVFD4RIMPXYSWSNEZPYBZ2FDFMS"
    assert codes.video_code([fa, fb, fa], 256)["code"] == "ISCC:EMDZEMGSDFIB4AHUEZSLJPJANMAAZGCIQY23BMB4AEABB3QAVL4T4QY"
    for bad in ([], [[1] * 379]):
        with pytest.raises(ValueError):
            codes.video_code(bad)


def test_mixed():
    long, short = codes.text_code("Hello World", 256)["code"], codes.text_code("Short Text-Code", 64)["code"]
    assert (long, short) == ("ISCC:EADSKDNZNYGUUF5AMFEJLZ5P66CP5YKCOA3X7F36RWE4CIRCBTUWXYY", "ISCC:EAA3265Q67Q27P7F")
    assert codes.mixed_code([long, short])["code"] == "ISCC:EQASBPL7XH763357"
    for bad in ([long], [long, MID_64]):
        with pytest.raises(ValueError):
            codes.mixed_code(bad)
    with pytest.raises(ValueError):
        codes.mixed_code([long, short], 128)


def test_data_and_instance():
    data = static_bytes()
    assert codes.soft_hash_data(data).hex() == "e5b3daf1118cf09cb5c5ac323a9f68ca04465f9e3942297ebd1e6360f5bb98df"
    assert codes.soft_hash_data(b"").hex() == "25f0bab671f506e1c532f892d9d7917a252e7a520832f5963a8cd4e9a7e312b5"
    assert codes.soft_hash_data(b"\0").hex() == "770f8fd225ec1e5abb95e406afaddef303defe2f0d03b74c388f7b42ef96c7af"
    assert codes.data_code(data)["code"] == "ISCC:GAA6LM626EIYZ4E4"
    hasher, instance = codes.DataHasher(), codes.InstanceHasher()
    for i in range(0, len(data), 50_000):
        hasher.push(data[i : i + 50_000])
        hasher = codes.DataHasher.from_state(hasher.state())
        instance.push(data[i : i + 50_000])
    assert hasher.digest() == codes.soft_hash_data(data)
    assert instance.multihash == codes.instance_code(data)["datahash"] and instance.filesize == 1 << 20
    assert codes.instance_code(b"")["code"] == "ISCC:IAA26E2JXH27TING"
    assert codes.instance_code(b"\0")["code"] == "ISCC:IAAS2OW637YRWYPR"


def test_minhash():
    assert sketches.minhash_256(np.array([1 << 16])).hex() == "a18e2fb2bd663d21db9c7dcc9ae78380253cae5bf089766d87a6b51fcb3f8f8e"
    assert sketches.pack_minhash(np.array([0b10100001, 0b11000010, 0b10110100, 0b10011000])).hex() == "8421"
    assert sketches.minhash(np.array([2**64 - 1], dtype=np.uint64)).max() < 2**32


def test_compose_and_explain():
    assert codec.compose([CID_64, MID_64, IID_256, DID_128]) == FULL
    assert codec.explain(FULL) == "ISCC-TEXT-V0-MCDI-87dedce74b3c353b16257380a960347a5a8ba362526c2b3c642be0fa67404343"
    assert codec.compose([CID_64, DID_128, IID_256]) == "ISCC:KAARMJLTQCUWAND2LKF2GYSSNQVTYZBL4D5GOQCDIM"
    assert codec.compose([DID_128, IID_256]) == "ISCC:KUAFVC5DMJJGYKZ4MQV6B6THIBBUG"
    assert codec.explain(codec.compose([DID_64, IID_256])) == "ISCC-SUM-V0-DI-0820455270ac7154642be0fa67404343"
    wide = codec.compose([DID_128, IID_256], wide=True)
    assert codec.decompose(wide)[0] == DID_128 and codec.normalize(wide) == wide and codec.validate(wide)
    assert codec.compose(codec.decompose(FULL)) == FULL == codec.normalize(MID_64 + "")[:0] + FULL
    for bad in ([CID_64], ["AAAGKLHFXM", "EAAP5Q74YU"], [MID_64, CID_64, DID_128]):
        with pytest.raises(ValueError):
            codec.compose(bad)


def test_codec():
    for n, bits in ((0, "0000"), (7, "0111"), (8, "10000000"), (71, "10111111"), (72, "110000000000"), (583, "110111111111"), (584, "1110000000000000"), (4679, "1110111111111111")):
        assert codec.varnibble(n) == bits and codec.from_varnibble(bits + "01") == (n, "01")
    for bad in (-1, 4680):
        with pytest.raises(ValueError):
            codec.varnibble(bad)
    for bad in ("0", "1", "011", "100", ""):
        with pytest.raises(ValueError):
            codec.from_varnibble(bad)
    assert codec.header(7, 1, 1, 1) == bytes([0x71, 0x11]) and codec.parse(bytes([0x71, 0x11]))[:4] == (7, 1, 1, 1)
    assert codec.base32(b"foobar") == "MZXW6YTBOI" and codec.from_base32("mzxw6ytboi") == b"foobar"
    assert codec.base32hex(b"hello world") == "D1IMOR3F41RMUSJCCG"
    assert codec.clean_code("ISCC: SOME-CODE") == "SOMECODE" and codec.clean_code("ISCC:") == ""
    for bad in ("http://whatever", "ISCC:something:something"):
        with pytest.raises(ValueError):
            codec.clean_code(bad)
    assert codec.decode("AAAQCAAAAABAAAAA") == (0, 0, 0, 1, bytes([1, 0, 0, 0, 2, 0, 0, 0]))
    assert codec.type_id("AAAQCAAAAABAAAAA") == "META-NONE-V0-64"
    assert codec.validate("ISCC:MMAMRVPW22XVU4FR", False) and not codec.validate("ISCC:CE22222222", False)
    with pytest.raises(ValueError):
        codec.validate("ISCC:CE22222222")
    assert codec.decode("vpg0i00b2jtnrtm1c0v6g") == codec.decode("iscc:vpg0i00b2jtnrtm1c0v6g") == codec.decode("ISCC:EAAWFH3PX3MCYB6N")


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=32, max_size=32), st.sampled_from([32, 64, 128, 256]), st.sampled_from(list("fbvzu")))
def test_multiformats_round_trip(digest, bits, base):
    code = "ISCC:" + codec.unit(Main.DATA, 0, 0, bits, digest)
    assert codec.normalize(codec.multiformat(code, base)) == code and codec.inspect(code)["hash_bytes"] == digest[: bits // 8]
    assert codec.validate(code)
    data = codec.inspect(code)["bytes"]
    assert codec.from_hex(data.hex()) == code == codec.from_fields(codec.decode(code))
    assert codec.inspect(data) == codec.inspect(code) == codec.inspect(codec.decode(code))


def test_identifiers():
    wallet = "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"
    first = codes.wallet_id(FULL, 1, wallet)["code"]
    assert first.startswith("ISCC:ME")
    second = codes.next_wallet_id(first)
    third = codes.next_wallet_id("ISCC:" + second)
    assert second == codes.wallet_id(FULL, 1, wallet, 1)["code"][5:] and third == codes.wallet_id(FULL, 1, wallet, 2)["code"][5:]
    assert codes.wallet_id_simhash(first, wallet) == codes.wallet_id_simhash(second, wallet)
    assert codes.time_id(1_000_000, 42, 1)["code"].startswith("ISCC:ME") and codes.time_id(1)["code"].startswith("ISCC:MA")
    for bad in ((1 << 52,), (1, 4096), (1, 0, 2), (-1,)):
        with pytest.raises(ValueError):
            codes.time_id(*bad)
    with pytest.raises(ValueError):
        codes.next_wallet_id(codes.time_id(1)["code"])
    flake = codes.Flake(random=lambda n: b"\xff" * n)
    a, b = flake.digest(1.5, 64), flake.digest(1.5, 64)
    assert a[:6] == (1500).to_bytes(6, "big") == b[:6] and a[6:] == b"\xff\xff" and b[6:] == b"\0\0"
    assert codec.type_id(codes.flake_code(96)["code"]) == "FLAKE-NONE-V0-96"


def test_compare():
    a, b = codes.text_code(TEXT_A, 64)["code"], codes.text_code(TEXT_B, 64)["code"]
    assert compare.distance(a, a) == 0 and compare.similarity(a, a) == 100 and 0 < compare.distance(a, b) < 10
    assert compare.compare(FULL, FULL) == {"meta_dist": 0, "content_dist": 0, "data_dist": 0, "instance_match": True}
    assert compare.compare(codes.time_id(1)["code"], codes.time_id(2)["code"]) == {"id_match": False}
    assert compare.prefix_similarity(b"\x0f", b"\x0f\xff") == (1.0, 8) and compare.prefix_distance(b"", b"x") == (1.0, 0) and compare.prefix_similarity(b"", b"") == (1.0, 0)
    with pytest.raises(ValueError):
        compare.distance(a, MID_64)
    assert compare.cid_from_token(compare.cid_to_token(compare.cid(b"x"))) == compare.cid(b"x")
    with pytest.raises(ValueError):
        compare.cid(bytes(262_145))


def test_hashes():
    assert hashing.blake3([b""])[0].hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    pattern = lambda n: bytes(i % 251 for i in range(n))
    assert hashing.blake3([pattern(1025)])[0].hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    xxhash = pytest.importorskip("xxhash")
    r = random.Random(1)
    many = [r.randbytes(r.randrange(0, 90)) for _ in range(300)]
    assert hashing.xxh32(many).tolist() == [xxhash.xxh32_intdigest(m) for m in many]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=30_000), st.sampled_from([64, 256, 1024]))
def test_chunks_cover(data, average):
    ends = sketches.chunk_ends(data, average)
    assert ends[-1] == len(data) and all(b - a <= 8 * average for a, b in zip([0, *ends], ends, strict=False))
    assert all(e % 4 == 0 or e == len(data) for e in sketches.chunk_ends(data, average, utf32=True))


def test_small_helpers():
    assert text.sliding_window("abcdef", 3) == ["abc", "bcd", "cde", "def"] and text.sliding_window("", 3) == [""]
    assert text.chunk_string("abcde\nf", 2) == ["ab", "cd", "e", "f"] and text.chunk_string("", 2) is None
    assert text.interleave([1, 2], [3, 4]) == [1, 3, 2, 4] and text.interleave(None, [1]) == []
    assert sketches.divide(4, [1, 2, 3, 4, 5]) == [[1, 2], [3, 4], [5], []]
    assert text.is_json('{"a": 1}') and text.is_json("[]") and not text.is_json("1") and not text.is_json('{"__proto__": 1}')
    assert text.minify('{"b": 1.0, "2": [1e21, 1e-7, -0.0, 0.1], "1": null}') == '{"1":null,"2":[1e+21,1e-7,0,0.1],"b":1}'
    assert text.canonical_json({"b": {"z": 1, "a": 2.5}, "a": "é"}) == '{"a":"é","b":{"a":2.5,"z":1}}'.encode()
    assert text.b64url_decode(text.b64url_encode("é?>")) == "é?>" and base64.urlsafe_b64encode("é?>".encode()).decode().rstrip("=") == text.b64url_encode("é?>")
    assert codec.from_uvarint(codec.uvarint(300)) == (300, 2)


def test_options():
    assert options.load_options({"X_TEXT_BITS": "128", "X_META_BITS": "x"}, "X_").text_bits == 128
    assert options.conformant(options.Options()) and not options.conformant(options.Options(text_ngram_size=5))


def test_tables_made_by_rule_in_full():
    """Every value of the two tables that are made from their rules, by SHA-256 over all of them as text."""
    import hashlib

    from codeloom.functions.constants import FRAME_PAIRS, GEAR

    text = lambda values: hashlib.sha256(",".join(values).encode()).hexdigest()
    assert len(GEAR) == len(FRAME_PAIRS) == 256
    assert text(map(str, GEAR)) == "ae404047d699e95669a376182b881d9fbdcf0788e394bac7a7c4708b8c2af84a"
    assert text(f"{a} {b}" for a, b in FRAME_PAIRS) == "27139570faf8478d54f8f721b26c5e867d59de4d5501b45a31e378abfee944d3"


def test_chunk_ends_are_those_of_the_recurrence():
    """The fixed-point search against the hash byte by byte, on random, repetitive and constant bytes."""
    import random

    from codeloom.functions.constants import GEAR
    from codeloom.functions.sketches import ChunkRule, chunk_ends

    def slow(data, average):
        rule, ends, at = ChunkRule(average), [], 0
        while at < len(data):
            size = min(len(data) - at, rule.most)
            h, end = 0, size
            for i in range(rule.least, size):
                h = (h >> 1) + GEAR[data[at + i]]
                if not h & (rule.strict if i < rule.centre else rule.loose):
                    end = i + 1
                    break
            at = min(len(data), at + end)
            ends.append(at)
        return ends or [0]

    r = random.Random(1)
    for k in range(60):
        n = r.randrange(0, 40_000)
        data = (r.randbytes(n), bytes(r.choices(b"the quick brown fox ", k=n)), bytes([r.randrange(256)]) * n, b"".join(bytes([r.randrange(256)]) * r.randrange(1, 300) for _ in range(n // 100)))[k % 4]
        for average in (64, 1024):
            assert chunk_ends(data, average) == slow(data, average)
