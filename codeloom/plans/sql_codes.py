"""DuckDB SQL for queries of codes: bases, headers, BLAKE3 of one block, xxHash32 of short inputs, MinHash, chunks."""

from __future__ import annotations

from ..functions.constants import BASE32, BASE58, GEAR, MINHASH_A, MINHASH_B, MINHASH_PRIME

_32 = 4294967296


def base32(number: str, chars: int) -> str:
    """Letters of a HUGEINT of 5 * chars bits."""
    return "concat(" + ", ".join(f"substr('{BASE32}', CAST((({number}) // {1 << 5 * (chars - 1 - i)}::HUGEINT) % 32 AS INT) + 1, 1)" for i in range(chars)) + ")"


def base58(number: str, chars: int) -> str:
    return "concat(" + ", ".join(f"substr('{BASE58}', CAST((({number}) // {58 ** (chars - 1 - i)}::HUGEINT) % 58 AS INT) + 1, 1)" for i in range(chars)) + ")"


def letters(hexes: str, bits: int) -> str:
    """Base32 of so many bits in hex, a multiple of 16, whatever their number."""
    binary = "concat(" + ", ".join(f"lpad(to_binary(CAST('0x' || substr({hexes}, {4 * i + 1}, 4) AS INT)), 16, '0')" for i in range(bits // 16)) + ", '0000')"
    chars = -(-bits // 5)
    return f"list_aggregate(list_transform(range(0, {chars}), lambda i: substr('{BASE32}', CAST('0b' || substr({binary}, CAST(5 * i + 1 AS INT), 5) AS INT) + 1, 1)), 'string_agg', '')"


def _rotated(x: str, k: int) -> str:
    """x turned right by k of 32 bits."""
    return f"((({x}) >> {k}) | ((({x}) << {32 - k}) & {_32 - 1}))"


def blake3(table: str, ident: str, text: str) -> str:
    """CTEs that end in one called hashed(id, h): BLAKE3 in hex of texts of at most 64 bytes."""
    iv = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
    order = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
    words = ", ".join("CAST('0x' || " + " || ".join(f"substr(x, {8 * w + 2 * b + 1}, 2)" for b in (3, 2, 1, 0)) + f" AS BIGINT) AS m{w}" for w in range(16))
    start = [*(f"{v}::BIGINT" for v in iv), *(f"{v}::BIGINT" for v in iv[:4]), "0::BIGINT", "0::BIGINT", "n", "11::BIGINT"]
    out = [f"b0 AS (SELECT {ident} AS id, strlen({text})::BIGINT AS n, rpad(lower(hex(encode({text}))), 128, '0') AS x FROM {table})", f"b1 AS MATERIALIZED (SELECT id, {words}, {', '.join(f'{v} AS v{i}' for i, v in enumerate(start))} FROM b0)"]
    at, message, last = 1, list(range(16)), "b1"
    keep = ", ".join(f"m{w}" for w in range(16))
    for r in range(7):
        for half, sets in enumerate(([(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15)], [(0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)])):
            for turn, (first, second) in enumerate(((16, 12), (8, 7))):
                v = {}
                for g, (a, b, c, d) in enumerate(sets):
                    v[a] = f"((v{a} + v{b} + m{message[8 * half + 2 * g + turn]}) % {_32})"
                    v[d] = _rotated(f"xor(v{d}, {v[a]})", first)
                at += 1
                out.append(f"b{at} AS MATERIALIZED (SELECT id, {keep}, " + ", ".join(f"{v.get(i, f'v{i}')} AS v{i}" for i in range(16)) + f" FROM {last})")
                last, v = f"b{at}", {}
                for a, b, c, d in sets:
                    v[c] = f"((v{c} + v{d}) % {_32})"
                    v[b] = _rotated(f"xor(v{b}, {v[c]})", second)
                at += 1
                out.append(f"b{at} AS MATERIALIZED (SELECT id, {keep}, " + ", ".join(f"{v.get(i, f'v{i}')} AS v{i}" for i in range(16)) + f" FROM {last})")
                last = f"b{at}"
        message = [message[i] for i in order]
    hexes = " || ".join(f"concat({', '.join(f'substr(w{i}, {k}, 2)' for k in (7, 5, 3, 1))})" for i in range(8))
    out.append("b_end AS (SELECT id, " + ", ".join(f"lpad(lower(to_hex(xor(v{i}, v{i + 8}))), 8, '0') AS w{i}" for i in range(8)) + f" FROM {last})")
    out.append(f"hashed AS MATERIALIZED (SELECT id, {hexes} AS h FROM b_end)")
    return ",\n".join(out)


def _times(x: str, p: int) -> str:
    return f"CAST((({x})::HUGEINT * {p}) % {_32} AS BIGINT)"


def _left(x: str, k: int) -> str:
    return _rotated(x, 32 - k)


def xxh32(table: str, gram: str) -> str:
    """CTEs that end in one called features(gram, f): xxHash32, seed 0, of texts of less than 32 bytes."""
    p1, p2, p3, p4, p5 = 2654435761, 2246822519, 3266489917, 668265263, 374761393
    byte = lambda i: f"CAST('0x' || substr(x, 2 * CAST({i} AS INT) + 1, 2) AS BIGINT)"
    word = lambda i: "(" + " + ".join(f"{byte(f'{i} + {b}')} * {256**b}" for b in range(4)) + ")"
    lanes = [_times(_left(f"(({start} + {_times(word(4 * i), p2)}) % {_32})", 13), p1) for i, start in enumerate(((p1 + p2) % _32, p2, 0, _32 - p1))]
    out = [
        f"x_in AS MATERIALIZED (SELECT {gram} AS gram, strlen({gram}) AS n, CASE WHEN strlen({gram}) >= 16 THEN 16 ELSE 0 END AS o, rpad(lower(hex(encode({gram}))), 64, '0') AS x FROM {table})",
        f"x_lanes AS MATERIALIZED (SELECT *, {', '.join(f'{v} AS v{i}' for i, v in enumerate(lanes))} FROM x_in)",
        f"x0 AS MATERIALIZED (SELECT gram, n, o, x, (CASE WHEN o = 16 THEN {' + '.join(_left(f'v{i}', k) for i, k in enumerate((1, 7, 12, 18)))} ELSE {p5} END + n) % {_32} AS h FROM x_lanes)",
    ]
    at = 0

    def step(value: str) -> None:
        nonlocal at
        at += 1
        out.append(f"x{at} AS MATERIALIZED (SELECT gram, n, o, x, {value} AS h FROM x{at - 1})")

    for w in range(3):
        step(f"CASE WHEN n >= o + {4 * w + 4} THEN {_times(_left('((h + ' + _times(word(f'o + {4 * w}'), p3) + f') % {_32})', 17), p4)} ELSE h END")
    for b in range(3):
        step(f"CASE WHEN n % 4 > {b} THEN {_times(_left('((h + ' + _times(byte(f'(n // 4 * 4 + {b})'), p5) + f') % {_32})', 11), p1)} ELSE h END")
    step(_times("xor(h, h >> 15)", p2))
    step(_times("xor(h, h >> 13)", p3))
    out.append(f"features AS MATERIALIZED (SELECT gram, xor(h, h >> 16) AS f FROM x{at})")
    return ",\n".join(out)


_PERMUTATIONS = ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(zip(MINHASH_A, MINHASH_B, strict=True)))
_WIDE = "18446744073709551616"

#: Text codes of part names: CTEs that end in coded(p_partkey, p_brand, characters, u, digest, code).
_PART_CODES = f"""
t AS MATERIALIZED (SELECT p_partkey, p_brand, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS t FROM part),
g AS MATERIALIZED (SELECT DISTINCT p_partkey, substr(t, CAST(i AS INT), 13) AS gram FROM (SELECT p_partkey, t, unnest(range(1, greatest(length(t) - 12, 1) + 1)) AS i FROM t)),
d AS (SELECT DISTINCT gram FROM g),
{xxh32("d", "gram")},
p(i, a, b) AS (VALUES {_PERMUTATIONS}),
y AS MATERIALIZED (SELECT gram, i, ((a * f + b) % {_WIDE}) % {MINHASH_PRIME} % 4294967296 AS m FROM features, p),
m AS MATERIALIZED (SELECT p_partkey, i, min(m) AS m FROM g JOIN y USING (gram) GROUP BY p_partkey, i),
planes AS (SELECT p_partkey, k, lpad(lower(to_hex(CAST(sum(((m // (1::HUGEINT << k::INT)) % 2) * (1::HUGEINT << (63 - i)::INT)) AS UBIGINT))), 16, '0') AS h, sum((m % 2) * (1::HUGEINT << (63 - i)::INT)) AS u FROM m, range(4) r(k) GROUP BY p_partkey, k),
coded AS MATERIALIZED (SELECT p_partkey, p_brand, length(t) AS characters, max(u) AS u, string_agg(h, '' ORDER BY k) AS digest, 'ISCC:' || {base32(f"{0x2001}::HUGEINT * {_WIDE} + max(u)::HUGEINT", 16)} AS code FROM t JOIN planes USING (p_partkey) GROUP BY ALL)
"""
_OF_MF = f"({0xCC012001}::HUGEINT * {_WIDE} + u::HUGEINT)"



def _grams(width: int, *columns: str) -> str:
    """All runs of width characters of each column of p, as (whole, width, gram); of a shorter one, itself."""
    return " UNION ALL ".join(f"SELECT whole, {width} AS width, substr(whole, CAST(i AS INT), {width}) AS gram FROM (SELECT whole, unnest(range(1, greatest(length(whole) - {width - 1}, 1) + 1)) AS i FROM (SELECT DISTINCT {c} AS whole FROM p))" for c in columns)


def _first_bits(bits: int) -> str:
    """CTEs that end in sims(whole, width, u): the first bits of the SimHash of the BLAKE3 of all grams."""
    part = lambda k: f"(CAST('0x' || substr(h, {8 * (k // 32) + 1}, 8) AS BIGINT) >> {31 - k % 32}) & 1"
    return f"sims AS MATERIALIZED (SELECT whole, width, {' + '.join(f'CASE WHEN 2 * sum({part(k)}) >= count(*) THEN {1 << (bits - 1 - k)}::HUGEINT ELSE 0 END' for k in range(bits))} AS u FROM grams JOIN hashed ON id = gram GROUP BY whole, width)"


def _least_bits(features: str) -> str:
    """One 64-bit number for each gram of features: the lowest bits of its MinHash, as the first 64 bits of the digest of one feature."""
    return f"SELECT gram, sum((((a * f + b) % {_WIDE}) % {MINHASH_PRIME} % 2) * (1::HUGEINT << (63 - i)::INT)) AS u FROM {features}, (VALUES {_PERMUTATIONS}) v(i, a, b) GROUP BY gram"


_PLAIN = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_BITS_APART = "CAST(bit_count(xor({0}::HUGEINT, {1}::HUGEINT)) AS INT)"

#: Ends of chunks of 1,024 bytes on average: 256 to 8,192 bytes, a longer mask up to byte 640; a negative number is an end that was found.
_CHUNK_END = "list_reduce(g[pos + 257:least(pos + 8192, len(g))], lambda h, x, i: CASE WHEN h < 0 THEN h WHEN ((h >> 1) + x) & (CASE WHEN i + 256 <= 640 THEN 2047 ELSE 511 END) = 0 THEN -(i + 256) ELSE (h >> 1) + x END, 0::BIGINT)"

ORACLES = {
    "byte_cuts": r"""
WITH c AS (SELECT doc_id, text, CASE WHEN text IS NOT NULL THEN len(list_filter(range(0, least(length(text), 61) + 1), lambda k: strlen(substr(text, 1, CAST(k AS INT))) <= 61)) - 1 END AS k FROM documents),
b AS (SELECT doc_id, text, substr(text, 1, CAST(k AS INT)) || CASE WHEN strlen(text) > 61 AND strlen(substr(text, 1, CAST(k AS INT))) < 61 THEN chr(65533) ELSE '' END AS cut FROM c)
SELECT doc_id, cut, regexp_replace(cut, '^[\t\n\x0b\x0c\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\t\n\x0b\x0c\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$', '', 'g') AS trimmed, rtrim(cut, 'aeiou.') AS stem FROM b
""",
    "part_text_codes": f"WITH {_PART_CODES} SELECT p_partkey, code, characters, digest FROM coded",
    "explained_codes": f"""
WITH {_PART_CODES}
SELECT p_partkey, code, 'CONTENT-TEXT-V0-64-' || substr(digest, 1, 16) AS explained, 'CONTENT-TEXT-V0-64' AS type_id, 'z' || {base58(_OF_MF, 17)} AS base58btc, true AS shaped, true AS valid, code AS again FROM coded
""",
    "mixed_codes": f"""
WITH {_PART_CODES},
w AS (SELECT p_brand, {0x20}::HUGEINT * 72057594037927936 + u::HUGEINT // 256 AS w FROM coded),
bits AS (SELECT p_brand, k, 2 * sum((w // (1::HUGEINT << (63 - k)::INT)) % 2) >= count(*) AS bit FROM w, range(64) r(k) GROUP BY p_brand, k),
s AS (SELECT p_brand, sum(CASE WHEN bit THEN 1::HUGEINT << (63 - k)::INT ELSE 0 END) AS s FROM bits GROUP BY p_brand)
SELECT p_brand, 'ISCC:' || {base32(f"{0x2401}::HUGEINT * {_WIDE} + s::HUGEINT", 16)} AS code FROM s
""",
    "customer_instances": f"""
WITH {blake3("customer", "c_custkey", "c_name")}
SELECT id AS c_custkey, 'ISCC:' || {letters("('4001' || substr(h, 1, 16))", 80)} AS code, '1e20' || h AS datahash, strlen(c_name) AS filesize FROM hashed JOIN customer ON id = c_custkey
""",
    "wallet_ids": f"""
WITH {blake3("customer", "c_custkey", "c_name")},
n AS MATERIALIZED (SELECT c_custkey, c_name, '40' || substr(h, 1, 14) AS s, sha256(c_name) AS w FROM hashed JOIN customer ON id = c_custkey),
d AS (SELECT c_custkey, s, concat({", ".join(f"lpad(lower(to_hex(xor(CAST('0x' || substr(s, {8 * i + 1}, 8) AS BIGINT), CAST('0x' || substr(w, {8 * i + 1}, 8) AS BIGINT)))), 8, '0')" for i in range(2))}) AS x FROM n)
SELECT c_custkey, 'ISCC:' || {letters("('6200' || x)", 80)} AS id, substr({letters("('6201' || x || '0100')", 96)}, 1, 18) AS next, s AS simhash FROM d
""",
    "unit_views": f"""
WITH s AS (SELECT p_partkey, sha256(p_name) AS h, sha256(p_type) AS k FROM part),
n AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT)::HUGEINT * {_32} + CAST('0x' || substr(h, 9, 8) AS BIGINT) AS u, CAST('0x' || substr(k, 1, 8) AS BIGINT)::HUGEINT * {_32} + CAST('0x' || substr(k, 9, 8) AS BIGINT) AS q FROM s),
c AS (SELECT *, {base32(f"{0x3001}::HUGEINT * {_WIDE} + u", 16)} AS b, list_sum(list_transform(range(0, 16), lambda i: bit_count(xor(CAST('0x' || substr(h, CAST(i + 1 AS INT), 1) AS INT), CAST('0x' || substr(k, CAST(i + 1 AS INT), 1) AS INT))))) AS d,
  list_sum(list_transform(range(0, 12), lambda i: bit_count(xor(CAST('0x' || substr(h, CAST(i + 1 AS INT), 1) AS INT), CAST('0x' || substr(k, CAST(i + 1 AS INT), 1) AS INT))))) AS e FROM n)
SELECT p_partkey, 'ISCC:' || b AS code, 3 AS main, 0 AS sub, 0 AS version, 1 AS length, substr(h, 1, 16) AS body, 'DATA-NONE-V0-64' AS type_id, 'DATA-NONE-V0-64-' || substr(h, 1, 16) AS explained,
  CAST({0x3001}::HUGEINT * {_WIDE} + u AS VARCHAR) AS uint, CAST(u AS VARCHAR) AS hash_uint, 'fcc013001' || substr(h, 1, 16) AS base16, 'z' || {base58(f"({0xCC013001}::HUGEINT * {_WIDE} + u)", 17)} AS base58btc, lower('b' || {letters("('cc013001' || substr(h, 1, 16))", 96)}) AS mf_base32,
  'u' || replace(replace(to_base64(unhex('cc013001' || substr(h, 1, 16))), '+', '-'), '/', '_') AS base64url, translate(b, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', '0123456789ABCDEFGHIJKLMNOPQRSTUV') AS base32hex,
  'ISCC:' || b AS again, true AS valid, false AS cut_valid, true AS valid_mf, CAST(d AS INT) AS distance, CAST(floor((64 - d) * 100 / 64.0) AS INT) AS similarity, 48 AS common, 1 - e / 48.0::DOUBLE AS prefix_similarity,
  'ISCC:' || {letters("('0007' || h)", 272)} AS long_code, 'META-NONE-V0-256' AS long_type FROM c
""",
    "composites": f"""
WITH s AS (SELECT p_partkey, substr(sha256(p_name), 1, 32) AS m, substr(sha256(p_type), 1, 32) AS t, substr(sha256(p_brand), 1, 32) AS d, substr(sha256(p_container), 1, 32) AS s FROM (SELECT p_partkey, p_name, p_type, p_brand, p_name || p_type AS p_container FROM part))
SELECT p_partkey, 'ISCC:' || {letters("('5005' || substr(m, 1, 16) || substr(t, 1, 16) || substr(d, 1, 16) || substr(s, 1, 16))", 272)} AS code, 'ISCC:' || {letters("('5700' || d || s)", 272)} AS wide, 'ISCC:' || {letters("('5500' || substr(d, 1, 16) || substr(s, 1, 16))", 144)} AS sum_code,
  concat_ws(' ', {letters("('0001' || substr(m, 1, 16))", 80)}, {letters("('2001' || substr(t, 1, 16))", 80)}, {letters("('3001' || substr(d, 1, 16))", 80)}, {letters("('4001' || substr(s, 1, 16))", 80)}) AS units,
  'ISCC-TEXT-V0-MCDI' AS type_id, true AS again, true AS wide_units FROM s AS z
""",
    "token_ids": "SELECT doc_id, 'f01551220' || sha256(coalesce(text, '')) AS cid, true AS same, unhex(sha256(coalesce(text, ''))) IS NOT NULL AS sound FROM documents WHERE strlen(coalesce(text, '')) <= 262144",
    "data_chunks": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT page_id, list_transform(regexp_extract_all(lower(hex(encode(html))), '..'), lambda b: list_extract([{", ".join(f"{g}::BIGINT" for g in GEAR)}], CAST('0x' || b AS INT) + 1)) AS g FROM pages WHERE html IS NOT NULL),
c AS (
  SELECT page_id, -1 AS no, 0::BIGINT AS begins, 0::BIGINT AS pos FROM d
  UNION ALL
  SELECT page_id, no + 1, pos, CASE WHEN e < 0 THEN pos - e ELSE least(pos + 8192, n) END FROM (SELECT c.page_id, no, pos, len(g) AS n, {_CHUNK_END} AS e FROM c JOIN d USING (page_id) WHERE pos < len(g) OR no < 0)
)
SELECT page_id, CAST(no AS INT) AS no, CAST(begins AS INT) AS "offset", CAST(pos - begins AS INT) AS size FROM c WHERE no >= 0
""",
    "meta_codes": f"""
WITH p AS MATERIALIZED (SELECT p_partkey, p_name, {_PLAIN.format("p_name")} AS t, '{{"p_brand":"' || p_brand || '","p_size":' || p_size || ',"p_retailprice":' || regexp_replace(p_retailprice::VARCHAR, '[.]0$', '') || '}}' AS payload FROM part),
grams AS MATERIALIZED ({_grams(3, "t")} UNION ALL {_grams(4, "payload")}),
x AS MATERIALIZED (SELECT DISTINCT gram AS x FROM grams UNION SELECT DISTINCT payload FROM p),
{blake3("x", "x", "x")},
{_first_bits(32)}
SELECT p_partkey, 'ISCC:' || {base32(f"1::HUGEINT * {_WIDE} + n.u * {_32} + m.u", 16)} AS code, '1e20' || h AS metahash, p_name AS name, 'data:application/json;base64,' || to_base64(encode(payload)) AS meta
FROM p JOIN sims n ON n.whole = t AND n.width = 3 JOIN sims m ON m.whole = payload AND m.width = 4 JOIN hashed ON id = payload
""",
    "compared_assets": f"""
WITH p AS MATERIALIZED (SELECT p_partkey, {_PLAIN.format("p_name")} AS t, {_PLAIN.format("p_type")} AS y, p_name || ' ' || p_type AS data FROM part),
grams AS MATERIALIZED ({_grams(3, "t")}),
x AS MATERIALIZED (SELECT DISTINCT gram AS x FROM grams UNION SELECT DISTINCT data FROM p),
{blake3("x", "x", "x")},
{_first_bits(64)},
s AS MATERIALIZED (SELECT DISTINCT y AS s FROM p UNION SELECT DISTINCT data FROM p),
{xxh32("s", "s")},
l AS MATERIALIZED ({_least_bits("features")}),
u AS MATERIALIZED (SELECT p_partkey, sims.u AS m, c.u AS t, d.u AS x, substr(h, 1, 16) AS i FROM p JOIN sims ON whole = p.t JOIN l c ON c.gram = y JOIN l d ON d.gram = data JOIN hashed ON id = data)
SELECT a.p_partkey AS pair, {_BITS_APART.format("a.m", "b.m")} AS meta_dist, NULL::INT AS semantic_dist, {_BITS_APART.format("a.t", "b.t")} AS content_dist, {_BITS_APART.format("a.x", "b.x")} AS data_dist, NULL::INT AS id_dist, NULL::INT AS flake_dist, a.i = b.i AS instance_match, NULL::BOOLEAN AS id_match
FROM u a JOIN u b ON b.p_partkey = a.p_partkey + 1
""",
}
