"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import sql_codes
from ..functions.constants import BASE32, FRAME_PAIRS, FRAME_VALUES, MINHASH_A, MINHASH_B, MINHASH_PRIME

_PERMUTATIONS = ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(zip(MINHASH_A, MINHASH_B, strict=True)))
_SIMHASHES = """
w AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[ \\n]')) AS w FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(md5(w), 9, 8) AS BIGINT) AS lo FROM w WHERE w <> ''),
bits AS (SELECT doc_id, k, 2 * sum(CASE WHEN k < 32 THEN (hi >> (31 - k)) & 1 ELSE (lo >> (63 - k)) & 1 END) >= count(*) AS bit FROM h, range(64) r(k) GROUP BY doc_id, k),
u AS (SELECT doc_id, sum(CASE WHEN bit THEN 1::HUGEINT << (63 - k)::INT ELSE 0 END) AS u FROM bits GROUP BY doc_id),
s AS MATERIALIZED (SELECT doc_id, u::HUGEINT AS u, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS word FROM u)
"""


def _base32(number: str, chars: int) -> str:
    """Letters of a HUGEINT of 5 * chars bits."""
    return "concat(" + ", ".join(f"substr('{BASE32}', CAST((({number}) // {1 << 5 * (chars - 1 - i)}::HUGEINT) % 32 AS INT) + 1, 1)" for i in range(chars)) + ")"


_AUDIO_BITS = "CAST(" + " + ".join(f"CASE WHEN 2 * sum((x >> {31 - k}) & 1) >= count(*) THEN {1 << (31 - k)} ELSE 0 END" for k in range(32)) + " AS BIGINT)"
_HOUR = "time_bucket(INTERVAL 1 HOUR, ts)"

ORACLES = {
    "frame_sums": """
WITH f AS (SELECT DISTINCT label, [CAST(floor(CAST(x AS DOUBLE) * 100) AS INT) FOR x IN embedding] AS v FROM embeddings)
SELECT label, place - 1 AS place, CAST(sum(x) AS BIGINT) AS total FROM (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS place FROM f) GROUP BY label, place
""",
    "audio_digests": f"""
WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey) AS v, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
e AS (SELECT l_orderkey, l_partkey & 4294967295 AS x, unnest([0, 1 + CAST(floor((p - 1) / ceil(n / 4.0)) AS INT), 5 + CAST(floor((v - 1) / ceil(n / 3.0)) AS INT)]) AS part FROM r),
h AS (SELECT l_orderkey, part, {_AUDIO_BITS} AS h FROM e GROUP BY l_orderkey, part),
w AS (SELECT l_orderkey, {", ".join(f"coalesce(max(CASE WHEN part = {p} THEN h END), 0) AS p{p}" for p in range(8))} FROM h GROUP BY l_orderkey)
SELECT l_orderkey, concat({", ".join(f"lpad(lower(to_hex(p{p})), 8, '0')" for p in range(8))}) AS digest,
  'ISCC:' || {_base32(f"{0x2201}::HUGEINT * 18446744073709551616 + p0::HUGEINT * 4294967296 + p1", 16)} AS code FROM w
""",
    "minhashes": f"""
WITH p(i, a, b) AS (VALUES {_PERMUTATIONS}),
m AS (SELECT l_orderkey, i, min(((a * l_partkey + b) % 18446744073709551616) % {MINHASH_PRIME} % 4294967296) AS m FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p GROUP BY l_orderkey, i)
SELECT l_orderkey, CAST(max(CASE WHEN i = 0 THEN m END) AS BIGINT) AS m0, CAST(max(CASE WHEN i = 63 THEN m END) AS BIGINT) AS m63, CAST(sum(m) AS BIGINT) AS total,
  lpad(lower(to_hex(CAST(sum((m % 2) * (1::HUGEINT << (63 - i)::INT)) AS UBIGINT))), 16, '0') AS digest_64 FROM m GROUP BY l_orderkey
""",
    "simhashes": f"WITH {_SIMHASHES} SELECT doc_id, lpad(lower(to_hex(CAST(u AS UBIGINT))), 16, '0') AS digest FROM s",
    "similar_documents": f"""
WITH {_SIMHASHES}, d AS MATERIALIZED (SELECT word, count(*) AS n FROM s GROUP BY word),
p AS (SELECT x.word, sum(y.n) AS near, min(bit_count(xor(x.word, y.word))) AS nearest FROM d x JOIN d y ON x.word <> y.word AND bit_count(xor(x.word, y.word)) <= 3 GROUP BY x.word)
SELECT doc_id, d.n - 1 AS copies, CAST(coalesce(near, 0) AS BIGINT) AS near, nearest FROM s JOIN d USING (word) LEFT JOIN p USING (word) WHERE d.n > 1 OR near IS NOT NULL
""",
    "similar_pairs": f"""
WITH {_SIMHASHES}, d AS MATERIALIZED (SELECT DISTINCT word FROM s)
SELECT x.word AS a, y.word AS b, CAST(bit_count(xor(x.word, y.word)) AS BIGINT) AS distance FROM d x JOIN d y ON x.word < y.word AND bit_count(xor(x.word, y.word)) <= 6
""",
    "nearest_documents": f"""
WITH {_SIMHASHES}, d AS MATERIALIZED (SELECT DISTINCT word FROM s)
SELECT * FROM (SELECT x.word AS a, y.word AS b, CAST(bit_count(xor(x.word, y.word)) AS BIGINT) AS distance, row_number() OVER (PARTITION BY x.word ORDER BY bit_count(xor(x.word, y.word)), y.word) AS rank
FROM d x JOIN d y ON x.word <> y.word AND bit_count(xor(x.word, y.word)) <= 12) WHERE rank <= 2
""",
    "time_ids": f"""
SELECT event_id, 'ISCC:' || {_base32(f"{0x6010}::HUGEINT * 18446744073709551616 + (epoch_us(ts)::HUGEINT * 4096 + user_id % 4096)", 16)} AS time_id FROM events
""",
    "content_ids": "SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) <= 262144 THEN 'f01551220' || sha256(coalesce(text, '')) END AS cid FROM documents",
    "instance_units": f"""
WITH h AS (SELECT c_custkey, c_name, CAST('0x' || substr(sha256(c_name), 1, 8) AS BIGINT)::HUGEINT * 4294967296 + CAST('0x' || substr(sha256(c_name), 9, 8) AS BIGINT) AS v FROM customer),
b AS (SELECT c_custkey, string_agg(lpad(to_binary(ord(c_name[i:i])), 8, '0'), '' ORDER BY i) AS bits FROM (SELECT c_custkey, c_name, unnest(range(1, length(c_name) + 1)) AS i FROM customer) GROUP BY c_custkey),
g AS (SELECT c_custkey, string_agg(substr('0123456789ABCDEFGHIJKLMNOPQRSTUV', (CAST('0b' || rpad(substr(bits, 5 * k + 1, 5), 5, '0') AS INT)) + 1, 1), '' ORDER BY k) AS t FROM (SELECT c_custkey, bits, unnest(range(0, CAST(ceil(length(bits) / 5.0) AS INT))) AS k FROM b) GROUP BY c_custkey)
SELECT h.c_custkey, 'ISCC:' || {_base32(f"{0x4001}::HUGEINT * 18446744073709551616 + v", 16)} AS code, t AS name_base32hex FROM h JOIN g USING (c_custkey)
""",
    "exact_duplicates": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "marked_duplicates": "SELECT doc_id, CASE WHEN text IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY text) THEN min(doc_id) OVER (PARTITION BY text) END AS duplicate_of FROM documents",
    "unknown_turns": "SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations o WHERE o.role <> 'user' AND o.text = c.text)",
    "known_turns": "SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND EXISTS (SELECT 1 FROM conversations o WHERE o.turn = 0 AND o.text = c.text)",
    "duplicates_rollup": "SELECT source, lang, count(*) AS documents, count(DISTINCT text) AS texts FROM documents GROUP BY ROLLUP (source, lang)",
    "text_windows": "SELECT p_name[i:i + 2] AS gram, count(*) AS n FROM (SELECT p_name, unnest(range(1, greatest(length(p_name) - 2, 1) + 1)) AS i FROM part) GROUP BY 1",
    "plain_text": r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\t\n\x0b\x0c\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'), ' ') AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, line, CAST(length(line) + length(regexp_replace(line, '[^\x{10000}-\x{10ffff}]', '', 'g')) AS BIGINT) AS units, CAST(length(trim(substr(regexp_replace(line, '[^\x20-\x7e]', '', 'g'), 1, 64))) AS BIGINT) AS cut FROM t
""",
    "name_pieces": """
WITH p AS (SELECT p_partkey, p_name, p_type, [substr(p_name, i * 4 + 1, 4) FOR i IN range(0, CAST(ceil(length(p_name) / 4.0) AS BIGINT))] AS q FROM part),
s AS (SELECT *, CAST(ceil(len(q) / 4.0) AS BIGINT) AS step FROM p)
SELECT p_partkey, array_to_string(q, '|') AS pieces, array_to_string([array_to_string(q[i * step + 1:i * step + step], '+') FOR i IN [0, 1, 2, 3]], '|') AS quarters, p_name || '|' || p_type || '|x|y' AS mixed FROM s
""",
    "data_urls": "SELECT event_id, 'data:application/json;base64,' || to_base64(encode(props)) AS url, props AS payload, rtrim(replace(replace(to_base64(encode(props)), '+', '-'), '/', '_'), '=') AS b64url FROM events",
    "hourly_events": f"SELECT {_HOUR} AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_events": "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY 1, 2",
    "event_sessions": """
WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s
""",
}


def _frame_codes() -> str:
    """Codes of 128 bits: header of 16 bits, then the digest; 144 bits are 28 letters and four bits."""
    values = f"[CAST(floor(CAST(embedding[i % len(embedding) + 1] AS DOUBLE) * 100) AS INT) FOR i IN range(0, {FRAME_VALUES})]"
    bits = "concat(" + ", ".join(f"CASE WHEN t[{b + 1}] > t[{a + 1}] THEN '1' ELSE '0' END" for a, b in FRAME_PAIRS[:128]) + ")"
    letters = "concat(" + ", ".join(f"substr('{BASE32}', CAST('0b' || substr(x, {5 * i + 1}, 5) AS INT) + 1, 1)" for i in range(29)) + ")"
    return f"""
WITH f AS (SELECT DISTINCT label, {values} AS v FROM embeddings),
s AS (SELECT label, place, sum(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(1, {FRAME_VALUES} + 1)) AS place FROM f) GROUP BY label, place),
l AS (SELECT label, list(x ORDER BY place) AS t FROM s GROUP BY label),
b AS (SELECT label, '{0x2303:016b}' || {bits} || '0' AS x FROM l)
SELECT label, 'ISCC:' || {letters} AS code FROM b
"""


ORACLES["frame_codes"] = _frame_codes()
ORACLES |= sql_codes.ORACLES
