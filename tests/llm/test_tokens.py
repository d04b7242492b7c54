"""Token counts and token shards against the libraries; sorted string tables by round trip."""

import io
import random
import zlib

import numpy as np
import pytest
from brute import order, sample_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import sstable, token_shards
from codeloom.llm.token_counts import count_tokens, counter
from codeloom.llm.token_shards import encoder, read_token_shards, write_token_shards

ODD = list(" ▁ab\n\t.,é　'sﬁ1\x00x\x1c  \x01😀") + ["<|endoftext|>", "'re", "  ", "<s>", "</s>", "$$$"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(0, 14))) for _ in range(n)]


def test_counts_of_every_prefix():
    c = counter("piece_bpe_32k.model")
    assert c.units_stand_alone
    for text in odd_texts(300) + ["A plain sentence, with  two  blanks.\nAnd a line. "]:
        expected = [len(c.model.encode(text[:i])) for i in range(len(text) + 1)]
        assert c.prefix_counts(text).tolist() == expected and c.count([text]) == [expected[-1]]
        for budget in (0, 1, 3):
            fits = max(i for i, n in enumerate(expected) if n <= budget)
            assert c.truncate(text, budget) == text[:fits]


@pytest.mark.parametrize("kind", ["base64", "han", "same", "blank"])
def test_prefixes_of_long_units(kind, monkeypatch):
    """100,000 characters without blanks: the library gets each of them a few times at most, not once for each prefix."""
    c, r, n = counter("piece_bpe_32k.model"), random.Random(7), 100_000
    letters = {"base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "han": [chr(k) for k in range(0x4E00, 0x9FFF)], "same": "a", "blank": " "}[kind]
    text, encode, sent = "".join(r.choices(letters, k=n)), c._encode_lengths, []

    def counted(texts):
        sent.append(sum(map(len, texts)))
        assert sum(sent) <= 4 * n
        return encode(texts)

    monkeypatch.setattr(c, "_encode_lengths", counted)
    got = c.prefix_counts(text)
    assert len(got) == n + 1
    for i in [*range(60), 1000, 4321, n // 2, n - 1, n]:
        assert got[i] == len(c.model.encode(text[:i]))
    assert c.truncate(text, 1000) == text[: int(np.flatnonzero(got <= 1000)[-1])]


def test_prefixes_within_units():
    c, r = counter("piece_bpe_32k.model"), random.Random(8)
    pieces = [p for p in c.scores if set(p) != {"▁"}]
    for k in range(300):
        parts = [lambda: r.choice(pieces).lstrip("▁"), lambda: r.choice("thinerao"), lambda: r.choice(ODD).strip(), lambda: r.choice("=-_'0e")][k % 4]
        unit = " " * r.choice((1, 1, 2, 5)) + "x" + "".join(parts() for _ in range(r.randrange(1, 30)))
        assert c._stepped(unit).tolist() == [0, *c._unit_lengths([unit[:j] for j in range(1, len(unit) + 1)])], unit


def test_count_tokens(make_docs):
    docs = sample_docs(seed=2)
    df = make_docs(docs)
    got = count_tokens(df, prefixes_into="prefixes", budget=5)
    assert got.columns == [*df.columns, "n_tokens_", "prefixes", "truncated"]
    model = counter("piece_bpe_32k.model").model
    for r in got.collect():
        n = len(model.encode(r.text or ""))
        assert r["n_tokens_"] == n == r.prefixes[-1] and len(r.prefixes) == len(r.text or "") + 1
        assert (r.truncated is None) == (r.text is None)
    assert count_tokens(make_docs([])).count() == 0


def test_limits_from_running_counts(make_docs):
    """The query's counts and limit are those of the prefix array at the ends of units."""
    c = counter("piece_bpe_32k.model")
    texts = odd_texts(100, 9) + ["a b  c"]
    for text, running in zip(texts, c.running_counts(texts), strict=True):
        ends = np.cumsum([len(u) for u in c._units(text)]) - 1
        assert running.tolist() == c.prefix_counts(text)[ends].tolist() if text else len(running) == 0
    got = count_tokens(make_docs([(i, t) for i, t in enumerate(texts)] + [(1000, None)]), limit=5)
    assert got.columns[-2:] == ["over_limit", "limit_chars"]
    for r in got.collect():
        counts = c.prefix_counts(r.text or "")
        assert r["n_tokens_"] == counts[-1] == len(c.model.encode(r.text or "")) and r.over_limit == (counts[-1] > 5)
        assert r.limit_chars == np.flatnonzero(counts <= 5)[-1]


def test_encoder_is_the_library():
    e = encoder("byte_bpe_50k.json")
    assert e.units_stand_alone
    texts = odd_texts(4000, 3) + ["Plain text, of words. And\nlines 12, too.", "a.b,c", "ends with blank ", "\n", "x\n"] + [t or "" for _, t in sample_docs()]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(token_shards, "_MOST_KEPT", 5)
    e = encoder("byte_bpe_50k.json")
    for text in odd_texts(200, 4) + ["one two three four five six seven eight"] * 3:
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(e.kept) < 30


def test_token_shards(make_docs):
    docs = sample_docs(seed=3)
    manifest = write_token_shards(make_docs(docs), shards=5)
    got = read_token_shards(manifest).orderBy("part", "slot").collect()
    tokenizer = encoder("byte_bpe_50k.json").tokenizer
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in docs]
    assert order((r.id, r.n_tokens, r.ids_crc32) for r in got) == order((d, len(x) // 4, zlib.crc32(x)) for (d, _), x in zip(docs, ids, strict=True))
    keys = [(r.id is not None, r.id or 0) for r in got]
    assert keys == sorted(keys)
    at = 0
    for r in got:
        assert r["first"] == at
        at += r.n_tokens
    assert manifest.agg({"entries": "sum"}).first()[0] == len(docs)
    assert read_token_shards(write_token_shards(make_docs([]))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.binary(max_size=40).map(lambda b: b[: len(b) // 4 * 4])), max_size=60), st.integers(0, 2**62))
def test_sorted_string_table(entries, other):
    entries.sort(key=lambda e: sstable.key_of(e[0]))
    was, sstable.BLOCK = sstable.BLOCK, 64
    try:
        out = io.BytesIO()
        w = sstable.Writer(out)
        for k, v in entries:
            w.add(k, v)
        w.close()
        r = sstable.Reader(out)
        assert list(r) == entries and r.entries == len(entries)
        for k in {k for k, _ in entries} | {other}:
            assert [x.tobytes() for x in r.get(k)] == [v for q, v in entries if q == k]
    finally:
        sstable.BLOCK = was


def test_writer_refuses_disorder():
    w = sstable.Writer(io.BytesIO())
    w.add(5, b"")
    with pytest.raises(ValueError):
        w.add(4, b"")
    with pytest.raises(ValueError):
        sstable.Reader(io.BytesIO(bytes(100)))
