"""Plain Python versions of the operators, and documents to try them on."""

import hashlib
import random
import re
from collections import Counter, defaultdict

BLANKLESS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return BLANKLESS.findall(text or "")


def sample_docs(n=60, seed=1, vocabulary=60, most=80):
    """Random texts with copies, near copies, shared passages, hot and odd ones, nulls and repeated rows."""
    r = random.Random(seed)
    vocab = [f"w{i}" if i % 7 else f"Wört{i}" for i in range(vocabulary)]
    passage = " ".join(r.choices(vocab, k=30))
    docs = []
    for i in range(n):
        text = " ".join(r.choices(vocab, k=r.randrange(0, most)))
        kind = r.randrange(8)
        if kind == 0 and docs:
            text = r.choice(docs)[1] or ""
        elif kind == 1 and docs:
            w = words(r.choice(docs)[1])
            if w:
                w[r.randrange(len(w))] = "changed"
            text = "  ".join(w)
        elif kind == 2:
            text = f"{text}\n{passage}\n{text[:20]}"
        elif kind == 3:
            text = "\n".join([text[:40]] * 3)
        docs.append((i * 3 % 101, text))
    docs += [(1000 + i, passage.upper() if i == 2 else passage) for i in range(n // 3)]
    docs += [(2000, None), (2001, ""), (2002, " \n\t "), (None, passage), (None, None), (None, "only one"), (2003, "one"), (2004, "one two"), (2005, "ONE two"), docs[0], docs[0], (2006, " ".join(r.choices(vocab, k=6000)))]
    r.shuffle(docs)
    return docs


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def groups(docs, width, percent, numbers=False):
    """Rows (doc_id, size, component) of the similarity join; or each document's group, by number."""
    sets = [shingles(t, width) for _, t in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = sorted((top(i), top(j)))
                    up[b] = a
    if numbers:
        return [top(i) for i in range(len(docs))]
    least = {}
    order = lambda d: (d is not None, d)
    for i, (d, _) in enumerate(docs):
        t = top(i)
        if t not in least or order(d) < order(least[t]):
            least[t] = d
    return [(d, len(sets[i]), least[top(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)]


def without_repeats(docs, width):
    """Rows (doc_id, words, removed, kept) of the substring removal."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, hashlib.md5((docs[i][1] or "").encode()).digest()))
    seen, out = set(), []
    for i in order:
        w = words(docs[i][1])
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            key = tuple(w[a : a + width])
            if key in seen:
                gone[a : a + width] = [True] * width
            seen.add(key)
        out.append((docs[i][0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def contaminated(docs, items, width):
    """Rows (doc_id, words, hit, item ids) of the decontamination."""
    phrases = defaultdict(set)
    for i, t in items:
        w = LETTERS.findall((t or "").translate(LOWER))
        m = min(width, len(w))
        for a in range(len(w) - m + 1) if w else ():
            phrases[tuple(w[a : a + m])].add("" if i is None else str(i))
    sizes, out = {len(p) for p in phrases}, []
    for d, t in docs:
        w = LETTERS.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in phrases:
                    hit[a : a + m] = [True] * m
                    found |= phrases[tuple(w[a : a + m])]
        out.append((d, len(w), sum(hit), sorted(found), spans(hit)))
    return out


def spans(hit):
    out, a = [], None
    for i, h in enumerate([*hit, False]):
        if h and a is None:
            a = i
        elif not h and a is not None:
            out.append((a, i))
            a = None
    return out


def counts(text):
    """word_chars, symbols, repeated lines, repeated words of the quality statistics."""
    t = text or ""
    w = words(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))
