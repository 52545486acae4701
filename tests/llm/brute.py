"""Plain re-statements of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def removed(rows, length=50):
    """(id, text) rows: bytes, removed, spans, rest of each, in the order of the rows."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), {}
    for _, group in itertools.groupby(order, key=lambda i: rows[i][0]):
        group = list(group)
        for i in group:
            b = (rows[i][1] or "").encode()
            gone = [False] * len(b)
            for p in range(len(b) - length + 1):
                if b[p : p + length] in seen:
                    gone[p : p + length] = [True] * length
            spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
            out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
        for i in group:
            b = (rows[i][1] or "").encode()
            seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    return [out[i] for i in range(len(rows))]


def shingles(text, k=3):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(rows, percent=90, k=3):
    """(id, text) rows with different ids: size, component and links by id."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i), links[i]) for i, s in sets.items()}


def connected(n, pairs):
    """The groups of two or more of ``n`` things that pairs connect."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out, seen = [], set()
    for i in range(n):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                new = near[todo.pop()] - group
                group |= new
                todo += new
            seen |= group
            if len(group) > 1:
                out.append(group)
    return out


def quality(text, window=8):
    w = words(text)
    n = len(w)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + window]) for i in range(n - window + 1))
    cover, copies, earlier = set(), set(), set()
    for i in range(n - window + 1):
        g = tuple(w[i : i + window])
        if seen[g] > 1:
            cover.update(range(i, i + window))
        if g in earlier:
            copies.update(range(i, i + window))
        earlier.add(g)
    longest = 0
    for a in range(n):
        for b in range(a + 1, n):
            k = 0
            while b + k < n and w[a + k] == w[b + k]:
                k += 1
            longest = max(longest, k)
    return {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(cover), "n_copy_words": len(copies), "longest_repeat": longest,
    }


def normal_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def leaks(text, items, k=5, least=0.8):
    """Items with a window of their own length that is similar enough, with the best similarity."""
    def grams(w):
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []

    sets = {i: Counter(grams(normal_words(t))) for i, t in items}
    df = Counter(g for s in sets.values() for g in s)
    weight = lambda g: 1 + math.log((1 + len(items)) / (1 + df.get(g, 0)))
    w, out = normal_words(text), {}
    for i, t in items:
        m = len(normal_words(t))
        if not m:
            continue
        for s in range(max(0, len(w) - m) + 1):
            got = Counter(grams(w[s : s + m]))
            keys = got.keys() | sets[i].keys()
            top = sum(min(got[g], sets[i][g]) * weight(g) for g in keys)
            all_ = sum(max(got[g], sets[i][g]) * weight(g) for g in keys)
            if all_ and top / all_ >= least:
                out[i] = max(out.get(i, 0), top / all_)
    return out


def licences(text, templates, least=0.8):
    w, out = normal_words(text), {}
    lines = [normal_words(x) for x in (text or "").split("\n")]

    def dice(a, b):
        a, b = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
        total = sum(a.values()) + sum(b.values())
        return 2 * sum((a & b).values()) / total if total else 0

    for name, t in templates:
        b = normal_words(t)
        places = [w[s : s + len(b)] for s in range(len(w) - len(b) + 1)] + lines
        best = max((dice(x, b) for x in places), default=0)
        if best >= least:
            out[name] = max(out.get(name, 0), best)
    return out


class KneserNey:
    """Modified Kneser-Ney over bytes, straight from the definition."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = {order: Counter()}
        for t in texts:
            b = b"\0" * (order - 1) + t
            self.counts[order].update(b[i : i + order] for i in range(len(b) - order + 1))
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.d, self.by_context = {}, {}
        for n, c in self.counts.items():
            k = [sum(1 for v in c.values() if v == i) for i in (1, 2, 3, 4)]
            if min(k[:3]) == 0:
                self.d[n] = [0.5, 0.75, 0.9]
            else:
                y = k[0] / (k[0] + 2 * k[1])
                self.d[n] = [min(max(i + 1 - (i + 2) * y * k[i + 1] / k[i], 0.05), i + 0.95) for i in range(3)]
            of = defaultdict(dict)
            for g, v in c.items():
                of[g[:-1]][g] = v
            self.by_context[n] = of

    def p(self, gram):
        if not gram:
            return 1 / 256
        n = len(gram)
        known = self.by_context[n].get(gram[:-1])
        if not known:
            return self.p(gram[1:])
        total = sum(known.values())
        cut = lambda v: self.d[n][min(v, 3) - 1]
        own = (known[gram] - cut(known[gram])) / total if gram in known else 0
        return own + sum(map(cut, known.values())) / total * self.p(gram[1:])

    def nll(self, text):
        b = b"\0" * (self.order - 1) + text
        return -sum(math.log(self.p(b[i : i + self.order])) for i in range(len(text)))


def sha256(b):
    return hashlib.sha256(b).hexdigest()


def language_columns(text, dimensions):
    """How often each hashed column occurs among the 1- to 3-grams of a text's letters."""
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " " for c in text or "")
    if not letters.strip(" "):
        return Counter()
    letters, found, whole = f" {' '.join(letters.split(' ')).strip()} ", Counter(), 1 << 64
    letters = re.sub(" +", " ", letters)
    for k in (1, 2, 3):
        for i in range(len(letters) - k + 1):
            h = 0
            for c in letters[i : i + k]:
                h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % whole
                h ^= h >> 29
            found[((h + k) * 0xD6E8FEB86659FD93 % whole) * dimensions >> 64] += 1
    return found


def languages(rows, dimensions, per_lang, tuning, alpha, beta, l1, l2, epochs):
    """(id, lang, text) rows: language and score of each, by FTRL-proximal one coordinate at a time."""
    learned = [r for r in rows if r[1] is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5]
    langs = sorted({r[1] for r in learned})
    documents = [language_columns(r[2], dimensions) for r in learned]
    held = Counter(c for d in documents for c in d)
    idf = lambda c: math.log((1 + len(documents)) / (1 + held[c])) + 1

    def vector(found):
        v = {c: (1 + math.log(n)) * idf(c) for c, n in found.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {c: v[c] / size for c in sorted(v)}

    sample = []
    for y, lang in enumerate(langs):
        texts = sorted({(xxhash.xxh64_intdigest((r[2] or "").encode(), 42) & ((1 << 63) - 1), r[2] or "") for r in learned if r[1] == lang})
        sample += [(place, lang, y, language_columns(t, dimensions)) for place, (_, t) in enumerate(texts[:per_lang])]
    sample = [(p, y, vector(f)) for p, _, y, f in sorted(sample, key=lambda r: r[:2]) if f]
    fitting, tuned = ([r for r in sample if (r[0] % tuning == tuning - 1) == t] for t in (False, True))
    fitting = fitting or tuned
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    bias = dimensions
    logits = lambda v: [sum(weight((c, y)) * x for c, x in [*v.items(), (bias, 1.0)]) for y in range(len(langs))]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(fitting)):
            _, y, v = fitting[i]
            p = softmax(logits(v))
            before = {(c, k): weight((c, k)) for c in [*v, bias] for k in range(len(langs))}
            for c, x in [*v.items(), (bias, 1.0)]:
                for k in range(len(langs)):
                    g = x * (p[k] - (k == y))
                    z[c, k] += g - (math.sqrt(n[c, k] + g * g) - math.sqrt(n[c, k])) / alpha * before[c, k]
                    n[c, k] += g * g
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    shown = [(logits(v), y) for _, y, v in tuned]
    heat = min(grid, key=lambda t: sum(-math.log(softmax([x / t for x in row])[y] + 1e-300) for row, y in shown)) if shown else 1.0
    out = []
    for _, _, text in rows:
        found = language_columns(text, dimensions)
        p = softmax([x / heat for x in logits(vector(found))]) if found and fitting else None
        out.append((langs[p.index(max(p))], max(p)) if p else ("und", 0.0))
    return out
