"""Whitening, token alignment and fingerprints against plain re-statements and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import op11_whitening as op11
from tidemark.llm import op12_token_alignment as op12
from tidemark.llm import op13_fingerprints as op13

VECTORS = "vec_id long, embedding array<float>"


def plain_whitening(rows):
    """By vec_id: deviation and the first four whitened coordinates, from the whole covariance matrix."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in kept)
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (dims - len(v)) for _, v in kept], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return [i for i, _ in kept], n, deviation, ((x - s / n) @ vector[:, :4]) / np.sqrt(value[:4]), value[:4] / value.sum()


def vectors(rng, n=400, dims=20):
    base = rng.standard_normal((n, dims)) * np.linspace(3, 0.5, dims)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(n + i, rows[7][1]) for i in range(50)] + [(7, rows[7][1]), (None, rows[9][1])]
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")] * dims), (903, [float("inf")] * dims), (904, []), (905, [1.5, -2.0]), (906, [-0.0] * dims)]
    return rows


def test_whitening(spark):
    rows = vectors(np.random.default_rng(3))
    table = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({"x": F.lit(1), "n": F.lit("a"), "component": F.lit(None)})
    fitted = op11.fit_whitening(table)
    got = op11.whiten(table, fitted).toPandas()
    ids, n, deviation, whitened, share = plain_whitening(rows)
    assert len(got) == 4 * len(ids) and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    for c in range(4):
        own = got[got.component == c + 1].sort_values(["vec_id", "whitened"])
        want = sorted(zip([math.inf if i is None else i for i in ids], deviation, whitened[:, c], strict=True), key=lambda r: r[0])
        a, b = own.whitened.to_numpy(), np.array([w[2] for w in want])
        sign = np.sign(a @ b)
        assert np.abs(a - sign * b).max() < 1e-9
        assert own.deviation.tolist() == [w[1] for w in want]
        assert np.allclose(own.explained, share[c], rtol=1e-9)


def test_lanczos_products_and_restarts():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    # Equal eigenvalues, and a space of which every block reaches only a part: both need restarts.
    for values in (np.r_[[5.0] * 3, np.zeros(57)], np.r_[9, 7, 7, 7, np.linspace(1, 0, 56)], np.ones(60)):
        matrix = (q * values) @ q.T
        value, vector, passes = op11.block_lanczos(lambda v, m=matrix: m @ v, 60, 4, block=4)
        assert np.allclose(value, np.sort(values)[::-1][:4], atol=1e-12)
        assert np.abs(matrix @ vector - vector * value).max() < 1e-11
        assert np.abs(vector.T @ vector - np.eye(4)).max() < 1e-12
        assert passes <= 15
    big = np.diag(np.r_[100.0, 80, 60, 40, np.linspace(1, 0, 496)])
    assert op11.block_lanczos(lambda v: big @ v, 500, 4)[2] < 15  # far from the 63 blocks of the whole space


def test_whitening_without_spread(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5]), (3, [0.5001])], [(1, []), (2, [])]):
        table = spark.createDataFrame(rows, VECTORS)
        assert op11.whiten(table, op11.fit_whitening(table)).count() == 0
    # Two dimensions have two components; huge entries are cut, and deviations that don't fit are null.
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 1.0])]
    table = spark.createDataFrame(rows, VECTORS)
    got = op11.whiten(table, op11.fit_whitening(table)).collect()
    assert len(got) == 6 and {r.component for r in got} == {1, 2}
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1e300, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = op11.whiten(huge, op11.fit_whitening(huge)).collect()
    assert got and all(r.deviation is None for r in got)
    assert op11.deviations(np.array([[3, -4]], np.int64), 10**9, [0, 0]) == [None]
    assert op11.deviations(np.array([[1 << 31, 0]], np.int64), 1, [0, 5]) == [(1 << 62) + 25]


@pytest.fixture(scope="module")
def files():
    tokenizers = pytest.importorskip("public_tokenizers")
    return [Path(tokenizers.path(name)).read_bytes() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain_alignment(rows, files):
    """Groups and links token by token."""
    a, b, _, _ = op12.tokenizers(*files)
    letters, numbers, links, holders = op12.byte_alphabet(), [], [], Counter()
    for _, text in rows:
        tokens_a = a.encode(" " + text, add_special_tokens=False) if text else None
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in t) for t in tokens_a.tokens] if text else []
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            numbers.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in part]).tolist() for part in (bytes_a, bytes_b))
        owner = lambda ends, at: next(i for i, e in enumerate(ends) if e > at)
        pairs = sorted({(owner(ends_a, at), owner(ends_b, at)) for at in range(ends_a[-1])}) if ends_a[-1] < 400 else fast_pairs(ends_a, ends_b)
        cuts, groups, first = sorted({*ends_a} & {*ends_b}), [], 0
        for cut in cuts:
            part = [",".join(str(i) for i, e in zip(ids, ends, strict=True) if first < e <= cut) for ids, ends in ((tokens_a.ids, ends_a), (ids_b, ends_b))] if len(cuts) < 200 else None
            groups.append(part and "|".join(part))
            first = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups[0] else None
        numbers.append((len(ends_a), len(ends_b), len(cuts), len(pairs), digest))
        links.append([(tokens_a.ids[i], ids_b[j]) for i, j in pairs])
        holders.update(set(links[-1]))
    top = {}
    for (i, _), n in holders.items():
        top[i] = max(top.get(i, 0), n)
    return [(*n[:4], sum(holders[p] == top[p[0]] for p in own), sum(holders[p] for p in own), n[4]) for n, own in zip(numbers, links, strict=True)]


def fast_pairs(ends_a, ends_b):
    i = j = 0
    pairs = []
    while i < len(ends_a):
        pairs.append((i, j))
        i, j = (i + (ends_a[i] <= ends_b[j]), j + (ends_b[j] <= ends_a[i]))
    return pairs


def token_rows():
    rng = random.Random(2)
    words = ["naïve", "the", "token", "  two", "12345", "日本語", "don't", "\n\n", "🦊🦊", "<|endoftext|>", "</s>", "\t x", "Ünder", "aaaaaaaa", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, " "), (43, "▁ literal"), (44, "  lead"), (45, "x" * 300), (46, rows[3][1]), (46, rows[3][1]), (None, "null id"), (47, "\0 nul"), (48, "<s>"), (49, " 　 wide")]
    return rows + [(50, " ".join(rng.choice(words) for _ in range(3000)))]


def test_token_alignment(spark, files, monkeypatch):
    rows = token_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"piece": F.lit(1), "pair": F.lit("x"), "n": F.lit(None)})
    want = Counter((i, *w) for (i, _), w in zip(rows, plain_alignment(rows, files), strict=True))
    got = Counter(tuple(r) for r in op12.align_tokens(table, *files).collect())
    plain = lambda c: Counter({k[:7]: n for k, n in c.items()})
    assert plain(got) == plain(want)
    digests = {k[:7]: k[7] for k in got}
    assert all(digests[k[:7]] == k[7] for k in want if k[7] is not None)
    assert sum(k[1] == 0 for k in got) == 3 and got[next(k for k in got if k[0] == 46)] == 2
    # Pieces and segments of any size give the same.
    for piece in (1, 2000):
        assert Counter(tuple(r) for r in op12.align_tokens(table, *files, piece=piece).collect()) == got
    empty = op12.align_tokens(table.limit(0), *files)
    assert empty.count() == 0 and [f.name for f in empty.schema] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_segments_cut_as_whole_texts_do(files, monkeypatch):
    models = op12.tokenizers(*files)
    for _, text in token_rows():
        if not text:
            continue
        whole = op12.Documents()
        whole.add([" " + text], models)
        for limit in (7, 100):
            monkeypatch.setattr(op12, "SEGMENT", limit)
            parts = op12.segments(" " + text, limit)
            assert "".join(parts) == " " + text
            cut = op12.Documents()
            cut.add_long(" " + text, models)
            assert cut.digests == whole.digests and np.array_equal(cut.numbers[0], whole.numbers[0])
            assert all(np.array_equal(x, y) for x, y in zip(cut.pairs[0], whole.pairs[0], strict=True))
    # No piece of the second vocabulary goes on over a space, so cuts before single spaces are exact.
    assert not any(re.search("[^▁]▁", models[1].id_to_piece(i)) for i in range(models[1].get_piece_size()))


def test_rank_and_select():
    rng = np.random.default_rng(5)
    places = np.flatnonzero(rng.random(1000) < 0.3)
    bits = op12.Bits.at(places, 1000)
    assert np.array_equal(bits.places(), places)
    assert np.array_equal(bits.rank(np.arange(1001)), np.searchsorted(places, np.arange(1001)))
    assert np.array_equal(np.flatnonzero(bits.has(np.arange(1000))), places)


def plain_tree(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sections, open_ = [], []
    for line in text.split("\n"):
        blocks = [sha(line[i : i + op13.BLOCK]) for i in range(0, len(line), op13.BLOCK)]
        digest = sha("p" + "".join(blocks))
        open_.append(("".join(b[:8] for b in blocks), digest))
        if digest[-1] in "08":
            sections.append(open_)
            open_ = []
    sections += [open_] if open_ else []
    digests = [sha("s" + ",".join(f"{b}.{d}" for b, d in s)) for s in sections]
    out = "r" + sha("r" + "".join(digests))
    for s, d in zip(sections, digests, strict=True):
        out += "s" + d[:8] + "".join("p" + d[:8] + b for b, d in s)
    return out


def plain_likeness(a, b):
    x, y = ({*re.findall(op13.NODE, t)} for t in (a, b))
    return 1.0 if a == b else 2.0 * len(x & y) / (len(x) + len(y))


def plain_fingerprints(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(f"{'null' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest())
    order = sorted(rows, key=key)
    for (i, text), (_, then) in zip(order, order[1:] + order[:1], strict=True):
        text, then = text or "", then or ""
        n = len(text)
        edited = text[: n - n // 3] + then[: n // 3]
        f, e, t = map(plain_tree, (text, edited, then))
        yield i, n, hashlib.sha256(edited.encode()).hexdigest(), f, e, plain_likeness(f, e), plain_likeness(f, t)


def tree_rows():
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["né", "tree", "🦊", "leaf", "b:", "s,"]) for _ in range(rng.randint(0, 60)))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 40)))) for i in range(0, 90, 3)]
    rows += [(1, None), (2, ""), (4, "\n"), (5, "\r\n a\r\n"), (7, rows[2][1]), (3, rows[1][1]), (3, rows[1][1]), (3, rows[1][1]), (None, "a"), (None, "b"), (-5, "x" * 5000), (8, "ab"), (10, "\n".join([line()] * 3000))]
    return rows


@pytest.mark.parametrize("ranges", [500_000, 7])
def test_fingerprints(spark, ranges):
    rows = tree_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"key": F.lit(1), "tree": F.lit("x"), "part": F.lit(None), "n": F.lit(2)})
    got = Counter(tuple(r) for r in op13.fingerprints(table, rows_per_range=ranges).collect())
    assert got == Counter(plain_fingerprints(rows))


def test_fingerprints_in_sql(spark):
    rows = tree_rows()
    duck = duckdb.connect()
    documents = spark.createDataFrame(rows, "doc_id long, text string").toPandas()
    duck.register("documents", documents.astype({"doc_id": "Int64"}))
    names = "doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next"
    assert Counter(duck.sql(f"SELECT {names} FROM ({op13.SQL})").fetchall()) == Counter(plain_fingerprints(rows))


def test_fingerprints_of_few(spark):
    schema = "doc_id long, text string"
    assert op13.fingerprints(spark.createDataFrame([], schema)).count() == 0
    (one,) = op13.fingerprints(spark.createDataFrame([(1, "abcdef")], schema)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    same = op13.fingerprints(spark.createDataFrame([(1, "text"), (2, "text")], schema)).collect()
    assert same[0].fingerprint == same[1].fingerprint and {r.near_next for r in same} == {1.0}


def test_edits_name_the_paragraphs(spark):
    rng = random.Random(8)
    lines = [" ".join(str(rng.random()) for _ in range(8)) for _ in range(60)]
    other = [*lines]
    other[17], other[40] = "changed", other[40] + "!"
    table = spark.createDataFrame([(1, "\n".join(lines), "\n".join(other)), (2, "same", "same")], "id long, a string, b string")
    trees = op13.fingerprint(op13.fingerprint(table, "a", "before"), "b", "after").drop("a", "b")
    got = {(r.id, r.side, r.paragraph) for r in op13.edits(trees, "id", "before", "after").collect()}
    assert got == {(1, s, p) for s in ("before", "after") for p in (17, 40)}
