"""The corpus pipeline against plain re-statements of its stages, and on odd rows."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline

from . import brute
from .test_operators import prose


def corpus():
    rng = random.Random(12)
    rows, items = [], [(i, prose(rng, 18)) for i in range(3)]
    passage = prose(rng, 60)
    for i in range(60):
        text = prose(rng, rng.randint(25, 120))
        if i % 9 == 1:
            text += " " + passage + " " + prose(rng, 20)
        if i % 13 == 2:
            text = prose(rng, 12) + " " + items[i % 3][1] + " " + text
        if i % 11 == 3:
            text = "\n".join([prose(rng, 10)] * 8)
        if i % 10 == 4 and rows:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "zz"
            text = " ".join(words)
        if i % 17 == 5 and rows:
            text = rows[-2][1]
        rows.append((i, text, "en", f"s{i % 4}" if i % 7 else None, len(text)))
    rows += [(60, None, None, None, None), (61, "", "en", "s1", 0), (62, passage, "en", "s2", len(passage))]
    return rows, items


def plain(rows, items):
    """What each stage leaves, as (id, text)."""
    left = [(d, t) for d, t, *_ in rows]
    stages = []

    def kept(t):
        q = brute.quality(t)
        n = q["n_words"]
        return n >= 20 and 100 * q["n_repeat_words"] <= 30 * n and 100 * q["n_copy_words"] <= 20 * n and q["longest_repeat"] <= 100

    stages.append(left := [(d, t) for d, t in left if kept(t)])
    group = brute.groups(left, 80, 5)
    stages.append(left := [(d, t) for d, t in left if group[d][1] == d])
    cut = brute.removed(left)
    left = [(d, c[3].decode("utf-8", "ignore") if c[1] else t) for (d, t), c in zip(left, cut, strict=True)]
    stages.append(left := [(d, t) for d, t in left if t.strip()])
    stages.append([(d, t) for d, t in left if not brute.leaks(t, items)])
    return stages


def test_pipeline(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    expect = plain(rows, items)
    sizes = [len(rows)]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], expect, strict=True):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs.collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in got)
        sizes.append(len(got))
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False) if (a, b) != (sizes[2], sizes[3]))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.size for r in got} == {d: len(brute.words(t)) for d, t in expect[-1]}
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for group in by.values():
        assert {r.source_size for r in group} == {sum(r.size for r in group)}
        assert abs(sum(r.taken for r in group) - group[0].target) < 1.001


def test_stages_take_odd_tables(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = rows[0][1]
    odd = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, None, None, None), (None, None, None, None, None), (2, text + " zz", None, "b", 2)]
    docs = spark.createDataFrame(odd, schema).withColumns({"kept": F.lit("clash"), "n": F.lit(1), "rep": F.lit(2), "row": F.lit(3), "n_words": F.lit(4), "component_id": F.lit(5)})
    left = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES}
    assert left["quality_rules"].count() == 4
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left["ngram_join"].collect()) == [(False, 1), (True, 0), (True, 0)]
    assert left["repeated_strings"].count() == 4  # the copy without an id goes, of row 2 the last word stays
    assert left["decontaminate"].count() == 5 and left["mix_sources"].count() == 5
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_rows_that_share_an_id_keep_their_texts(spark, tmp_path):
    rng = random.Random(21)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = a.replace(" ", "  ", 1)
    rows = [(5, a, 1), (5, b, 2), (5, b, 3), (3, near, 4), (7, b + " zz", 5), (7, c, 6), (7, c, 7), (None, a, 8), (9, None, 9), (9, None, 9), (9, "", 9)]
    left = []
    for seed in (1, 2):
        docs = spark.createDataFrame(rows, "doc_id long, text string, key long").orderBy(F.rand(seed)).repartition(1 + seed)
        got = corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()
        left.append(sorted(((r.doc_id is None, r.doc_id or 0, r.text or "", r.key) for r in got)))
    assert left[0] == left[1]
    kept = {(i, t) for _, i, t, _ in left[0]}
    assert kept == {(3, near), (5, b), (7, c), (0, a), (9, "")} and len(left[0]) == 5


def test_run_with_long_texts_and_no_benchmark(spark, tmp_path):
    rng = random.Random(3)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, prose(rng, 40_000 if i == 0 else 60), "en", "a", 1) for i in range(6)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    got = {r.doc_id: r.size for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(6)) and got[0] > 39_000
    assert {t.name for t in spark.catalog.listTables()} == before
