"""Corpus pipeline: quality rules, near copies, repeated strings, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and gives a table; it is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.op2_repeated_strings import remove_repeats
from tidemark.llm.op3_decontaminate import contaminated
from tidemark.llm.op6_ngram_join import ngram_groups
from tidemark.llm.op8_mix_sources import mix_sources
from tidemark.llm.op9_quality_rules import quality_rules
from tidemark.llm.shared import finished, read_table, stored, without_ids

#: No SQL: the stages cut texts byte by byte and verify windows; see tests/llm/test_pipeline.py.
ORACLE_SQL = None
#: Near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    kept = quality_rules(rows, keep=("row",)).filter("kept")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id; rows without an id stay.

    Rows that share an id are documents of their own where their texts differ, equal ones are one.
    Of a group's rows with the smallest id the one with the least digest stays.
    """
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    if again.isEmpty():
        groups = ngram_groups(docs.select("doc_id", "text"), k=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
        return without_ids(docs, stored(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "removed"), "doc_id")
    # A key for each id and text; the columns travel as one struct, so that none clashes with it.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")))).alias("key"), whole.alias("row"))
    keyed = rows.filter("key IS NOT NULL")
    groups = ngram_groups(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), k=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    ids = keyed.select(F.col("key").alias("k"), F.col("row.doc_id").alias("id")).distinct()
    named = groups.select(F.col("doc_id").alias("k"), "component_id").distinct().join(ids, "k")
    stays = stored(named.groupBy("component_id").agg(F.min_by("k", F.struct("id", "k")).alias("key")).select("key"), "stays")
    # Of equal rows one; the other columns decide which, so that runs agree.
    kept = keyed.join(stays, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    both = kept.select("row").unionByName(rows.filter("key IS NULL").select("row"))
    return both.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that an earlier document has; a document of which nothing but white space is left goes."""
    # The row without its text travels as one struct, so its columns can't clash with the counts.
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("text").alias("body"), F.col("doc_id").alias("key"))
    cut = remove_repeats(rows, "body", "key", as_text=True)
    changed = F.col("n_removed") > 0
    out = cut.filter(~changed | F.col("kept").rlike(r"\S"))
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row")["n_chars"])
    return out.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = contaminated(docs.select("doc_id", "text"), read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return without_ids(docs, stored(found, "leaks"), "doc_id")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_sources(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_copies),
    ("repeated_strings", repeated_strings),
    ("decontaminate", benchmark_leaks),
    ("mix_sources", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = finished(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
