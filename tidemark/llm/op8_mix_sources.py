"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Each source gets a share of all words by its weight, at most ``max_epochs`` times its own
size; what is above is shared out again by weight until nothing is (water filling, in
closed form over the table of sources). A source whose target is ``e`` whole sizes and a
rest takes every document ``e`` times; the rest goes to the documents with the smallest
exponential keys ``-ln(u) / quality``, ``u`` a hash of id and text, up to the word budget. The
document at the border gives the words that are still missing, so the words taken of a
source are its target rounded down.

A source may hold any share of all rows: the prefix sum runs within ranges of keys
(about ``rows_per_range`` documents each), offsets come from the sums of the ranges. Only
id, source, size and key are shuffled, never texts.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a
source of its own, last in order; repeated rows are further documents, ties in the key go
by id, then size (rows with one id and one text share a key and so a range); a null id hashes
as "null"; a very long text is read where it is and never travels; extra columns are ignored; an empty table
gives an empty table. If all sizes are 0, so are all targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import finished, read_table, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """In (0, 1]: texts with many symbols weigh less."""
    n, plain = F.length(text), F.length(F.translate(text, SYMBOLS, ""))
    return F.when(n > 0, F.lit(1.0) / (F.lit(1.0) + (F.lit(20.0) * (n - plain)) / n)).otherwise(F.lit(1.0))


def uniform(id_: Column, text: Column, seed: str) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 of seed, id and the text's MD5."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    hexa = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), digest).cast("binary")), 1, 13)
    return (F.conv(hexa, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def ahead(rows: DataFrame, order: list[Column], sums: dict[str, Column], rows_per_part: int) -> DataFrame:
    """Adds to each row the sums over all rows before it in ``order``.

    Rows are dealt to ranges of the order; the sums inside a range and those of the ranges
    before it add up, so no task holds all rows.
    """
    parts = max(1, -(-rows.count() // rows_per_part))
    if parts > 1:
        rows = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    else:
        rows = rows.withColumn("part", F.lit(0))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col("part").alias("part_")).agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    totals = totals.select("part_", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_") for k in sums))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"{k}_in": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()}).join(F.broadcast(totals), F.col("part") == F.col("part_"))
    return out.withColumns({k: F.col(f"{k}_") + F.col(f"{k}_in") for k in sums}).drop("part", "part_", *(f"{k}{x}" for k in sums for x in ("_", "_in")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, rows_per_part: int = 500_000) -> DataFrame:
    """Adds ``target`` to a table of ``source`` and ``source_size``, one row for each source."""
    by_name = F.col("source").asc_nulls_last()
    s = ahead(sources, [by_name], {"rank": F.lit(1)}, rows_per_part)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    s = s.withColumn("w", weight).withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    s = ahead(s, [F.col("ratio"), by_name], {"caps": F.col("cap"), "weights": F.col("w")}, rows_per_part)
    s = stored(s, "filling")
    total = s.agg(F.sum("source_size").alias("size_all"), F.sum("w").alias("w")).first()
    s = s.withColumn("full", (F.lit(total.size_all or 0) - F.col("caps")) / F.nullif(F.lit(total.w or 0) - F.col("weights"), F.lit(0)) > F.col("ratio"))
    full = s.filter("full").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w")).first()
    # What the full sources leave, by weight.
    rest, weight = (total.size_all or 0) - (full.cap or 0), (total.w or 0) - (full.w or 0)
    level = F.lit(float(rest)) / F.lit(float(weight)) if weight else F.lit(None).cast("double")
    return s.select(
        "source", "source_size", "n_docs", "mean_weight",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("w")).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    id_: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    quality: Column | None = None,
    seed: str = SEED,
    rows_per_range: int = 5000,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document."""
    body = F.col(text).cast("string")
    sized = docs.select(
        F.col(id_).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(quality_weight(body) if quality is None else quality, F.lit(1.0)).alias("weight"),
        uniform(F.col(id_), body, seed).alias("u"),
    ).withColumn("key", -F.log(F.col("u")) / F.col("weight")).drop("u")
    sized = stored(sized, "mix-sized")

    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.avg("weight").alias("mean_weight"))
    per_source = stored(per_source, "mix-sources")
    sources = targets(per_source, weights, max_epochs).select(F.col("source").alias("source_"), "source_size", "target", "n_docs", "mean_weight")
    ranges = F.ceil(F.col("n_docs") / rows_per_range)
    at = F.least(ranges - 1, F.floor((1 - F.exp(-F.col("key") * F.col("mean_weight"))) * ranges))
    ranged = sized.join(sources, F.col("source").eqNullSafe(F.col("source_"))).withColumn("range", at.cast("long"))

    # Sums of the key ranges before each range; rows: documents / rows_per_range + sources.
    sums = ranged.groupBy("source_", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source_").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source_").alias("source__"), F.col("range").alias("range_"), F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source_", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, F.col("source_").eqNullSafe(F.col("source__")) & (F.col("range") == F.col("range_")))
        .withColumn("before", F.col("ahead") + F.col("inside"))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - epochs * F.col("source_size")
    taken = F.col("size") * epochs + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return finished(spark, "mixed", lambda: mix_sources(read_table(spark, sf_dir, "documents")))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CASE WHEN length(text) > 0
      THEN 1.0::DOUBLE / (1.0::DOUBLE + (20.0::DOUBLE * (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))) / length(text))
      ELSE 1.0::DOUBLE END AS weight,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w, {MAX_EPOCHS} * source_size AS cap FROM s
), r AS (
  SELECT *, cap::DOUBLE / w AS ratio, sum(source_size) OVER ()::DOUBLE AS t, sum(w) OVER ()::DOUBLE AS ws FROM w
), f AS (
  SELECT *, (t - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (ws - coalesce(sum(w) OVER b, 0)::DOUBLE) > ratio AS full_
  FROM r WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, CASE WHEN full_ THEN cap::DOUBLE ELSE
    (t - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ()::DOUBLE) / (ws - sum(CASE WHEN full_ THEN w ELSE 0 END) OVER ()::DOUBLE) * w END AS target
  FROM f
), p AS (
  SELECT doc_id, d.source, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, source, size, source_size, target,
  (size * epochs + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM p
"""
