r"""Document fingerprints: Merkle trees over blocks, paragraphs and sections; DataFrame functions only.

A paragraph is a line, its leaves are blocks of up to 64 code points. A section ends after
a paragraph whose digest ends in 0 or 8; an empty line's does. So a text without empty lines has
sections too, and an edit moves no border further on. Every node's SHA-256 covers a
letter for its kind and its children's digests; the root covers the sections. The fingerprint writes
the tree in order: ``r`` and the root's whole digest, then ``s`` and 8 digits for each section,
``p`` and 8 digits for each paragraph in it, and 8 digits for each block of that. Equal roots
mean equal texts. Likeness is the Dice coefficient of the two trees' distinct nodes, the root
included: 1 for equal texts only. :func:`edits` finds the paragraphs under branches that differ.

Neighbours in descending order of id come from a table of keys only (key ranges, as many as
needed, each a window of its own; a range's last row takes the next range's first). Texts are
dealt out once by key; what travels of the next text is the prefix that is needed, a third
of the document at most, and its fingerprint.

Defined results: a null or empty text is one empty paragraph; rows with one id are ordered by
the digest of their text; equal rows follow each other, so the next of all but the last is its own
text; null ids come last; a single document follows itself; a very long text is one row
and costs time in proportion; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import finished, read_table, stored

BLOCK = 64
#: Keys in one range of the order.
ROWS_PER_RANGE = 500_000
NODE = "r[0-9a-f]{64}|[sp]?[0-9a-f]{8}"


def sha(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)), 256)


def fingerprint(rows: DataFrame, text: str, name: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with the fingerprint of the column ``text`` (no nulls) as ``name``."""
    # Each step is a column of its own, so that no tree is made twice.
    blocks = lambda line: F.transform(F.regexp_extract_all(line, F.lit(rf"[^\n]{{1,{block}}}"), F.lit(0)), lambda b: F.sha2(b, 256))
    short = lambda digests: F.array_join(F.transform(digests, lambda d: F.substring(d, 1, 8)), "")
    steps = rows.withColumn("paragraphs_", F.transform(F.split(F.col(text), "\n"), blocks))
    # Of each paragraph its blocks, a dot and its digest.
    steps = steps.withColumn("line_", F.array_join(F.transform("paragraphs_", lambda d: F.concat(short(d), F.lit("."), sha("p", F.array_join(d, "")))), ","))
    cut = F.col("line_")
    for end in ("0", "8"):
        cut = F.replace(cut, F.lit(f"{end},"), F.lit(f"{end};"))
    steps = steps.withColumn("sections_", F.transform(F.split(cut, ";"), lambda s: F.struct(sha("s", s).alias("h"), s.alias("s"))))
    root = sha("r", F.array_join(F.transform("sections_", lambda s: s["h"]), ""))
    tree = F.array_join(F.transform("sections_", lambda s: F.concat(F.lit("s"), F.substring(s["h"], 1, 8), F.lit(":"), s["s"])), ",")
    tree = F.regexp_replace(tree, r"([0-9a-f]*)\.([0-9a-f]{8})[0-9a-f]{56},?", "p$2$1")
    out = steps.withColumn(name, F.concat(F.lit("r"), root, F.replace(tree, F.lit(":"))))
    return out.drop("paragraphs_", "line_", "sections_")


def nodes(tree: Column) -> Column:
    return F.regexp_extract_all(tree, F.lit(NODE), F.lit(0))


def likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``rows`` with the likeness of two fingerprints; trees with equal roots aren't compared further."""
    # Linear in the nodes: the distinct ones of each and of both are counted.
    one, two = (F.size(F.array_distinct(nodes(F.col(c)))) for c in (a, b))
    both = F.size(F.array_union(nodes(F.col(a)), nodes(F.col(b))))
    return rows.withColumn(name, F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(2.0 * (one + two - both) / (one + two)))


def edits(rows: DataFrame, id_: str, before: str, after: str) -> DataFrame:
    """``id, side, section, paragraph, node``: the paragraphs (counted from 0) under sections that the other tree doesn't have.

    Sections, then paragraphs of those left, are rows that meet by id and node; nothing below equal branches is looked at.
    """
    differ = rows.filter(F.col(before) != F.col(after)).select(F.col(id_).alias("id_"), F.col(before).alias("before"), F.col(after).alias("after"))
    both = differ.select("id_", F.explode(F.create_map(F.lit("before"), "before", F.lit("after"), "after")).alias("side", "tree"))
    branch = F.regexp_extract_all("tree", F.lit("s[0-9a-f]{8}[^s]*"), F.lit(0))
    sections = both.select("id_", "side", F.posexplode(branch).alias("section", "branch")).withColumn("node", F.substring("branch", 1, 9))
    before_it = F.size(F.regexp_extract_all("branch", F.lit("p"), F.lit(0)))
    first = F.coalesce(F.sum(before_it).over(Window.partitionBy("id_", "side").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sections = sections.withColumn("first", first)

    def other(table: DataFrame) -> DataFrame:
        return table.select(F.col("id_").alias("i"), F.when(F.col("side") == "before", "after").otherwise("before").alias("o"), F.col("node").alias("x")).distinct()

    same = (F.col("id_") == F.col("i")) & (F.col("side") == F.col("o")) & (F.col("node") == F.col("x"))
    left = sections.join(other(sections), same, "left_anti")
    paragraphs = left.select("id_", "side", "section", "first", F.posexplode(F.regexp_extract_all("branch", F.lit("p[0-9a-f]{8}"), F.lit(0))).alias("at", "node"))
    out = paragraphs.join(other(paragraphs), same, "left_anti")
    return out.select(F.col("id_").alias("id"), "side", "section", (F.col("first") + F.col("at")).cast("long").alias("paragraph"), "node")


def following(keys: DataFrame, order: list[Column], columns: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``keys`` with ``next_<column>`` of the next row in ``order``, the first row's for the last.

    ``order`` must tell all rows apart. Ranges hold about ``rows_per_range`` rows; one row for
    each range, its first, is all that is put in one order as a whole.
    """
    parts = max(1, -(-keys.count() // rows_per_range))
    ranged = stored(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "key-ranges")
    # Rank and next of the ranges that have rows.
    head = F.struct(*columns)
    inside = Window.partitionBy("part").orderBy(*order)
    ranged = ranged.withColumns({"own": F.lead(head).over(inside), "rank": F.row_number().over(inside)})
    firsts = ranged.filter("rank = 1").select("part", head.alias("head"))
    by_part = Window.orderBy("part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("head").over(by_part), F.first("head").over(whole)).alias("then"))
    then = F.coalesce("own", "then")
    return ranged.join(firsts, "part").select(*keys.columns, *(then[c].alias(f"next_{c}") for c in columns))


def fingerprints(docs: DataFrame, text: str = "text", id_: str = "doc_id", share: int = 3, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(f"`{id_}`").cast("string"), F.lit("null")), F.lit(":"), F.md5(body.cast("binary"))).cast("binary"))
    rows = docs.select(key.alias("key"), F.col(f"`{id_}`").alias("doc_id"), body.alias("text"))
    # Equal rows are one key with a number; they collapse before they travel.
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min(F.length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("n"))
    chain = following(stored(keys, "keys"), [F.col("doc_id").desc_nulls_last(), F.col("key")], ["key"], rows_per_range)
    # All but the last of equal rows are followed by their own text.
    steps = F.filter(F.array(F.struct("next_key", F.lit(1).cast("long").alias("times")), F.struct(F.col("key").alias("next_key"), (F.col("n") - 1).alias("times"))), lambda s: s["times"] > 0)
    chain = stored(chain.select("key", "doc_id", "n_chars", F.explode(steps).alias("step")).select("key", "doc_id", "n_chars", "step.*"), "chain")

    texts = fingerprint(rows.groupBy("key").agg(F.min("text").alias("text")), "text", "tree")
    need = F.floor(F.col("n_chars") / share).cast("int")
    heads = chain.join(texts.withColumnRenamed("key", "next_key"), "next_key").select(
        "key", "doc_id", "n_chars", "times", F.substring(F.col("text"), F.lit(1), need).alias("head"), F.col("tree").alias("next_tree")
    )
    both = heads.join(texts, "key")
    edited = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - need), F.col("head"))).drop("text", "head")
    trees = fingerprint(edited, "edited", "edited_tree").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    out = likeness(likeness(trees, "tree", "edited_tree", "near_edited"), "tree", "next_tree", "near_next")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "times"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.col("tree").alias("fingerprint"), F.col("edited_tree").alias("edited_fingerprint"), "near_edited", "near_next", copies.alias("copy")
    ).drop("copy")


def query(spark, sf_dir: str) -> DataFrame:
    return finished(spark, "fingerprints", lambda: fingerprints(read_table(spark, sf_dir, "documents")))


def _sql_tree(text: str) -> str:
    """The fingerprint of an expression, in DuckDB's SQL."""
    lines = rf"list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^\n]{{1,{BLOCK}}}'), lambda b: sha256(b)))"
    flat = f"array_to_string(list_transform({lines}, lambda d: array_to_string(list_transform(d, lambda h: h[1:8]), '') || '.' || sha256('p' || array_to_string(d, ''))), ',')"
    cut = f"string_split(replace(replace({flat}, '0,', '0;'), '8,', '8;'), ';')"
    tree = "array_to_string(list_transform(c, lambda s: 's' || sha256('s' || s)[1:8] || ':' || s), ',')"
    root = "'r' || sha256('r' || array_to_string(list_transform(c, lambda s: sha256('s' || s)), ''))"
    short = rf"replace(regexp_replace({tree}, '([0-9a-f]*)\.([0-9a-f]{{8}})[0-9a-f]{{56}},?', 'p\2\1', 'g'), ':', '')"
    return f"(SELECT {root} || {short} FROM (SELECT {cut} AS c))"


def _sql_likeness(a: str, b: str) -> str:
    x, y = (f"list_distinct(regexp_extract_all({t}, '{NODE}'))" for t in (a, b))
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n FROM documents),
k AS (SELECT *, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(t)) AS k FROM d),
o AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM k WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, k)),
e AS (SELECT doc_id, n, t, nt, t[1:n - n // 3] || nt[1:n // 3] AS et FROM o),
f AS (SELECT doc_id, n, sha256(et) AS es, {_sql_tree("t")} AS f, {_sql_tree("et")} AS ef, {_sql_tree("nt")} AS nf FROM e)
SELECT doc_id, n AS n_chars, es AS edited_sha256, f AS fingerprint, ef AS edited_fingerprint,
  {_sql_likeness("f", "ef")} AS near_edited, {_sql_likeness("f", "nf")} AS near_next
FROM f
"""
