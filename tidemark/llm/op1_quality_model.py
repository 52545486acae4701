"""Quality classifier: interpolated modified Kneser-Ney model of byte n-grams, learned from trusted text.

Trusted are documents whose labels say quality 1 and not toxic. Their n-grams (``ORDER``
bytes, packed into one long) are counted over all of them; lower orders count the distinct
left extensions. Counts, context totals and lower-order probabilities are joined by their
keys, order by order, which gives the interpolated probability of every n-gram seen and
the back-off weight of every context.

Scoring is a sharded join of the documents' n-grams with that model. Documents are packed
into pieces (see ``pieces``); a piece sends each of its distinct n-grams once, as packed
arrays, to the n-gram's shard, meets the model's rows there, and gets one value for each
back; the sums by document are formed in the piece, so neither texts nor occurrences
travel. A shard holds whole contexts of the two bytes before the predicted one; a pair of
bytes with more than ``SHARD_ROWS`` rows is split by the byte before (its at most 257 rows
that don't know that byte go to each part), so a shard is at most one context of three
bytes: 2**24 + 2**16 + 2**8 rows, in practice a few thousand. What documents ask for isn't
bounded by the model: the n-grams that pieces will send are counted by pair of bytes first, and
the pieces that ask for a pair with more than ``MOST_ASKED`` are dealt over as many copies of its few model rows. Orders 1 and 2 (at most 66,049
numbers) go with the functions. Texts are read once for the pieces, whatever the model's size.

Thresholds are quantiles by language over trusted documents that were held out of the
counts (crc32(id) mod 5 is 0), of the mean negative log-likelihood shrunk to the language's
mean by ``SHRINK`` bytes, so that short texts are not judged by noise. Every language has
its own quantile, whatever its number of held-out documents; what few documents leave
unknown is added as ``CONFIDENCE`` standard errors of their scores.

Defined results: a null or empty text has no perplexity and is not kept; a null language
is a language of its own; a language without any held-out document is judged by the
mean and the quantile of all held-out documents; without trusted text everything with text
is kept and has no perplexity; where an order has no n-grams that were counted once, twice
or three times, the discounts are 0.5, 0.75 and 0.9; repeated rows get repeated results;
repeated labels count once, an untrusted one rules; a very long text is a piece of its own;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import pieces as pc
from . import tokens as tk
from .op4_language_id import fold
from .shared import map_arrow, new_path, read_table, stored, workspace

ORDER = 6
#: Model rows of a pair of bytes above which the pair is split, and model rows and pieces that may meet in one bucket.
SHARD_ROWS = 200_000
PER_BUCKET = 6
#: N-grams of a pair of bytes that may be asked for in one shard; a pair with more has several, by piece.
MOST_ASKED = 1_000_000
#: N-grams that a task counts before it hands them on.
HELD = 2_000_000
PIECE = 6 << 20
#: Costs travel as whole multiples of 1 / UNIT, so a byte's is off by 0.000016 at most; the largest is 512.
UNIT, MOST = 1 << 15, (1 << 24) - 1
BROADCAST_IDS = 1_000_000
#: Languages, and so thresholds, that may be broadcast: a few MB.
BROADCAST_LANGS = 50_000
QUANTILE = 0.99
MARGIN = 0.05
SHRINK = 100
CONFIDENCE = 2.0
STEP = 1e-4


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed ``order`` bytes that end at each byte (zeros before a text) and the byte's text."""
    texts, n = len(offsets) - 1, len(data)
    row = np.repeat(np.arange(texts, dtype=np.int32), np.diff(offsets))
    padded = np.zeros(n + (order - 1) * (texts + 1), np.uint8)
    at = row + np.int32(1)
    at *= order - 1
    at += np.arange(n, dtype=np.int32)
    padded[at] = data
    at -= order - 1
    key = np.zeros(n, np.int64)
    for _ in range(order):
        key <<= 8
        key |= padded[at]
        at += 1
    return key, row


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and the place of each value among them, in less memory than ``np.unique`` takes."""
    order = np.argsort(key)
    value = key[order]
    new = np.ones(len(key), bool)
    new[1:] = value[1:] != value[:-1]
    value = value[new]
    back = np.empty(len(key), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return value, back


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """``gram, c`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda k, c: pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["gram", "c"])
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            for _, _, data, offsets in tk.chunks(batch.column(0), 1 << 22):
                key, count = np.unique(grams(data, offsets, order)[0], return_counts=True)
                both = np.concatenate([held[0], key])
                key, back = np.unique(both, return_inverse=True)
                held = (key, np.bincount(back, np.concatenate([held[1], count]), len(key)).astype(np.int64))
                if len(key) > HELD:
                    yield out(*held)
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield out(*held)

    return map_arrow(texts, run, "gram bigint, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams counted 1 to 4 times."""
    row = counts.agg(*(F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
    n = [row[f"n{i}"] for i in (1, 2, 3, 4)]
    if min(n[:3]) == 0:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]


def discount(c: Column, d: list[float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def model(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``kind, n, gram, value``: log-probabilities (kind 0) and log back-off weights of contexts (kind 1) by order."""
    tables = {order: stored(count_grams(texts, order), "grams")}
    for n in range(order - 1, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << (8 * n)) - 1))
        tables[n] = stored(tables[n + 1].groupBy(low.alias("gram")).agg(F.count(F.lit(1)).alias("c")), "grams")
    lower, parts = None, []
    for n in range(1, order + 1):
        d = discounts(tables[n])
        t = tables[n].withColumn("context", F.shiftright("gram", 8))
        total = t.groupBy("context").agg(F.sum("c").alias("s"), F.sum(discount(F.col("c"), d)).alias("mass"))
        total = total.select("context", "s", (F.col("mass") / F.col("s")).alias("weight"))
        t = t.join(total, "context").withColumn("own", (F.col("c") - discount(F.col("c"), d)) / F.col("s"))
        if lower is None:
            p = t.withColumn("p", F.col("own") + F.col("weight") / 256)
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1))
            p = t.withColumn("suffix", suffix).join(lower, "suffix").withColumn("p", F.col("own") + F.col("weight") * F.col("q"))
        p = stored(p.select("gram", "p"), "model")
        lower = p.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
        parts += [p.select(F.lit(0).alias("kind"), F.lit(n).alias("n"), "gram", F.log("p").alias("value"))]
        parts += [total.select(F.lit(1).alias("kind"), F.lit(n).alias("n"), F.col("context").alias("gram"), F.log("weight").alias("value"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return stored(out, "model")


def hot_pairs(table: DataFrame, shard_rows: int) -> np.ndarray:
    """Which pairs of bytes before the predicted one have more model rows than a shard should; at most 65,536 are looked at."""
    context = F.when(F.col("kind") == 0, F.shiftright("gram", 8)).otherwise(F.col("gram"))
    pair = context.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("pair")
    many = table.filter("n > 2").groupBy(pair).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > shard_rows)
    out = np.zeros(1 << 16, bool)
    out[[r.pair for r in many.collect()]] = True
    return out


def asked_pairs(texts: DataFrame, order: int, piece: int) -> np.ndarray:
    """How many distinct n-grams of each pair of bytes before the predicted one pieces of this size hold, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, _, data, offsets in tk.chunks(batch.column(0), piece):
                key = np.sort(grams(data, offsets, order)[0])
                new = np.ones(len(key), bool)
                np.not_equal(key[1:], key[:-1], out=new[1:])
                n += np.bincount((key[new] >> 8) & 0xFFFF, minlength=1 << 16)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["pair", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in map_arrow(texts, run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        out[r.pair] = r.n
    return out


class Shards:
    """Where n-grams meet the model, and what they get; what is in here has a fixed size and travels with the functions."""

    def __init__(self, table: DataFrame, order: int, buckets: int, hot: np.ndarray, copies: np.ndarray | None = None):
        self.order, self.buckets, self.hot = order, buckets, hot
        #: By pair of bytes, over how many copies of its model rows pieces are dealt.
        self.copies = np.ones(1 << 16, np.int64) if copies is None else copies
        # Orders 1 and 2 by their n-gram, NaN where there is none.
        self.low = {(kind, n): np.full(1 << (8 * (n - kind)), np.nan) for kind in (0, 1) for n in (1, 2)}
        for r in table.filter("n < 3").collect():  # at most 256 + 65,536 + 1 + 256 rows
            self.low[r.kind, r.n][r.gram] = r.value

    def of(self, context: np.ndarray, copy: np.ndarray) -> np.ndarray:
        """Bucket of each context of two or more bytes, in that copy of its pair's rows."""
        pair = context & 0xFFFF
        key = np.where(self.hot[pair], (context & 0xFFFFFF) | (1 << 24), pair).astype(np.uint64)
        # Copies of a shard lie in buckets that follow each other, so no two meet.
        return ((tk.mix(key) % np.uint64(self.buckets)).astype(np.int64) + copy) % self.buckets

    def asked_of(self, context: np.ndarray, piece: int) -> np.ndarray:
        """Bucket in which a piece asks for each context."""
        start = int(tk.mix(np.array([piece], np.int64).view(np.uint64))[0] >> np.uint64(1))
        return self.of(context, start % self.copies[context & 0xFFFF])

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets of model rows; those that don't know the byte by which their pair is split go to each part."""
        for batch in batches:
            kind, n, gram = (batch.column(c).to_numpy() for c in ("kind", "n", "gram"))
            context = np.where(kind == 0, gram >> 8, gram)
            short = (n == 3) & self.hot[context & 0xFFFF]
            row = np.concatenate([np.flatnonzero(~short), np.repeat(np.flatnonzero(short), 256)])
            context = context[row]
            context[(~short).sum() :] |= np.tile(np.arange(256) << 16, int(short.sum()))
            times = self.copies[context & 0xFFFF]
            copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            context, row = np.repeat(context, times), np.repeat(row, times)
            yield pa.RecordBatch.from_arrays([pa.array(self.of(context, copy).astype(np.int32)), *(batch.column(c).take(pa.array(row)) for c in ("kind", "n", "gram", "value"))], names=["bucket", "kind", "n", "gram", "value"])


    def ask(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece's distinct n-grams by bucket."""
        for batch in batches:
            for i in range(batch.num_rows):
                _, offsets, data = pc.unpack(batch, i)
                unique = np.unique(grams(data, offsets, self.order)[0])
                order, some, border = pc.deal(self.asked_of(unique >> 8, batch.column("piece")[i].as_py()), self.buckets)
                sent = [unique[order[border[b] : border[b + 1]]] for b in some]
                packed = [pc.planes(np.diff(x, prepend=0).view(np.uint64), self.order) for x in sent]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), batch.column("piece")[i].as_py(), np.int64)), pa.array(packed, pa.binary())],
                    names=["bucket", "piece", "grams"],
                )

    def answer(self, asked: pa.Table, model_rows: pa.Table) -> pa.Table:
        """The cost (negative log-probability of the last byte) of each n-gram asked for in one bucket, in 3 bytes."""
        kind, n, gram, value = (model_rows.column(c).to_numpy() for c in ("kind", "n", "gram", "value"))
        order = np.lexsort((gram, n, kind))
        kind, n, gram, value = kind[order], n[order], gram[order], value[order]
        cut = {(k, m): slice(*np.searchsorted(kind * 16 + n, (k * 16 + m, k * 16 + m + 1))) for k in (0, 1) for m in range(3, self.order + 1)}
        own = [np.cumsum(pc.from_planes(b, self.order).view(np.int64)) for b in asked.column("grams").to_pylist()]
        keys, back = distinct(np.concatenate([*own, np.zeros(0, np.int64)]))

        def find(k: int, m: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if m < 3:
                v = self.low[k, m][key]
                return ~np.isnan(v), np.nan_to_num(v)
            ok, at = pc.lookup(gram[cut[k, m]], key)
            return ok, np.where(ok, value[cut[k, m]][at], 0.0) if ok.any() else np.zeros(len(key))

        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        for m in range(self.order, 0, -1):
            k = keys[open_] & ((1 << (8 * m)) - 1)
            ok, v = find(0, m, k)
            out[open_[ok]] += v[ok]
            open_, k = open_[~ok], k[~ok]
            out[open_] += find(1, m, k >> 8)[1]
        out[open_] -= np.log(256)
        got, at, values = np.minimum(np.rint(-out * UNIT), MOST).astype(np.uint64)[back], 0, []
        for o in own:
            values.append(pc.planes(got[at : at + len(o)], 3))
            at += len(o)
        return pa.table({"bucket": asked.column("bucket"), "piece": asked.column("piece"), "costs": pa.array(values, pa.binary())})

    def add_up(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums by document of a piece."""
        for batch in batches:
            for i in range(batch.num_rows):
                _, offsets, data = pc.unpack(batch, i)
                key, row = grams(data, offsets, self.order)
                unique, back = distinct(key)
                del key
                order, some, border = pc.deal(self.asked_of(unique >> 8, batch.column("piece")[i].as_py()), self.buckets)
                sent = {s["bucket"]: s["costs"] for s in batch.column("sent")[i].as_py() or []}
                cost = np.empty(len(unique))
                cost[order] = np.concatenate([*(pc.from_planes(sent[b], 3) for b in some.tolist()), np.zeros(0, np.uint64)]) / UNIT
                size = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rest")[i].values, pa.array(np.bincount(row, cost[back], len(size)).astype(float)), pa.array(size)], names=["rest", "nll", "n_bytes"]
                )


def likelihoods(docs: DataFrame, table: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS, piece: int = PIECE, most_asked: int = MOST_ASKED) -> DataFrame:
    """``doc_id, lang, nll, n_bytes`` of every row: the negative log-likelihood of its text."""
    spark = docs.sparkSession
    ship(spark)
    # Pieces are dealt out once; both uses read that one exchange, so no copy of the texts is written.
    pieces, parts, total = pc.deal_pieces(docs, "text", None, ["doc_id", "lang"], piece)
    wanted = asked_pairs(docs.select(F.encode(F.col("text").cast("string"), "UTF-8").alias("text")), order, piece)
    buckets = max(-(-total // (piece * PER_BUCKET)), -(-table.count() // shard_rows), int(-(-wanted.max() // most_asked)), 1)
    copies = np.maximum(-(-wanted // most_asked), 1)
    step = Shards(table, order, buckets, hot_pairs(table, shard_rows), copies)
    asked = map_arrow(pieces, step.ask, "bucket int, piece bigint, grams binary")
    placed = map_arrow(table.filter("n > 2").select("kind", "n", "gram", F.col("value").cast("float")), step.place, "bucket int, kind int, n int, gram bigint, value float")
    costs = asked.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(lambda a, m: step.answer(a, m), "bucket int, piece bigint, costs binary")
    back = costs.repartition(parts, "piece").groupBy("piece").agg(F.collect_list(F.struct("bucket", "costs")).alias("sent"))
    rest = pieces.schema["rest"].dataType.elementType.simpleString()
    summed = map_arrow(pieces.join(back, "piece", "left"), step.add_up, f"rest {rest}, nll double, n_bytes bigint")
    return summed.select("rest.doc_id", "rest.lang", "nll", "n_bytes")


def classify(
    docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", id_: str = "doc_id", order: int = ORDER,
    quantile: float = QUANTILE, margin: float = MARGIN, shrink: float = SHRINK, confidence: float = CONFIDENCE, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``doc_id, lang, n_bytes, nll_per_byte, perplexity, score, threshold, kept`` of every row.

    The result is written; all other tables are deleted before the function returns.
    """
    spark = docs.sparkSession
    path = new_path(spark, "classified")
    with workspace(spark):
        rows = docs.select(F.col(id_).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
        out = _classify(rows, labels, order, quantile, margin, shrink, confidence, shard_rows)
        out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _classify(rows: DataFrame, labels: DataFrame, order: int, quantile: float, margin: float, shrink: float, confidence: float, shard_rows: int) -> DataFrame:
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    trusted = stored(labels.groupBy("doc_id").agg(F.min(good).alias("good")).filter("good AND doc_id IS NOT NULL").select("doc_id"), "trusted")
    few = trusted.count() <= BROADCAST_IDS
    learned = rows.filter(fold(F.col("doc_id")) != 0).join(F.broadcast(trusted) if few else trusted, "doc_id", "left_semi")
    table = model(learned.select("text"), order)
    scored = stored(likelihoods(rows, table, order, shard_rows), "scored")

    held = scored.filter((fold(F.col("doc_id")) == 0) & (F.col("n_bytes") > 0)).join(F.broadcast(trusted) if few else trusted, "doc_id", "left_semi")
    # One row for each language, and one over all of them. All stay without a threshold where nothing was learned.
    taught = not table.isEmpty()
    means = stored(held.groupBy("lang").agg(F.sum("nll").alias("nll_sum"), F.sum("n_bytes").alias("byte_sum")), "means")
    all_ = means.agg(F.sum("nll_sum").alias("nll_sum"), F.sum("byte_sum").alias("byte_sum")).first()
    pooled = all_.nll_sum / all_.byte_sum if all_.byte_sum else 0.0
    langs = scored.select("lang").distinct().join(means.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    langs = stored(langs.select("lang", F.coalesce(F.col("nll_sum") / F.col("byte_sum"), F.lit(pooled)).alias("mean")), "langs")
    # Scores don't travel to their language, which may hold most rows; its one row goes to them.
    near = F.broadcast if langs.count() <= BROADCAST_LANGS else lambda df: df
    by = near(langs.withColumnRenamed("lang", "l"))
    score = (F.col("nll") + shrink * F.col("mean")) / (F.col("n_bytes") + shrink)

    # Quantiles from counts of scores in steps of STEP: exact to a step, whatever the order of rows.
    off = held.join(by, F.col("lang").eqNullSafe(F.col("l"))).select("lang", F.ceil((score - F.col("mean")) / STEP).alias("step"))
    steps = stored(off.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("c")), "steps")

    def allowed(counts: DataFrame, keys: list[str]) -> DataFrame:
        """By key: the quantile of the deviations from the mean, and ``confidence`` standard errors."""
        w = Window.partitionBy(*keys)
        running = counts.withColumn("below", F.sum("c").over(w.orderBy("step"))).withColumn("total", F.sum("c").over(w))
        reached = F.min(F.when(F.col("below") >= quantile * F.col("total"), F.col("step")))
        # Sums of whole numbers, so they don't depend on the order of rows.
        sums = (F.sum(F.col("c") * F.col("step")), F.sum(F.col("c") * F.col("step") * F.col("step")))
        at = running.groupBy(*keys).agg(reached.alias("q"), F.max("total").cast("double").alias("n"), sums[0].cast("double").alias("s"), sums[1].cast("double").alias("ss"))
        spread = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))))
        return at.select(*keys, (STEP * (F.col("q") + confidence * spread / F.sqrt("n"))).alias("deviation"))

    own = allowed(steps, ["lang"]).withColumnRenamed("lang", "l2")
    one = allowed(steps.groupBy("step").agg(F.sum("c").alias("c")).withColumn("one", F.lit(1)), ["one"]).first()
    limits = by.join(own, F.col("l").eqNullSafe(F.col("l2")), "left")
    deviation = F.coalesce("deviation", F.lit(one.deviation if one else None).cast("double"))
    limits = limits.select("l", "mean", (F.col("mean") + deviation + margin if taught else F.lit(None).cast("double")).alias("threshold"))
    out = scored.join(near(limits), F.col("lang").eqNullSafe(F.col("l"))).withColumn("score", F.when(F.col("threshold").isNotNull() & (F.col("n_bytes") > 0), score))
    mean = F.when(F.lit(taught) & (F.col("n_bytes") > 0), F.col("nll") / F.col("n_bytes"))
    return out.select(
        "doc_id", "lang", "n_bytes", mean.alias("nll_per_byte"), F.exp(mean).alias("perplexity"), "score", "threshold",
        ((F.col("n_bytes") > 0) & F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True))).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
