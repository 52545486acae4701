"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased, every run of non-letters becomes one space, and the n-grams of one
to three code points are hashed into ``DIMENSIONS`` columns. Document frequencies come
from all training documents; the weights are learned by follow-the-regularised-leader
(FTRL-proximal) with an elastic net on a bounded sample: of each language's distinct texts
the ``SAMPLE_PER_LANG`` with the least hash (fewer where ``SAMPLE_ROWS`` in all would be
exceeded), so every language is learned, whatever its ids, and copies take no place of
others. Every fourth of a language's sample only sets the temperature. Prediction is one scan
without a shuffle; the model that is sent to the executors has a fixed size.

Only text and non-null language of documents whose crc32(id as text) mod 5 is not 0 are
learned from; language, source and id are no inputs of a prediction.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where
there was nothing to learn from; a null id counts as an empty text in the crc32 (held
out); repeated rows get repeated results; ties go to the first language in code point
order; more than ``MOST_LANGS`` languages are an error, none is left out; a very long text is
read whole; ids may be of any type; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_arrow, read_table

DIMENSIONS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_PER_LANG = 600
SAMPLE_ROWS = 12_000
EPOCHS = 3
#: One row of so many of a language's sample sets the temperature and no weight.
TUNING = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-3
_TABLE = 0x110000
#: Languages that a model of DIMENSIONS columns is made for: 260 MB of weights while it is fitted.
MOST_LANGS = 500


@cache
def letters() -> np.ndarray:
    """Lower case of each code point that is a letter, else a space."""
    out = np.full(_TABLE + 1, 32, np.uint32)
    for i in range(_TABLE):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def buckets(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the hashed columns of all its n-grams."""
    table = letters()
    lengths = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = table[np.minimum(code, _TABLE)]
    end = np.cumsum(lengths)
    for a, b in zip(end - lengths, end, strict=True):
        c = code[a:b]
        if len(c):
            c = c[~((c == 32) & np.concatenate([[True], c[:-1] == 32]))]
        c = c[: -1 if len(c) and c[-1] == 32 else None]
        if len(c) == 0:
            yield np.zeros(0, np.int64)
            continue
        c = np.concatenate([np.array([32], np.uint32), c, np.array([32], np.uint32)]).astype(np.uint64)
        found = []
        for k in ORDERS:
            h = np.zeros(max(0, len(c) - k + 1), np.uint64)
            for i in range(k):
                h = (h ^ c[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            found.append(h + np.uint64(k))
        h = np.concatenate(found)
        yield ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.int64)


def vector(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and TF-IDF values, of length 1."""
    count = np.bincount(found, minlength=DIMENSIONS)
    at = np.flatnonzero(count)
    value = (1 + np.log(count[at])) * idf[at]
    return at, value / max(1e-12, float(np.sqrt(value @ value)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of ``DIMENSIONS`` columns and an intercept, sparse through the L1 part."""
    z = np.zeros((DIMENSIONS + 1, n_classes))
    n = np.zeros_like(z)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value, y = rows[i]
            at, value = np.append(at, DIMENSIONS), np.append(value, 1.0)
            w = weights(at)
            p = softmax(value @ w)
            p[y] -= 1
            g = value[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the smallest negative log-likelihood."""
    if len(y) == 0:
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-300).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fold(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    rows = docs.select(F.col(id_).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), fold(F.col(id_)).alias("fold"))
    train = rows.filter((F.col("fold") != 0) & F.col("lang").isNotNull())
    draw = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 63) - 1))
    # About how many distinct texts each language has; more than a table of MOST_LANGS rows never comes here.
    counts = {r.lang: r.n for r in train.groupBy("lang").agg(F.approx_count_distinct(draw).alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages to learn")
    langs = sorted(counts)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for found in buckets([x.as_py() or "" for x in batch.column(0).slice(i, 64)]):
                    df += np.bincount(found, minlength=DIMENSIONS) > 0
                    n += 1
        at = np.flatnonzero(df)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIMENSIONS)), pa.array(np.append(df[at], n))], names=["bucket", "df"])

    summed = map_arrow(train.select("text"), frequencies, "bucket bigint, df bigint").groupBy("bucket").agg(F.sum("df").alias("df"))
    df = np.zeros(DIMENSIONS + 1)
    for r in summed.collect():  # at most DIMENSIONS + 1 rows
        df[r.bucket] = r.df
    idf = np.log((1 + df[DIMENSIONS]) / (1 + df[:DIMENSIONS])) + 1

    # The sample: a threshold on a hash for each language, so that rows are chosen where they are. Twice
    # the sample passes it, copies collapse, and what is left of a language is small enough to be ranked.
    per_lang = min(SAMPLE_PER_LANG, max(1, SAMPLE_ROWS // max(1, len(langs))))
    sample_rows: list[tuple] = []
    if langs:
        share = F.create_map(*(F.lit(v) for k in langs for v in (k, min((1 << 63) - 1, (2 * per_lang << 63) // max(1, counts[k])))))

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 64):
                    part = batch.slice(i, 64)
                    got = [vector(f, idf) for f in buckets([x.as_py() or "" for x in part.column(0)])]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1), part.column(2), pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32()))],
                        names=["lang", "place", "at", "value"],
                    )

        passed = train.withColumn("draw", draw).filter(F.col("draw") <= share[F.col("lang")])
        passed = passed.groupBy("lang", "draw").agg(F.min("text").alias("text"))
        placed = passed.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw")) - 1).filter(F.col("place") < per_lang)
        got = map_arrow(placed.select("text", "lang", "place"), vectors, "lang string, place int, at array<int>, value array<float>").toPandas()
        got = got.sort_values(["place", "lang"], kind="stable")
        sample_rows = [(np.asarray(a, np.int64), np.asarray(v, float), langs.index(y), p) for y, p, a, v in got[["lang", "place", "at", "value"]].itertuples(index=False) if len(a)]
    fitting = [r[:3] for r in sample_rows if r[3] % TUNING != TUNING - 1]
    tuning = [r[:3] for r in sample_rows if r[3] % TUNING == TUNING - 1]
    fitting = fitting or tuning
    weight = fit(fitting, len(langs)) if fitting else np.zeros((DIMENSIONS + 1, 1))
    logits = lambda a, v: v @ weight[a] + weight[DIMENSIONS]
    heat = temperature(np.array([logits(a, v) for a, v, _ in tuning]), np.array([y for _, _, y in tuning])) if tuning else 1.0
    ready = bool(fitting)
    model = docs.sparkSession.sparkContext.broadcast((weight.astype(np.float32), idf.astype(np.float32)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, inverse = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                name, score = [], []
                for found in buckets([x.as_py() or "" for x in part.column(2)]):
                    if len(found) == 0 or not ready:
                        name.append("und")
                        score.append(0.0)
                        continue
                    a, v = vector(found, inverse)
                    p = softmax((v @ w[a] + w[DIMENSIONS]) / heat)
                    name.append(langs[int(np.argmax(p))])
                    score.append(float(min(1.0, p.max())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(name, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    narrow = rows.select("doc_id", (F.col("fold") == 0).alias("held_out"), "text")
    return map_arrow(narrow, predict, f"doc_id {narrow.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
