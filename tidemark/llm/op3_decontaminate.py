"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact check.

Words are runs of letters and digits, lower-cased. For each benchmark item a window as long
as the item slides over every text. Window and item are compared by 128-bit SimHashes of
their weighted word shingles; blocks of 16 bits index the items so that every fingerprint
within ``RADIUS`` bits is found: 8 blocks can't all differ in more than ``RADIUS // 8``
bits, so each block of a window is looked up with all values that near. What is found is
verified by the exact weighted shingle similarity (sum of minima over sum of maxima of
shingle count times weight).

Weights come from a shingle's rarity among all items, counted once by an aggregation,
whatever the number of items. An item's rarest shingles that together weigh more than
``1 - LEAST`` of it are its prefix; a window without any of them is below ``LEAST``, so
windows are only placed where a prefix shingle stands.

Items are a stated query set. Up to ``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` words are one index
that goes to the executors, and one scan does all. More items are several indexes: one scan
of the texts keeps those that hit a bitmap of all item shingles (at most ``MAP_BITS`` bits),
their shingles get the items' counts by a join, and only these few texts meet each index.
The results don't depend on the blocks.

Defined results: a null or empty text or item matches nothing; an item shorter than ``K``
words is one shingle of all its words; of equally similar windows the first counts;
repeated rows give repeated results, equal items are reported each; ids may be of any type;
a very long text is handled in stretches; extra columns are ignored; empty tables give an
empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import tokens as tk
from .pieces import lookup
from .shared import map_arrow, new_path, read_table, stored, workspace

K = 5
LEAST = 0.8
RADIUS = 31
BLOCKS = 8
BLOCK_ITEMS = 5000
BLOCK_WORDS = 2_000_000
#: Bits for each item shingle in the bitmap, slices in which it is built, and its most bits: 64 MB.
SHINGLE_BITS, SLICES, MAP_BITS = 24, 64, 1 << 29
#: Words of a stretch of a text and windows that are looked up at once.
STRETCH, AT_ONCE = 20_000, 2000
#: Bytes of words: ASCII letters and digits and all of non-ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

Found = list[tuple[int, int, int, float]]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = tk.LOWER[data]
    start, end, first = tk.word_spans(low, offsets, WORD)
    return tk.span_hash(low, start, end), first


def bits(shingle: np.ndarray) -> np.ndarray:
    """128 signs of each shingle hash."""
    both = np.stack([tk.mix(shingle ^ np.uint64(c)) for c in (0x51ED270B, 0xA3C59AC3F1)], axis=-1)
    return np.unpackbits(both.view(np.uint8), axis=-1).astype(np.int8) * 2 - 1


def fingerprint(votes: np.ndarray) -> np.ndarray:
    """Eight 16-bit blocks of the signs of the votes."""
    return np.packbits(votes > 0, axis=-1).view("<u2")


def near_values(radius: int) -> np.ndarray:
    """All 16-bit masks of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(16), r)], np.uint16)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``size`` of them, one run after the other."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and end row of each chunk of a text column, its word hashes and the texts' first words."""
    for lo, hi, data, offsets in tk.chunks(column):
        yield lo, hi, *word_hashes(data, offsets)


class Index:
    """Fingerprints and shingles of a block of items; ``known`` and ``df`` are shingles with the number of items that have them."""

    def __init__(self, ids: list, texts: list[str], n_items: int, known: np.ndarray, df: np.ndarray, k: int, least: float, radius: int):
        self.k, self.least, self.radius, self.ids = k, least, radius, ids
        data = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        words, first = word_hashes(np.frombuffer(b"".join(data), np.uint8), offsets)
        self.size = np.diff(first)  # words
        h, row = tk.shingles(words, first, k)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        self.shingle, self.n_items = np.unique(h), n_items
        self.weight = self.weights(lookup_or(known, df, self.shingle, 1))
        self.longest = float(self.weights(np.zeros(1))[0])  # weight of a shingle that no item has
        inverse = np.searchsorted(self.shingle, h)
        # Distinct shingles of each item with their counts.
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        self.of, self.count = inverse[at], np.diff(at, append=len(h))
        self.border = np.searchsorted(row[at], np.arange(len(ids) + 1))
        own = self.weight[self.of] * self.count
        self.total = np.diff(np.concatenate([[0], np.cumsum(own)])[self.border])
        # The prefix: rarest first, until what is left can't reach the least similarity.
        item = row[at]
        by = np.lexsort((self.shingle[self.of], -self.weight[self.of], item))
        before = np.cumsum(own[by]) - own[by]
        before -= before[self.border[:-1].clip(max=max(0, len(by) - 1))][item[by]] if len(by) else 0
        chosen = by[(before <= (1 - least) * self.total[item[by]] + 1e-9) & (self.size[item[by]] >= k)]
        chosen = chosen[np.argsort(self.of[chosen], kind="stable")]
        self.prefix_item = item[chosen]
        self.prefix_border = np.searchsorted(self.of[chosen], np.arange(len(self.shingle) + 1))
        short = np.flatnonzero((self.size > 0) & (self.size < k))
        self.short = {int(n): (self.shingle[self.of[self.border[mine]]], mine) for n in np.unique(self.size[short]) for mine in [short[self.size[short] == n]]}

        self.prints = np.zeros((len(ids), BLOCKS), np.uint16)
        full = np.flatnonzero(np.diff(self.border) > 0)
        for lo in range(0, len(full), 500):
            some = full[lo : lo + 500]
            a, b = self.border[some[0]], self.border[some[-1] + 1]
            votes = bits(self.shingle[self.of[a:b]]) * own[a:b, None]
            self.prints[some] = fingerprint(np.add.reduceat(votes, self.border[some] - a, axis=0))
        self.masks = near_values(radius // BLOCKS)
        # Items by the value of each block, and where each value begins.
        self.block = [np.argsort(self.prints[:, b], kind="stable").astype(np.int32) for b in range(BLOCKS)]
        self.begins = [np.searchsorted(self.prints[o, b], np.arange((1 << 16) + 1)).astype(np.int32) for b, o in enumerate(self.block)]

    def weights(self, df: np.ndarray) -> np.ndarray:
        return 1 + np.log((1 + self.n_items) / (1 + df))

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of ``prints`` and item of every pair within the radius."""
        pairs = [np.zeros(0, np.int64)]
        for b in range(BLOCKS):
            value = (prints[:, b][:, None] ^ self.masks[None, :]).reshape(-1).astype(np.int64)
            begin = self.begins[b][value]
            many = self.begins[b][value + 1] - begin
            some = np.flatnonzero(many)
            item = self.block[b][spread(begin[some], many[some])]
            pairs.append(np.repeat(some // len(self.masks), many[some]) * len(self.ids) + item)
        both = np.unique(np.concatenate(pairs))
        row, item = both // max(1, len(self.ids)), both % max(1, len(self.ids))
        ok = np.bitwise_count(prints[row] ^ self.prints[item]).sum(-1) <= self.radius
        return row[ok], item[ok]

    def short_items(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """Text, item, first word, words and similarity of items of fewer than ``k`` words."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for n, (name, item) in self.short.items():
            h = tk.ngram_hash(words, n) ^ np.uint64(n)
            order = np.argsort(name, kind="stable")
            ok, at = lookup(name[order], h)
            ok &= row[: len(h)] == row[n - 1 :][: len(h)]
            hit = np.flatnonzero(ok)
            # The first place of each shingle in each text, then all items of that shingle.
            _, one = np.unique(np.stack([row[hit], at[hit]]), axis=1, return_index=True)
            for p in hit[one]:
                for i in item[order][name[order] == h[p]]:
                    yield int(row[p]), int(i), int(p - first[row[p]]), n, 1.0

    def match(self, words: np.ndarray, known: np.ndarray, df: np.ndarray) -> Found:
        """Item, first word, words and similarity of the best window of each item found in one text.

        ``known`` and ``df`` give the counts of shingles that other blocks' items have.
        """
        whole = tk.ngram_hash(words, self.k)
        if len(whole) == 0 or len(self.shingle) == 0:
            return []
        mine, at = lookup(self.shingle, whole)
        place = np.flatnonzero(mine)
        many = np.diff(self.prefix_border)[at[place]]
        item = self.prefix_item[spread(self.prefix_border[at[place]], many)]
        place = np.repeat(place, many)
        if len(place) == 0:
            return []
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        # Starts from where the window holds the place; those of the place before are left out.
        length = self.size[item] - self.k + 1
        lo, hi = np.maximum(0, place - length + 1), np.minimum(place, np.maximum(0, len(whole) - length))
        same = item[1:] == item[:-1]
        lo[1:] = np.where(same, np.maximum(lo[1:], hi[:-1] + 1), lo[1:])
        n = np.maximum(0, hi - lo + 1)
        item, start, length = np.repeat(item, n), spread(lo, n), np.repeat(length, n)
        order = np.lexsort((item, length, start))
        item, start, length = item[order], start[order], length[order]
        weight = np.where(mine, self.weight[at], self.weights(lookup_or(known, df, whole, 0)))
        sums = np.concatenate([[0.0], np.cumsum(weight)])
        best: dict[int, tuple[float, int]] = {}
        a = 0
        while a < len(start):
            b = min(a + AT_ONCE, int(np.searchsorted(start, start[a] + STRETCH)))
            base, top = int(start[a]), min(len(whole), int((start[a:b] + length[a:b]).max()))
            votes = np.zeros((top - base + 1, 128))
            np.cumsum(bits(whole[base:top]) * weight[base:top, None], axis=0, out=votes[1:])
            # One fingerprint for all items of a length.
            new = np.ones(b - a, bool)
            new[1:] = (start[a + 1 : b] != start[a : b - 1]) | (length[a + 1 : b] != length[a : b - 1])
            w = np.flatnonzero(new) + a
            end = np.minimum(start[w] + length[w], len(whole))
            row, found = self.lookup(fingerprint(votes[end - base] - votes[start[w] - base]))
            wanted = (np.cumsum(new) - 1) * len(self.ids) + item[a:b]
            for r, i in zip(*(x[np.isin(row * len(self.ids) + found, wanted)] for x in (row, found)), strict=True):
                s, e = int(start[w[r]]), int(end[r])
                own = slice(self.border[i], self.border[i + 1])
                ok, where = lookup(self.of[own], at[s:e][mine[s:e]])
                both = np.minimum(np.bincount(where[ok], minlength=own.stop - own.start), self.count[own])
                least = float(both @ self.weight[self.of[own]])
                sim = least / (sums[e] - sums[s] + self.total[i] - least)
                if sim >= self.least - 1e-12 and (i not in best or sim > best[i][0] + 1e-12):
                    best[int(i)] = (min(sim, 1.0), s)
            a = b
        return [(i, s, int(self.size[i]), sim) for i, (sim, s) in sorted(best.items())]

    def matches(self, words: np.ndarray, first: np.ndarray, counts: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int, float]]:
        """Text, item, first word, words and similarity in the texts of one chunk."""
        if len(self.shingle) == 0 or len(words) == 0:
            return []
        out = list(self.short_items(words, first))
        ok, _ = lookup(self.shingle, tk.ngram_hash(words, self.k))
        for r in np.unique(np.searchsorted(first, np.flatnonzero(ok), "right") - 1):
            out.extend((int(r), *m) for m in self.match(words[first[r] : first[r + 1]], *counts(int(r))))
        return sorted(out)


def lookup_or(names: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: int) -> np.ndarray:
    ok, at = lookup(names, wanted)
    return np.where(ok, values[at], default) if len(names) else np.full(len(wanted), default)


NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_rows(items: DataFrame, k: int) -> DataFrame:
    """``shingle`` (as a signed number) of each item, once for an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, first in texts_of(batch.column(0)):
                h, row = tk.shingles(words, first, k)
                one = np.unique(np.stack([row.view(np.int64), h.view(np.int64)]), axis=1)[1]
                yield pa.RecordBatch.from_arrays([pa.array(one)], names=["shingle"])

    return map_arrow(items.select("text"), run, "shingle bigint")


def probes(h: np.ndarray, n_bits: int) -> list[np.ndarray]:
    return [tk.mix(h + np.uint64(c)) % np.uint64(n_bits) for c in (0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C)]


def bitmap(frequencies: DataFrame) -> np.ndarray:
    """A Bloom filter of all item shingles, built by slices; at most ``MAP_BITS`` bits come to the driver."""
    n_bits = 1 << 16
    while n_bits < min(MAP_BITS, SHINGLE_BITS * max(1, frequencies.count())):
        n_bits *= 2
    width = n_bits // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(probes(batch.column(0).to_numpy().view(np.uint64), n_bits))).astype(np.int64)
            cut = np.searchsorted(at, np.arange(SLICES + 1) * width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([at[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["slice", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        on = np.zeros(width, bool)
        number = table.column("slice")[0].as_py()
        for b in table.column("bits").to_pylist():
            on[np.frombuffer(b, np.int64) - number * width] = True
        return pa.table({"slice": table.column("slice").slice(0, 1), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    slices = map_arrow(frequencies.select("shingle"), run, "slice int, bits binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary")
    got = {r["slice"]: r["bits"] for r in slices.collect()}
    return np.frombuffer(b"".join(bytes(got.get(i, bytes(width // 8))) for i in range(SLICES)), np.uint8)


def on(map_: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for p in probes(h, 8 * len(map_)):
        out &= (map_[(p >> np.uint64(3)).astype(np.int64)] >> (7 - (p & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return out


def near_texts(docs: DataFrame, frequencies: DataFrame, k: int) -> DataFrame:
    """``doc_id, words, shingles, df`` of the texts that may hold a shingle of an item: word hashes, and the items' shingles among theirs."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(frequencies))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_, run_id, n = sent.value, uuid.uuid4().hex, 0
        for batch in batches:
            for lo, hi, words, first in texts_of(batch.column(1)):
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                hits, rows = [], []
                for size in range(1, k + 1):
                    h = tk.ngram_hash(words, size) ^ np.uint64(size if size < k else 0)
                    ok = on(map_, h) & (row[: len(h)] == row[size - 1 :][: len(h)])
                    hits.append(h[ok])
                    rows.append(row[: len(h)][ok])
                hit, of = np.concatenate(hits), np.concatenate(rows)
                for r in np.unique(of):
                    n += 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([f"{run_id}-{n}"]), batch.column(0).slice(lo + r, 1), pa.array([words[first[r] : first[r + 1]].tobytes()], pa.binary()),
                            pa.array([np.unique(hit[of == r]).view(np.int64).tolist()], pa.list_(pa.int64())),
                        ],
                        names=["key", "doc_id", "words", "hits"],
                    )

    near = stored(map_arrow(docs, run, f"key string, doc_id {kind}, words binary, hits array<bigint>"), "near")
    counts = near.select("key", F.explode("hits").alias("shingle")).join(frequencies, "shingle").groupBy("key").agg(F.collect_list("shingle").alias("shingles"), F.collect_list("df").alias("df"))
    return stored(near.select("key", "doc_id", "words").join(counts, "key").drop("key"), "near")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id_: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
    k: int = K, least: float = LEAST, radius: int = RADIUS, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words``: the best window of each item found in a document."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL")
    narrow = docs.select(F.col(id_).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = [d.schema[0].dataType.simpleString() for d in (narrow, items)]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word bigint, n_words bigint"
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size.n // block_items), -(-(size.bytes or 0) // (6 * BLOCK_WORDS)))

    def index(block: int, frequencies: DataFrame | None) -> Index:
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = mine.orderBy("item_id", "text").collect()
        counts = shingle_rows(mine, k).groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
        if frequencies is not None:
            counts = frequencies.join(counts.select("shingle"), "shingle", "left_semi")
        table = counts.filter("df > 1").toArrow()
        known = table.column("shingle").to_numpy().view(np.uint64)
        order = np.argsort(known)
        return Index([r.item_id for r in rows], [r.text for r in rows], size.n, known[order], table.column("df").to_numpy()[order], k, least, radius)

    def output(found: list[tuple[int, int, int, int, float]], ids: pa.Array, index: Index) -> Iterator[pa.RecordBatch]:
        if found:
            rows, item, start, n, sim = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array([index.ids[i] for i in item]), pa.array(sim, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())],
                names=["doc_id", "item_id", "similarity", "first_word", "n_words"],
            )

    if blocks == 1:
        only = spark.sparkContext.broadcast(index(0, None))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, _, words, first in texts_of(batch.column(1)):
                    yield from output([(lo + r, *m) for r, *m in only.value.matches(words, first, lambda _: NONE)], batch.column(0), only.value)

        return map_arrow(narrow, scan, schema)

    path = new_path(spark, "leaks")
    with workspace(spark):
        frequencies = stored(shingle_rows(items, k).groupBy("shingle").agg(F.count(F.lit(1)).alias("df")), "frequencies")
        near = near_texts(narrow, frequencies, k)

        def one(block: int) -> DataFrame:
            sent = spark.sparkContext.broadcast(index(block, frequencies))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        words = np.frombuffer(batch.column("words")[i].as_py(), np.uint64)
                        known, df = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("shingles", "df"))
                        known = known.view(np.uint64)
                        order = np.argsort(known)
                        found = sent.value.matches(words, np.array([0, len(words)]), lambda _: (known[order], df[order]))
                        yield from output([(i, *m) for _, *m in found], batch.column("doc_id"), sent.value)

            out = stored(map_arrow(near, run, schema), "leaks")
            sent.unpersist()
            return out

        reduce(DataFrame.unionByName, [one(b) for b in range(blocks)]).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
