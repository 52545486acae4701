"""N-gram Jaccard self-join by a prefix tree, and its groups.

A document's set are its distinct word shingles. Steps:

1. Documents with equal sets (compared by size and a 128-bit sum of hashes) become one
   class; its smallest id stands for it.
2. A global order of all shingles: by the number of documents, rare ones first. Two sets
   with Jaccard similarity t or more share a shingle within their first
   ``n - ceil(t n) + 1`` shingles, whatever the order is, so nothing is lost.
3. Classes that share such a shingle, and whose sizes allow a link, are compared by bitmaps
   of their sets: shingles that fall on bits the other lacks are not shared, which bounds the
   overlap from above. Only pairs that may still be linked join loose clusters (stars for
   each shingle, then connected components), so clusters hold near copies and
   don't grow together over common phrases.
4. Within a cluster the sets, most frequent shingle first, are stored in a prefix tree.
   One descent carries the overlaps of all probing sets along the shared paths and leaves a
   subtree when the shingles that remain in it can't reach the needed overlap. A cluster of
   more than ``BLOCK_SETS`` sets is cut into blocks by the smallest shared shingle, so near
   copies stay together, and only blocks that share a shingle of step 2 are joined; along a
   chain of near copies these are neighbours, so the work grows with the chain.
5. Each task joins what it links by stars, and gives the number of links of each class;
   components of those edges are the groups. Pairs within a group are never written out.

Defined results: null or empty text, or one without a word, has size 0 and no links; rows
with equal sets are linked; ids are whole numbers (other types raise an error unless they
can be cast); rows that share an id are one document, so a link of one of its texts puts
all of them into the group; a row with a null id stands only in its class of equal sets; a
very long text is a piece of its own; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import pieces as pc
from . import tokens as tk
from .graph import components
from .shared import finished, map_arrow, read_table, stored

K = 3
PERCENT = 90
#: Bytes of a shingle's hash that travel to be counted.
WIDTH = 5
#: Pieces whose shingles may meet in one bucket: about a megabyte of hashes each.
PER_BUCKET = 64
BLOCK_ELEMENTS = 100_000
BLOCK_SETS = 256
LARGEST_BLOCK = 4_000_000
BROADCAST_ROWS = 500_000
#: Classes of one shingle that are compared by bitmaps; more are joined to one loose cluster as they are.
MOST_COMPARED = 2000
#: Classes whose shingles meet in one task of that comparison.
COMPARED_TOGETHER = 20_000


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the borders of the texts."""
    low = tk.LOWER[data]
    start, end, first = tk.word_spans(low, offsets)
    h, row = tk.shingles(tk.span_hash(low, start, end), first, k)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(offsets)))


def bitmaps(h: np.ndarray, border: np.ndarray) -> list[bytes | None]:
    """A bitmap of each set: a power of two of bits, two to four for each shingle; a longer one folds onto a shorter one."""
    out: list[bytes | None] = []
    for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        on = np.zeros(1 << max(6, (2 * (b - a) - 1).bit_length()), bool)
        on[(h[a:b] >> np.uint64(20)).astype(np.int64) & (len(on) - 1)] = True
        out.append(np.packbits(on, bitorder="little").tobytes() if b > a else None)
    return out


def fold_to(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words folded to ``words`` of them."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def may_link(differ: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets of together ``sizes`` shingles, ``differ`` of them surely not shared, can be linked."""
    return (percent + 100) * (sizes - differ) >= 2 * percent * sizes


def frequencies(pieces: DataFrame, k: int, buckets: int) -> DataFrame:
    """``piece, sent``: for each piece the shingles that two or more documents have, with their counts.

    Hashes travel to their bucket as packed arrays (``WIDTH`` bytes each, once for a piece)
    and answers come back the same way. Two shingles that agree in bucket and bytes share a
    count, which only moves them in the order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, offsets, data = pc.unpack(batch, i)
                h, n = np.unique(sets_of(data, offsets, k)[0], return_counts=True)
                order, some, border = pc.deal((h % np.uint64(buckets)).astype(np.int64), buckets)
                packed, many = pc.narrow(h[order] >> np.uint64(8), WIDTH), n[order]
                one, more = [], []
                for b in some:
                    part, c = packed[border[b] : border[b + 1]], many[border[b] : border[b + 1]]
                    one.append(part[c == 1].tobytes())
                    more.append(part[c > 1].tobytes() + c[c > 1].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), batch.column("piece")[i].as_py(), np.int64)), pa.array(one, pa.binary()), pa.array(more, pa.binary())],
                    names=["bucket", "piece", "one", "more"],
                )

    def answer(table: pa.Table) -> pa.Table:
        own = []
        for one, more in zip(table.column("one").to_pylist(), table.column("more").to_pylist(), strict=True):
            m = len(more) // (WIDTH + 4)
            a, b = pc.widen(one, WIDTH), pc.widen(more[: m * WIDTH], WIDTH)
            own.append((np.concatenate([a, b]), np.concatenate([np.ones(len(a), np.int64), np.frombuffer(more[m * WIDTH :], "<u4").astype(np.int64)])))
        value, back = np.unique(np.concatenate([h for h, _ in own]), return_inverse=True)
        total = np.bincount(back, np.concatenate([n for _, n in own])).astype(np.int64)
        piece, sent, at = [], [], 0
        for p, (h, _) in zip(table.column("piece").to_pylist(), own, strict=True):
            df = total[back[at : at + len(h)]]
            at += len(h)
            ok = df > 1
            if ok.any():
                piece.append(p)
                sent.append(pc.narrow(h[ok], WIDTH).tobytes() + np.minimum(df[ok], 0xFFFFFF).astype("<u4").tobytes())
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(piece), pa.int32()), "piece": pa.array(piece, pa.int64()), "counts": pa.array(sent, pa.binary())})

    ship(pieces.sparkSession)
    asked = map_arrow(pieces.select("piece", "ids", "offsets", "bytes"), count, "bucket int, piece bigint, one binary, more binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "bucket int, piece bigint, counts binary")
    return pc.by_piece(answers, pieces).groupBy("piece").agg(F.collect_list(F.struct("bucket", "counts")).alias("sent"))


def signatures(pieces: DataFrame, counts: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """``doc_id, n, s1, s2, prefix, bits``: set size, its 128-bit sum, those of the first shingles that other documents have too, and the bitmap of a set with such shingles.

    The order is by count, then by hash.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, offsets, data = pc.unpack(batch, i)
                h, border = sets_of(data, offsets, k)
                n = np.diff(border)
                weight = np.ones(len(h), np.int64)
                bucket = h % np.uint64(buckets)
                for one in batch.column("sent")[i].as_py() or []:
                    m = len(one["counts"]) // (WIDTH + 4)
                    keys, df = pc.widen(one["counts"][: m * WIDTH], WIDTH), np.frombuffer(one["counts"][m * WIDTH :], "<u4")
                    order = np.argsort(keys)
                    mine = np.flatnonzero(bucket == np.uint64(one["bucket"]))
                    ok, at = pc.lookup(keys[order], (h[mine] >> np.uint64(8)) & np.uint64((1 << (8 * WIDTH)) - 1))
                    weight[mine[ok]] = df[order][at[ok]]
                row = np.repeat(np.arange(len(ids)), n)
                total = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                sums = [(t := total(tk.mix(h ^ np.uint64(c))))[border[1:]] - t[border[:-1]] for c in (0x1234567, 0x89ABCDEF01)]
                order = np.lexsort((h, weight, row))
                p = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                chosen = order[((np.arange(len(h)) - border[row]) < p[row]) & (weight[order] > 1)]
                per = np.bincount(row[chosen], minlength=len(ids))
                ends = np.where(per > 0, border[1:], border[:-1])
                maps = [m for a, b in zip(border[:-1], ends, strict=True) for m in bitmaps(h, np.array([a, b]))]
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(h[chosen].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == pc.NO_ID), pa.array(n.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums), prefix, pa.array(maps, pa.binary())],
                    names=["doc_id", "n", "s1", "s2", "prefix", "bits"],
                )

    joined = pieces.select("piece", "ids", "offsets", "bytes").join(counts, "piece", "left").select("ids", "offsets", "bytes", "sent")
    return map_arrow(joined, sign, "doc_id bigint, n bigint, s1 bigint, s2 bigint, prefix array<bigint>, bits binary")


def size_step(percent: int):
    """Sizes that allow a link lie in the same or in neighbouring steps of this scale."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int")


def keyed(classes: DataFrame, percent: int, *columns: str) -> DataFrame:
    """The classes' ``columns`` by ``token, step``; classes that can be linked meet in one of them."""
    step = size_step(percent)
    return classes.select(*columns, F.explode("prefix").alias("token"), F.array(step, step + 1).alias("steps")).select(*columns, "token", F.explode("steps").alias("step"))


def stars(rep: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each class to the smallest one with its label: components of stars are found in few rounds."""
    _, group = np.unique(label, return_inverse=True)
    low = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(low, group, rep)
    other = low[group] != rep
    return rep[other], low[group][other]


def compare(table: pa.Table, percent: int) -> pa.Table:
    """Edges that join the classes of each ``token, step`` that may be linked, directly or through others."""
    col = lambda name: table.column(name).to_numpy()
    token, step, rep, n = col("token"), col("step"), col("rep"), col("n")
    maps = table.column("bits").to_pylist()
    order = np.lexsort((rep, step, token))
    new = np.ones(len(order), bool)
    new[1:] = (token[order][1:] != token[order][:-1]) | (step[order][1:] != step[order][:-1])
    cut = np.append(np.flatnonzero(new), len(order))
    size = np.diff(cut)
    edges_a, edges_b = [], []

    def rows_of(at: np.ndarray) -> np.ndarray:
        words = min(len(maps[i]) for i in at) // 8
        return np.concatenate([fold_to(np.frombuffer(maps[i], "<u8").reshape(1, -1), words) for i in at])

    for a, m in zip(cut[:-1][size > 1], size[size > 1], strict=True):
        at = order[a : a + m]
        bits, sizes, label = rows_of(at), n[at], np.arange(m)
        for i in range(m - 1):
            differ = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1).astype(np.int64)
            found = np.flatnonzero(may_link(differ, sizes[i + 1 :] + sizes[i], percent)) + i + 1
            for other in np.unique(label[found]):
                if other != label[i]:
                    label[label == other] = label[i]
        a, b = stars(rep[at], label)
        edges_a.append(a)
        edges_b.append(b)
    edges_a, edges_b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (edges_a, edges_b))
    return pa.table({"a": pa.array(edges_a, pa.int64()), "b": pa.array(edges_b, pa.int64())})


def loose_clusters(classes: DataFrame, percent: int) -> DataFrame:
    """``id, component``: classes that could be linked, from ``rep, n, s1, prefix, bits``."""
    ship(classes.sparkSession)
    entries = keyed(classes, percent, "rep", "n", "s1")
    # Near copies share many shingles; of those that the same classes share one is enough.
    members = (F.bit_xor(F.xxhash64("rep", "s1")).alias("x"), F.sum(F.hash("rep", "s1").cast("long")).alias("y"))
    counts = entries.groupBy("token", "step").agg(F.count(F.lit(1)).alias("df"), F.min("rep").alias("low"), *members).filter("df > 1")
    counts = counts.groupBy("df", "low", "x", "y").agg(F.min(F.struct("token", "step")).alias("key"))
    met = stored(entries.join(counts.select("key.token", "key.step", "df", "low"), ["token", "step"]), "met")
    hot = met.filter(F.col("df") > MOST_COMPARED).select(F.col("rep").alias("a"), F.col("low").alias("b"))
    few = met.filter(F.col("df") <= MOST_COMPARED)
    buckets = max(1, -(-few.count() // COMPARED_TOGETHER))
    near = few.join(classes.select("rep", "s1", "bits"), ["rep", "s1"])
    near = near.select(F.pmod(F.xxhash64("token", "step"), F.lit(buckets)).cast("int").alias("bucket"), "token", "step", "rep", "n", "bits")
    pairs = near.groupBy("bucket").applyInArrow(lambda t: compare(t, percent), "a bigint, b bigint")
    return components(hot.unionByName(pairs))


def trie_join(sets_: list[np.ndarray], n_targets: int, same: bool, percent: int, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a prefix tree of the first ``n_targets`` sets with the other sets (``same``: with each other).

    Gives a label for each set, equal where links connect them, and the copies each is linked to.
    """
    m = len(sets_)
    links, label = np.zeros(m, np.int64), np.arange(m)
    size = np.array([len(s) for s in sets_])
    _, inverse, count = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    # Most frequent first; shingles of one set only can't overlap and count by the size alone.
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    width = int((count > 1).sum())
    border = np.concatenate([[0], np.cumsum(size)])
    paths = [np.sort(r[r < width]).astype(">u4") for r in (rank[inverse[a:b]] for a, b in zip(border[:-1], border[1:], strict=True))]
    targets = sorted(range(n_targets), key=lambda i: paths[i].tobytes())
    shared = [0] * (len(targets) + 1)  # common prefix with the target before
    for i in range(1, len(targets)):
        a, b = paths[targets[i - 1]], paths[targets[i]]
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[:k] != b[:k])
        shared[i] = int(differ[0]) if len(differ) else k
    common, t_size = np.array(shared), size[targets]
    depth_of = np.array([len(paths[t]) for t in targets])
    order = np.full(m, len(targets))
    order[targets] = np.arange(len(targets))
    probes = np.array([t for t in targets] if same else range(n_targets, m))
    step = max(1, (1 << 24) // max(1, width))
    for i in range(0, len(probes), step):
        some = probes[i : i + step]
        has = np.zeros((width, len(some)), bool)
        for j, p in enumerate(some):
            has[paths[p].astype(np.int64), j] = True
        p_size, p_order = size[some], order[some]
        stack = [(0, len(targets), 0, np.arange(len(some)), np.zeros(len(some), np.int64))]
        while stack:
            lo, hi, depth, live, overlap = stack.pop()
            end = int(depth_of[lo]) if hi - lo == 1 else int(min(common[lo + 1 : hi].min(), depth_of[lo]))
            path = paths[targets[lo]]
            least, most, deepest = t_size[lo:hi].min(), t_size[lo:hi].max(), int(depth_of[lo:hi].max())
            while True:
                n = p_size[live]
                ok = (percent + 100) * (overlap + deepest - depth) >= percent * (n + least)
                ok &= (100 * n >= percent * least) & (100 * most >= percent * n)
                if same:
                    ok &= p_order[live] > lo
                live, overlap = live[ok], overlap[ok]
                if depth >= end or len(live) == 0:
                    break
                to = min(end, depth + 32)
                overlap = overlap + has[path[depth:to].astype(np.int64)][:, live].sum(0)
                depth = to
            if len(live) == 0:
                continue
            at = lo
            while at < hi and depth_of[at] == end:
                t, n = targets[at], p_size[live]
                found = (percent + 100) * overlap >= percent * (n + t_size[at])
                if same:
                    found &= p_order[live] > at
                linked = some[live[found]]
                if len(linked):
                    links[t] += copies[linked].sum()
                    links[linked] += copies[t]
                    for other in np.unique(label[linked]):
                        if other != label[t]:
                            label[label == other] = label[t]
                at += 1
            cuts = [at, *(np.flatnonzero(common[at + 1 : hi] == end) + at + 1).tolist(), hi] if at < hi else []
            stack.extend((a, b, end, live, overlap) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    return label, links


def blocks_of(members: DataFrame) -> DataFrame:
    """Adds ``blocks``, those of the cluster, and ``block``: by the smallest shared shingle, and by class where too many share that."""

    def parts(rows: DataFrame, name: str, *key: str) -> DataFrame:
        sizes = rows.groupBy(*key).agg(F.sum("n").alias("elements"), F.count(F.lit(1)).alias("sets"))
        fit = F.greatest(F.least(F.ceil(F.col("elements") / BLOCK_ELEMENTS), F.ceil(F.col("sets") / BLOCK_SETS)), F.ceil(F.col("elements") / LARGEST_BLOCK))
        return sizes.select(*key, fit.cast("long").alias(name))

    rows = members.join(parts(members, "blocks", "component"), "component")
    rows = rows.withColumn("first", F.pmod(F.xxhash64(F.array_min("prefix")), F.col("blocks")))
    rows = rows.join(parts(rows, "subs", "component", "first"), ["component", "first"])
    block = F.shiftleft("first", 24) + F.pmod(F.xxhash64("rep", "s1"), F.col("subs"))
    return rows.withColumn("block", F.when(F.col("blocks") > 1, block).otherwise(0))


def block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """``component, block, p, q``: the tasks of each block of large clusters, a pair of blocks that share a shingle each."""
    keys = keyed(members.filter("blocks > 1"), percent, "component", "block").distinct()
    all_ = keys.groupBy("component", "token", "step").agg(F.sort_array(F.collect_list("block")).alias("all")).select("component", "all").distinct()
    pairs = all_.select("component", F.explode("all").alias("p"), "all").select("component", "p", F.explode(F.filter("all", lambda x: x >= F.col("p"))).alias("q")).distinct()
    other = pairs.filter("p < q").select("component", F.col("q").alias("block"), "p", "q")
    return stored(pairs.select("component", F.col("p").alias("block"), "p", "q").unionByName(other), "tasks")


def linked_classes(docs: DataFrame, classes: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b`` (edges that join linked classes) and ``a, links`` (links of a class, by task)."""
    spark = docs.sparkSession
    members = stored(blocks_of(classes.select("rep", "n", "s1", "copies", "prefix").join(clusters, F.col("rep") == F.col("id")).drop("id")), "members")
    tasks = block_pairs(members, percent)
    near = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    # Rows that share an id are one document: all its texts go wherever one of them goes.
    sent = members.groupBy("rep", "component", "block").agg(F.max("copies").alias("copies"))
    chosen = docs.select("doc_id", "text").join(near(sent), F.col("doc_id") == F.col("rep"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column(0)):
                h, border = sets_of(data, offsets, k)
                values = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(1, 5)), values], names=["rep", "copies", "component", "block", "shingles"])

    rows = map_arrow(chosen.select("text", "rep", "copies", "component", "block"), expand, "rep bigint, copies bigint, component bigint, block bigint, shingles array<bigint>")
    dealt = rows.join(near(tasks), ["component", "block"], "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("p", "q")})

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        col = lambda name: table.column(name).to_numpy()
        same = col("p")[0] == col("q")[0]
        order = np.lexsort((col("rep"), col("block")))
        lists = table.column("shingles").chunk(0)
        flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        # Of repeated rows (one id, one set) the first stands for all; they have been counted as copies.
        once: set[tuple[int, int, bytes]] = set()
        seen = lambda key: key in once or once.add(key)
        order = np.array([i for i in order if not seen((int(col("block")[i]), int(col("rep")[i]), flat[off[i] : off[i + 1]].tobytes()))], np.int64)
        whole = [flat[off[i] : off[i + 1]] for i in order]
        n_targets = len(order) if same else int((col("block")[order] == col("p")[0]).sum())
        rep, copies = col("rep")[order], col("copies")[order]
        some = 0 < n_targets and (same or n_targets < len(order))
        label, links = trie_join(whole, n_targets, bool(same), percent, copies) if some else (np.arange(len(order)), np.zeros(len(order), np.int64))
        has = np.flatnonzero(links)
        a, b = stars(rep, label)
        n = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(links[has])])
        return pa.table({"a": pa.array(np.concatenate([a, rep[has]])), "b": pa.concat_arrays([pa.array(b), pa.nulls(len(has), pa.int64())]), "links": n})

    ship(spark)
    return stored(dealt.groupBy("component", "p", "q").applyInArrow(join, "a bigint, b bigint, links bigint"), "links")


def ngram_groups(docs: DataFrame, text: str = "text", id_: str = "doc_id", k: int = K, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every row; a group holds all that is reachable by links.

    The result is written; all other tables are deleted before the function returns.
    """
    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return finished(docs.sparkSession, "groups", lambda: _groups(rows, k, percent))


def _groups(docs: DataFrame, k: int, percent: int) -> DataFrame:
    pieces = pc.make_pieces(docs, "text", "doc_id", [])
    buckets = pc.bucket_count(pieces, PER_BUCKET, 2)
    signed = stored(signatures(pieces, frequencies(pieces, k, buckets), k, percent, buckets), "signed")
    key = ["n", "s1", "s2"]
    classes = stored(
        signed.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")), "classes"
    )
    clusters = stored(loose_clusters(classes.filter(F.col("rep").isNotNull()), percent), "clusters")
    links = linked_classes(docs, classes, clusters, k, percent)
    groups = components(links.filter(F.col("b").isNotNull()).select("a", "b"))
    degree = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("degree"))
    named = classes.select(*key, "rep", "copies").join(groups, F.col("rep") == F.col("id"), "left").join(degree, "rep", "left")
    named = named.select(*key, F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"))
    out = signed.select("doc_id", *key).join(named, key, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def query(spark, sf_dir: str) -> DataFrame:
    return ngram_groups(read_table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM d
), n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
g AS (SELECT a, count(*)::BIGINT AS n_links FROM e GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM n JOIN k ON k.a = n.doc_id LEFT JOIN g ON g.a = n.doc_id
"""
