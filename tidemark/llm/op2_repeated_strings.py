"""Removes byte strings that also start in a document with a smaller id (suffix-array deduplication).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. Common prefixes come from a Burrows-Wheeler transform by threshold-bounded
interval expansion: all intervals of equal strings are extended by one symbol to the left
at a time, so common prefixes appear by increasing length, and the expansion stops at
``LENGTH``. To run it on many machines:

1. Documents are packed into pieces (see ``pieces``); texts are never shuffled. Of equal
   texts only the one with the smallest id goes on; the others are covered by it.
2. Every window of ``LENGTH`` bytes has an anchor, its ``ANCHOR``-byte string with the
   smallest hash. Equal windows have equal anchors, so windows may be dealt out by
   anchor. Consecutive windows with one anchor form a fragment (at most 76 bytes). First
   only the hashes of anchors travel, as packed arrays by hash bucket; a bucket tells the
   pieces which of their anchors another document has too.
3. For those, hashes of the fragments and ids travel to the bucket of the anchor. An anchor
   all of whose fragments are equal is one interval already. Of the others, each
   distinct fragment is asked for at one piece that holds it.
4. A bucket builds the suffix order of these fragments and expands intervals; every
   interval of ``LENGTH``-byte strings has a smallest document id. The smallest ids return
   to the pieces as packed runs, and each document is cut.

An anchor that more than ``HOT_PIECES`` pieces hold is dealt out over several buckets;
the smallest ids of its windows are then merged by a partial aggregation on window hashes.

Whole texts are told apart by 128 bits. Fragments are told apart by 64-bit hashes of their
contents, but only within a bucket, where some 6 million of ``PER_BUCKET`` pieces meet: that
two different ones there are taken for one has a chance of one in a million for each
bucket. Hashes of anchors only decide what travels and meets. Defined results: a null
text is empty and loses nothing; documents shorter than ``LENGTH`` bytes lose nothing; a
null id counts as the largest; ids are whole numbers (others raise an error unless they can
be cast); a very long text is a piece of its own; rows that share an id don't match each other; all columns
of the input are kept, whatever their names, beside the four result columns, which come
last; an empty table gives an empty table.
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
from .shared import finished, map_arrow, read_table, stored

LENGTH = 50
ANCHOR = 24
HOT_PIECES = 2000
#: Pieces whose anchors may meet in one bucket: half a megabyte of hashes each.
PER_BUCKET = 150
#: Bytes of fragments that are expanded at once; the fragments of one anchor stay together.
EXPAND = 1 << 18
#: Symbols that are packed for the first sort.
START = 5
#: Times that many symbols make the first intervals, which are then extended one by one.
FROM = 4
NO_ID = pc.NO_ID
_POS = np.uint64((1 << 24) - 1)


def runs(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int, contents: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, window count, document, anchor hash and content hash (0 without ``contents``) of each fragment.

    Windows stay inside documents. Arrays of more than 2**24 bytes (one very long text)
    are taken in overlapping parts.
    """
    n = len(data)
    limit = 1 << 17
    if n > limit + length:
        parts, at = [], 0
        while at < n - length + 1:
            stop = min(n, at + limit + length - 1)
            lo, hi = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, stop, "left")
            part = runs(data[at:stop], np.clip(offsets[lo : hi + 1], at, stop) - at, length, anchor, contents)
            parts.append((part[0] + at, part[1], part[2] + lo, *part[3:]))
            at += limit
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]
    span = length - anchor + 1
    m = n - length + 1
    if m <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    prefix = tk.prefix_hash(data)
    h = tk.all_hashes(prefix, anchor)
    v = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    low, width = v, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:m], low[span - width : span - width + m])
    # The last windows of each text reach over its end.
    new = np.empty(m, bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    over = np.maximum(offsets[1:] - length + 1, offsets[:-1])
    new[over[over < m]] = True
    new[offsets[offsets < m]] = True
    first = np.flatnonzero(new)
    count = np.diff(first, append=m)
    doc = np.searchsorted(offsets, first, "right") - 1
    ok = first + length <= offsets[1:][doc]
    first, count, doc = first[ok], count[ok], doc[ok]
    at = (low[first] & _POS).astype(np.int64)
    content = tk.span_hash(data, first, first + count + length - 1) if contents else np.zeros(len(first), np.uint64)
    return first, count, doc, h[at] >> np.uint64(16), content


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of ``[first, first + n)`` of each pair, one after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def ranks(value: np.ndarray, bits: int) -> np.ndarray:
    """Dense ranks of numbers of at most ``bits`` bits."""
    n = len(value)
    place = max(1, (n - 1).bit_length())
    if bits + place <= 63:
        # Value and place in one number, so that one plain sort does.
        v = np.sort((value << place) | np.arange(n))
        order = v & ((1 << place) - 1)
        v >>= place
    else:
        order = np.argsort(value)
        v = value[order]
    new = np.zeros(n, np.int64)
    new[1:] = v[1:] != v[:-1]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(new)
    return out


def expand(fragments: list[bytes], ids: np.ndarray, length: int, start: int = START) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the fragments in turn: the smallest id of its interval, and the interval's number.

    The suffix order is by the first ``start * 2**k >= length`` symbols. Intervals are taken
    from the round that sorts by ``FROM * start`` symbols and extended from there.
    """
    size = np.array([len(f) for f in fragments])
    # A zero byte parts the fragments; what follows it never lies in a window.
    t = np.frombuffer(b"\0".join(fragments) + b"\0" * (length + start + 1), np.uint8).astype(np.int64)
    n = int(size.sum()) + len(fragments)
    value = np.zeros(n, np.int64)
    for i in range(start):
        value = (value << 8) | t[i : i + n]
    rank = ranks(value, 8 * start)
    have, first, bits = start, rank, n.bit_length()
    while have < length:
        second = np.zeros(n, np.int64)
        second[: n - have] = rank[have:] + 1
        rank = ranks((rank << bits) | second, 2 * bits)
        have *= 2
        if have == FROM * start:
            first = rank
    suffix = np.argsort(rank)
    # Breadth-first backward extension: the interval of a symbol and a string is where the symbol
    # stands before the string's interval, so two neighbours in suffix order stay together at length
    # d + 1 if their first symbols are equal and their successors share an interval of length d.
    place = np.empty(n, np.int32)
    place[suffix] = np.arange(n, dtype=np.int32)
    head = t[suffix]
    first_edge = np.ones(n, bool)
    first_edge[1:] = head[1:] != head[:-1]
    edge = np.ones(n, bool)
    edge[1:] = first[suffix[1:]] != first[suffix[:-1]]
    successor = place[np.minimum(suffix + 1, n - 1)]
    for _ in range(min(FROM * start, have), length):
        interval = np.cumsum(edge, dtype=np.int32)[successor]
        edge = first_edge.copy()
        edge[1:] |= interval[1:] != interval[:-1]
    number = np.cumsum(edge) - 1
    begin = np.cumsum(size + 1) - size - 1
    windows = size - length + 1
    at = np.repeat(begin - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    mine = number[place[at]]
    smallest = np.full(number[-1] + 1, NO_ID)
    np.minimum.at(smallest, mine, np.repeat(ids, windows))
    return smallest[mine], mine


#: A fragment on its way: hash of its anchor, of its content, smallest id in the piece, buckets of the anchor.
SEEN = np.dtype([("anchor", "<u8"), ("content", "<i8"), ("id", "<i8"), ("deals", "<i4")])
#: Windows a to b of a content have the smallest id low.
RUN = np.dtype([("content", "<i8"), ("low", "<i8"), ("a", "u1"), ("b", "u1")])


def packed_runs(content: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray) -> bytes:
    out = np.empty(len(content), RUN)
    out["content"], out["a"], out["b"], out["low"] = content, a, b, low
    return out.tobytes()


class Repeats:
    """The steps of one run; the parameters travel with the functions to the executors."""

    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT_PIECES, buckets: int = 64, as_text: bool = False, block: int = EXPAND):
        self.length, self.anchor, self.hot, self.buckets, self.as_text, self.block = length, anchor, hot, buckets, as_text, block

    def digests(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digest and id of each text of a piece."""
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                digest = batch.column("digests")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), batch.column("piece")[i].as_py(), np.int64)), pa.array([digest[16 * j : 16 * j + 16] for j in range(len(ids))], pa.binary()), pa.array(ids)],
                    names=["piece", "digest", "id"],
                )

    def _runs(self, batch: pa.RecordBatch, i: int, contents: bool = True):
        """Ids, bytes and fragments of a piece's texts without the copies of others."""
        ids, offsets, data = pc.unpack(batch, i)
        first, count, doc, anchor, content = runs(data, offsets, self.length, self.anchor, contents)
        copies = batch.column("copies")[i].as_py()
        if copies:
            ok = ~np.isin(ids, np.array(copies))[doc]
            first, count, doc, anchor, content = first[ok], count[ok], doc[ok], anchor[ok], content[ok]
        return ids, data, first, count, doc, anchor, content

    def anchors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of a piece's anchors by bucket; one that two documents of the piece have is given twice."""
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, _, _, doc, anchor, _ = self._runs(batch, i, False)
                order = np.lexsort((doc, anchor))
                a, d = anchor[order], doc[order]
                fresh = np.ones(len(a), bool)
                fresh[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
                a = a[fresh]
                third = np.zeros(len(a), bool)
                third[2:] = a[2:] == a[:-2]
                a = a[~third]
                order, some, border = pc.deal((a % np.uint64(self.buckets)).astype(np.int64), self.buckets)
                packed = pc.narrow(a[order], 6)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), batch.column("piece")[i].as_py(), np.int64)), pa.array([packed[border[b] : border[b + 1]].tobytes() for b in some], pa.binary())],
                    names=["bucket", "piece", "anchors"],
                )

    def shared_anchors(self, table: pa.Table) -> pa.Table:
        """To each piece of a bucket: its anchors that other documents have too, and over how many buckets to deal them."""
        found = [pc.widen(b, 6) for b in table.column("anchors").to_pylist()]
        value, count = np.unique(np.concatenate(found), return_counts=True)
        value, count = value[count > 1], count[count > 1]
        out: list[tuple[int, bytes, bytes]] = []
        for piece, own in zip(table.column("piece").to_pylist(), found, strict=True):
            own = np.unique(own)
            ok, at = pc.lookup(value, own)
            if ok.any():
                deals = -(-count[at[ok]] // self.hot)
                # Left out where no anchor of the bucket is dealt out.
                out.append((piece, pc.narrow(own[ok], 6).tobytes(), deals.astype(np.int32).tobytes() if (deals > 1).any() else b""))
        return pa.table({"piece": pa.array([o[0] for o in out], pa.int64()), "anchors": pa.array([o[1] for o in out], pa.binary()), "deals": pa.array([o[2] for o in out], pa.binary())})

    def seen(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece's distinct fragments of shared anchors by bucket: hashes and the smallest id in the piece."""
        for batch in batches:
            for i in range(batch.num_rows):
                ids, data, first, count, doc, anchor, _ = self._runs(batch, i, False)
                value, deals = [], []
                for sent in batch.column("sent")[i].as_py():
                    v = pc.widen(sent["anchors"], 6)
                    value.append(v)
                    deals.append(np.frombuffer(sent["deals"], np.int32) if sent["deals"] else np.ones(len(v), np.int32))
                value, deals = np.concatenate(value), np.concatenate(deals)
                order = np.argsort(value)
                ok, at = pc.lookup(value[order], anchor)
                chosen = np.flatnonzero(ok)
                content = np.zeros(len(first), np.uint64)
                content[chosen] = tk.span_hash(data, first[chosen], first[chosen] + count[chosen] + self.length - 1)
                by = chosen[np.lexsort((ids[doc[chosen]], content[chosen]))]
                fresh = np.ones(len(by), bool)
                fresh[1:] = content[by][1:] != content[by][:-1]
                by = by[fresh]
                out = np.empty(len(by), SEEN)
                out["anchor"], out["content"], out["id"], out["deals"] = anchor[by], content[by].view(np.int64), ids[doc[by]], deals[order][at[by]]
                piece = batch.column("piece")[i].as_py()
                salt = (abs(piece) % np.maximum(out["deals"].astype(np.int64), 1)).astype(np.uint64)
                bucket = (tk.mix(anchor[by] + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.buckets)).astype(np.int64)
                order, some, border = pc.deal(bucket, self.buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), piece, np.int64)), pa.array([out[order[border[b] : border[b + 1]]].tobytes() for b in some], pa.binary())],
                    names=["bucket", "piece", "seen"],
                )

    @staticmethod
    def _bucket(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All fragments seen in a bucket and their pieces; the distinct contents, where each was first, its number by row, and whether its anchor has several."""
        parts = [np.frombuffer(b, SEEN) for b in table.column("seen").to_pylist()]
        rows = np.concatenate(parts) if parts else np.zeros(0, SEEN)
        piece = np.repeat(table.column("piece").to_numpy(), [len(p) for p in parts])
        name, where, back = np.unique(rows["content"], return_index=True, return_inverse=True)
        _, group, size = np.unique(rows["anchor"][where], return_inverse=True, return_counts=True)
        # One bucket of an anchor that is dealt out can't know the contents in the others.
        return rows, piece, name, where, back, (size[group] > 1) | (rows["deals"][where] > 1)

    def wanted(self, table: pa.Table) -> pa.Table:
        """Which piece is to send the bytes of which fragment: those whose anchor has several contents."""
        _, piece, name, where, _, several = self._bucket(table)
        ask = np.flatnonzero(several)
        order = ask[np.argsort(piece[where[ask]], kind="stable")]
        p = piece[where[order]]
        cut = np.flatnonzero(np.diff(p)) + 1
        parts = np.split(order, cut) if len(order) else []
        bucket = table.column("bucket")[0].as_py()
        return pa.table(
            {
                "piece": pa.array([int(piece[where[x[0]]]) for x in parts], pa.int64()),
                "bucket": pa.array([bucket] * len(parts), pa.int32()),
                "contents": pa.array([name[x].tobytes() for x in parts], pa.binary()),
            }
        )

    def fragments(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes that were asked for, by bucket."""
        for batch in batches:
            for i in range(batch.num_rows):
                _, data, first, count, _, _, content = self._runs(batch, i)
                name, where = np.unique(content.view(np.int64), return_index=True)
                wants = batch.column("want")[i].as_py()
                asked = np.frombuffer(b"".join(w["contents"] for w in wants), np.int64)
                at = where[pc.lookup(name, asked)[1]]
                size = count[at] + self.length - 1
                sizes, texts = size.astype(np.uint8).tobytes(), data[ranges(first[at], size)].tobytes()
                # One batch for all buckets: each batch costs as much as many rows.
                border = np.cumsum([0, *(len(w["contents"]) // 8 for w in wants)])
                end = np.concatenate([[0], np.cumsum(size)])[border]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["bucket"] for w in wants], pa.int32()), pa.array([w["contents"] for w in wants], pa.binary()),
                        pa.array([sizes[a:b] for a, b in zip(border[:-1], border[1:], strict=True)], pa.binary()),
                        pa.array([texts[a:b] for a, b in zip(end[:-1], end[1:], strict=True)], pa.binary()),
                    ],
                    names=["bucket", "contents", "sizes", "texts"],
                )

    def intervals(self, table: pa.Table, sent: pa.Table) -> pa.Table:
        """Smallest ids of the windows of a bucket's fragments: packed runs for the pieces, rows for hot anchors."""
        rows, piece, name, where, back, several = self._bucket(table)
        smallest = np.full(len(name), NO_ID)
        np.minimum.at(smallest, back, rows["id"])
        one = np.flatnonzero(~several)
        # A content alone: one run over all its windows, whose number the pieces know.
        of, a, b, low = [one], [np.zeros(len(one), np.int64)], [np.full(len(one), 255)], [smallest[one]]
        number, begin, size, text = (np.zeros(0, np.int64),) * 4
        if sent.num_rows:
            which, sizes, whole = (b"".join(sent.column(x).to_pylist()) for x in ("contents", "sizes", "texts"))
            number = pc.lookup(name, np.frombuffer(which, np.int64))[1]
            size, text = np.frombuffer(sizes, np.uint8).astype(np.int64), np.frombuffer(whole, np.uint8)
            begin = np.cumsum(size) - size
            # Equal windows have equal anchors, so groups of whole anchors are expanded by themselves.
            anchor = rows["anchor"][where[number]]
            order = np.argsort(anchor, kind="stable")
            number, begin, size, anchor = number[order], begin[order], size[order], anchor[order]
            heads = np.flatnonzero(np.diff(anchor, prepend=anchor[:1] ^ np.uint64(1)))
            block = np.cumsum(size)[heads] // self.block
            for some in np.split(np.arange(len(number)), heads[1:][np.diff(block) > 0]):
                lows, _ = expand([whole[x : x + n] for x, n in zip(begin[some], size[some], strict=True)], smallest[number[some]], self.length)
                windows = size[some] - self.length + 1
                w_of, at = np.repeat(number[some], windows), ranges(np.zeros(len(some), np.int64), windows)
                new = np.ones(len(w_of), bool)
                new[1:] = (w_of[1:] != w_of[:-1]) | (lows[1:] != lows[:-1])
                f = np.flatnonzero(new)
                of.append(w_of[f])
                a.append(at[f])
                b.append(at[f] + np.diff(f, append=len(w_of)))
                low.append(lows[f])
        of, a, b, low = (np.concatenate(x).astype(np.int64) for x in (of, a, b, low))
        order = np.argsort(of, kind="stable")
        of, a, b, low = of[order], a[order], b[order], low[order]
        cut = np.searchsorted(of, np.arange(len(name) + 1))
        hot_row = (rows["deals"] > 1) & several[back]
        cold = np.flatnonzero(~hot_row)
        cold = cold[np.argsort(piece[cold], kind="stable")]
        c = back[cold]
        n = cut[c + 1] - cut[c]
        r = ranges(cut[c], n)
        head = np.flatnonzero(np.diff(piece[cold], prepend=~piece[cold][:1]))
        blob, border = packed_runs(np.repeat(rows["content"][cold], n), a[r], b[r], low[r]), np.concatenate([[0], np.cumsum(n)])[np.append(head, len(cold))] * RUN.itemsize
        out_piece, out_blob = piece[cold][head], [blob[x:y] for x, y in zip(border[:-1], border[1:], strict=True)]
        flat = {x: np.zeros(0, np.int64) for x in ("window", "low", "content", "at", "piece")}
        if hot_row.any():
            # The windows of each content once, then for each piece that has it.
            chosen, row = np.unique(back[hot_row]), np.flatnonzero(hot_row)
            order = np.argsort(number)
            at = order[pc.lookup(number[order], chosen)[1]]
            t, windows = text[ranges(begin[at], size[at])], size[at] - self.length + 1
            start = ranges(np.cumsum(size[at]) - size[at], windows)
            window = tk.window_hash(tk.prefix_hash(t), start, start + self.length).view(np.int64)
            r = ranges(cut[chosen], cut[chosen + 1] - cut[chosen])
            lows = np.repeat(low[r], b[r] - a[r])
            j = np.searchsorted(chosen, back[row])
            n = windows[j]
            of = ranges((np.cumsum(windows) - windows)[j], n)
            flat = {"window": window[of], "low": lows[of], "content": np.repeat(rows["content"][row], n), "at": ranges(np.zeros(len(n), np.int64), n), "piece": np.repeat(piece[row], n)}
        k, m = len(out_piece), len(flat["window"])
        pad = lambda x: pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(x)])
        return pa.table(
            {
                "piece": pa.array(np.concatenate([out_piece, flat["piece"]])),
                "runs": pa.concat_arrays([pa.array(out_blob, pa.binary()), pa.nulls(m, pa.binary())]),
                **{x: pad(flat[x]) for x in ("window", "low", "content", "at")},
            }
        )

    def pack_hot(self, table: pa.Table) -> pa.Table:
        """Windows of hot anchors in one piece, each with its merged smallest id, as packed runs."""
        c, at, low = (table.column(x).to_numpy() for x in ("content", "at", "low"))
        return pa.table({"piece": table.column("piece").slice(0, 1), "runs": pa.array([packed_runs(c, at, at + 1, low)], pa.binary())})

    def cut(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts the documents of each piece: rest of the row, counts and what is left of the text."""
        for batch in batches:
            for i in range(batch.num_rows):
                ids, offsets, data = pc.unpack(batch, i)
                texts = len(ids)
                gone = np.zeros(len(data), bool)
                sent = batch.column("sent")[i].as_py()
                if sent:
                    found = np.concatenate([np.frombuffer(s, RUN) for s in sent])
                    found = found[np.argsort(found["content"], kind="stable")]
                    key = np.ascontiguousarray(found["content"])
                    _, _, first, count, doc, _, content = self._runs(batch, i)
                    ok, lo = pc.lookup(key, content.view(np.int64))
                    some = np.flatnonzero(ok)
                    n = np.searchsorted(key, content[some].view(np.int64), "right") - lo[some]
                    r = np.repeat(lo[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    of = np.repeat(some, n)
                    hit = found["low"][r] < ids[doc[of]]
                    r, of = r[hit], of[hit]
                    gone = tk.cover(len(data), first[of] + found["a"][r], first[of] + np.minimum(found["b"][r], count[of]) + self.length - 1)
                row = np.repeat(np.arange(texts), np.diff(offsets))
                copies = batch.column("copies")[i].as_py()
                if copies:
                    gone |= (np.isin(ids, np.array(copies)) & (np.diff(offsets) >= self.length))[row]
                begin = gone.copy()
                begin[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
                kept = np.concatenate([[0], np.cumsum(~gone)])[offsets]
                left = data[~gone]
                texts_left = [left[a:b].tobytes() for a, b in zip(kept[:-1], kept[1:], strict=True)]
                if self.as_text:
                    texts_left = [t.decode("utf-8", "ignore") for t in texts_left]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rest")[i].values, pa.array(np.diff(offsets)), pa.array(np.bincount(row, gone, texts).astype(np.int64)),
                        pa.array(np.bincount(row, begin, texts).astype(np.int64)), pa.array(texts_left, pa.string() if self.as_text else pa.binary()),
                    ],
                    names=["rest", "n_bytes", "n_removed", "n_spans", "kept"],
                )


def remove_repeats(docs: DataFrame, text: str = "text", id_: str = "doc_id", piece: int = pc.PIECE, as_text: bool = False, **parameters: int) -> DataFrame:
    """The columns of ``docs`` without the text, and ``n_bytes, n_removed, n_spans, kept``: the bytes that are left of it.

    With ``as_text`` they are a string, without characters that were cut in two, null
    where the text was. What is written for it stays until the ``workspace`` around it ends.
    """
    spark = docs.sparkSession
    ship(spark)
    others = [c for c in docs.columns if c != text]
    # Of each row the other columns travel with the piece, and whether the text is null.
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), F.col(f"`{text}`").isNull().alias("null"))
    pieces = pc.make_pieces(docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{id_}`").alias("id"), row.alias("row")), "text", "id", ["row"], piece)
    step = Repeats(**{"buckets": pc.bucket_count(pieces, PER_BUCKET, 4), "as_text": as_text} | parameters)
    rest = pieces.schema["rest"].dataType.elementType
    body = ["piece", "ids", "offsets", "bytes"]

    # Ids whose text a smaller id has too, by piece. An id with several texts is left to the windows.
    digests = map_arrow(pieces.select("piece", "ids", "digests"), step.digests, "piece bigint, digest binary, id bigint")
    texts = digests.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    single = digests.groupBy("id").agg(F.countDistinct("digest").alias("texts")).filter("texts = 1").select("id")
    copies = digests.join(texts, "digest").filter("id > least").join(single, "id", "left_semi")
    copies = stored(copies.groupBy("piece").agg(F.collect_list("id").alias("copies")), "copies")
    copies = pc.by_piece(copies, pieces)
    known = pieces.select(*body).join(copies, "piece", "left")

    asked = map_arrow(known, step.anchors, "bucket int, piece bigint, anchors binary")
    shared = asked.groupBy("bucket").applyInArrow(lambda t: step.shared_anchors(t), "piece bigint, anchors binary, deals binary")
    shared = pc.by_piece(shared, pieces).groupBy("piece").agg(F.collect_list(F.struct("anchors", "deals")).alias("sent"))
    seen = map_arrow(known.join(shared, "piece"), step.seen, "bucket int, piece bigint, seen binary")
    wanted = seen.groupBy("bucket").applyInArrow(lambda t: step.wanted(t), "piece bigint, bucket int, contents binary")
    wanted = pc.by_piece(wanted, pieces).groupBy("piece").agg(F.collect_list(F.struct("bucket", "contents")).alias("want"))
    texts = map_arrow(known.join(wanted, "piece"), step.fragments, "bucket int, contents binary, sizes binary, texts binary")
    got = seen.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(lambda a, b: step.intervals(a, b), "piece bigint, runs binary, window bigint, low bigint, content bigint, at bigint")

    if 2 * pieces.count() > step.hot:  # else no anchor is dealt out: a piece gives an anchor twice at most
        got = stored(got, "intervals")
        hot = got.filter(F.col("window").isNotNull())
        merged = hot.groupBy("window").agg(F.min("low").alias("least"))
        hot = hot.join(merged, "window").select("piece", "content", "at", F.col("least").alias("low"))
        hot = hot.groupBy("piece").applyInArrow(lambda t: step.pack_hot(t), "piece bigint, runs binary")
        got = got.filter(F.col("window").isNull()).select("piece", "runs").union(hot)
    back = pc.by_piece(got, pieces).groupBy("piece").agg(F.collect_list("runs").alias("sent"))
    whole = pieces.select("piece", "ids", "offsets", "bytes", "rest").join(copies, "piece", "left").join(back, "piece", "left")
    out = map_arrow(whole, step.cut, f"rest {rest.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept {'string' if as_text else 'binary'}")
    row = F.col("rest")["row"]
    kept = F.when(~row["null"], F.col("kept")) if as_text else F.col("kept")
    return out.select(*(row[f"c{i}"].alias(c) for i, c in enumerate(others)), "n_bytes", "n_removed", "n_spans", kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = lambda: remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return finished(spark, "repeats", cut)


SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), parts AS (  -- long texts in parts, as taking a piece of a long string is slow
  SELECT doc_id, 512 * k AS pos, n, substr(h, 1024 * k + 1, {2 * (511 + LENGTH)}) AS part FROM (SELECT doc_id, h, n, unnest(range(n // 512 + 1)) AS k FROM d)
), w AS (
  SELECT doc_id, pos + j AS i, md5_number(substr(part, 2 * j + 1, {2 * LENGTH})) AS s
  FROM (SELECT doc_id, pos, part, unnest(range(least(512, n - pos - {LENGTH - 1}))) AS j FROM parts)
), m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
c AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE least < doc_id),
e AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 1 ELSE 0 END AS new FROM c),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM e),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY ALL),
t AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
