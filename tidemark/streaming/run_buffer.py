"""The newest readings of one series with an index of its runs, in blocks that are read when they are needed.

Rows are ordered by time and kept in blocks of up to ``2 * BLOCK``; a header tells of each
block where it begins and ends, how many rows and readings it has, and its first and last
start of a run. A message changes the flags of its own row and of the two after it (a null takes the
value before it, and a run ends where that changes), so it reads the blocks around it
and looks at the header for the rest: neither the number of readings nor of runs counts.
A message that comes after all others and the eviction of the oldest row are the common
case and touch one row of the header.
Runs that are long enough and not done are listed as pending.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

BLOCK = 64
HEADER = ("id", "first", "last", "n", "known", "last_known", "first_start", "last_start")


@dataclass
class Block:
    ts: list[int]
    value: list[float | None]
    start: list[bool]


@dataclass
class RunBuffer:
    """``load`` gives a stored block by its id; what a batch changed is in ``changed`` and ``removed``."""

    load: Callable[[int], Block]
    most: int
    min_micros: float
    #: Of each block, in order, what ``HEADER`` names; None where a block has no reading or no start.
    header: list[dict] = field(default_factory=list)
    pending: list[int] = field(default_factory=list)
    done: list[int] = field(default_factory=list)
    next_id: int = 0
    blocks: dict[int, Block] = field(default_factory=dict)
    changed: set[int] = field(default_factory=set)
    removed: set[int] = field(default_factory=set)
    #: Rows and rows of the header looked at, for tests.
    work: int = 0

    def __post_init__(self) -> None:
        #: When each block begins, and the number of rows.
        self.firsts = [h["first"] for h in self.header]
        self.total = sum(h["n"] for h in self.header)

    # Places are pairs of a block's position and a row in it.

    def block(self, i: int) -> Block:
        key = self.header[i]["id"]
        if key not in self.blocks:
            self.blocks[key] = self.load(key)
        return self.blocks[key]

    def describe(self, i: int) -> None:
        """The header of a block after its rows have changed."""
        b, h = self.block(i), self.header[i]
        known = [t for t, v in zip(b.ts, b.value, strict=True) if v is not None]
        starts = [t for t, s in zip(b.ts, b.start, strict=True) if s]
        h |= {"first": b.ts[0], "last": b.ts[-1], "n": len(b.ts), "known": len(known), "last_known": known[-1] if known else None}
        h |= {"first_start": starts[0] if starts else None, "last_start": starts[-1] if starts else None}
        self.firsts[i] = b.ts[0]
        self.changed.add(h["id"])
        self.work += len(b.ts)

    def place(self, t: int) -> tuple[int, int]:
        """Where a row with this time is."""
        i = max(0, bisect_right(self.firsts, t) - 1)
        return i, bisect_left(self.block(i).ts, t)

    def shift(self, at: tuple[int, int], by: int) -> tuple[int, int] | None:
        """The place so many rows on (or back), None beyond the ends."""
        i, j = at
        j += by
        while j < 0:
            i -= 1
            if i < 0:
                return None
            j += self.header[i]["n"]
        while j >= self.header[i]["n"]:
            j -= self.header[i]["n"]
            i += 1
            if i == len(self.header):
                return None
        return i, j

    def time(self, at: tuple[int, int]) -> int:
        return self.block(at[0]).ts[at[1]]

    def value(self, at: tuple[int, int] | None) -> float | None:
        self.work += 1
        return None if at is None else self.block(at[0]).value[at[1]]

    def add(self, t: int, value: float | None) -> None:
        """A reading that arrives; one of the same time is replaced, the oldest beyond ``most`` go."""
        if not self.header or t > self.header[-1]["last"]:
            self._append(t, value)
        else:
            i, j = self.place(t)
            b = self.block(i)
            if j < len(b.ts) and b.ts[j] == t:
                b.value[j] = value
            else:
                b.ts.insert(j, t)
                b.value.insert(j, value)
                b.start.insert(j, False)
                self.total += 1
            self.describe(i)
            if len(b.ts) > 2 * BLOCK:
                self._split(i)
            self._flags(self.place(t))
        while self.total > self.most:
            self._evict()

    def _append(self, t: int, value: float | None) -> None:
        """A row after all others: it goes on with the last run or starts one, and changes no other."""
        before = (len(self.header) - 1, self.header[-1]["n"] - 1) if self.header else None
        v = self.value(before)
        now, was = (v if value is None else value), self._filled(before)
        start = before is None or now is None or was is None or now != was
        if before is None or self.header[-1]["n"] >= 2 * BLOCK:
            self.header.append({"id": self._new(Block([], [], [])), "first": t, "n": 0, "known": 0, "last_known": None, "first_start": None, "last_start": None})
            self.firsts.append(t)
        b, h = self.block(len(self.header) - 1), self.header[-1]
        b.ts.append(t)
        b.value.append(value)
        b.start.append(start)
        h["last"], h["n"] = t, h["n"] + 1
        if value is not None:
            h["known"], h["last_known"] = h["known"] + 1, t
        self.changed.add(h["id"])
        self.total += 1
        if start:
            h["first_start"], h["last_start"] = t if h["first_start"] is None else h["first_start"], t
            return
        first = self._last_start(len(self.header))
        if t - first >= self.min_micros and not self.is_done(first):
            self._pend(first)

    def _pend(self, start: int) -> None:
        k = bisect_left(self.pending, start)
        if k == len(self.pending) or self.pending[k] != start:
            self.pending.insert(k, start)

    def _last_start(self, i: int) -> int:
        """The last start in the blocks before this one."""
        while True:
            i -= 1
            self.work += 1
            if self.header[i]["last_start"] is not None:
                return self.header[i]["last_start"]

    def _new(self, b: Block) -> int:
        self.next_id += 1
        self.blocks[self.next_id] = b
        self.changed.add(self.next_id)
        return self.next_id

    def _split(self, i: int) -> None:
        b, half = self.block(i), len(self.block(i).ts) // 2
        new = self._new(Block(b.ts[half:], b.value[half:], b.start[half:]))
        del b.ts[half:], b.value[half:], b.start[half:]
        self.header.insert(i + 1, {"id": new})
        self.firsts.insert(i + 1, self.blocks[new].ts[0])
        self.describe(i)
        self.describe(i + 1)

    def _evict(self) -> None:
        b, h = self.block(0), self.header[0]
        t, v = b.ts.pop(0), b.value.pop(0)
        b.start.pop(0)
        self.total -= 1
        self._forget(t)
        if b.ts:
            h["first"] = self.firsts[0] = b.ts[0]
            h["n"], h["known"] = len(b.ts), h["known"] - (v is not None)
            h["last_known"] = h["last_known"] if h["known"] else None
            # The row that was evicted, always a start, was the first one.
            h["last_start"] = None if h["last_start"] == t else h["last_start"]
            h["first_start"] = None if h["last_start"] is None else next(x for x, s in zip(b.ts, b.start, strict=True) if s)
            self.changed.add(h["id"])
        else:
            gone = self.header.pop(0)["id"]
            self.firsts.pop(0)
            self.blocks.pop(gone)
            self.changed.discard(gone)
            self.removed.add(gone)
        while self.done and self.done[0] <= t:
            self.done.pop(0)
        if not self.header:
            return
        b, h = self.block(0), self.header[0]
        if b.value[0] is None:
            self._flags((0, 0))  # the row after it may have taken the same value
        elif not b.start[0]:
            # The rest of the run starts here now; later rows see no difference.
            start = b.ts[0]
            b.start[0], h["first_start"] = True, start
            h["last_start"] = start if h["last_start"] is None else h["last_start"]
            self.changed.add(h["id"])
            last = self.span(start)[1]
            if last > start and last - start >= self.min_micros and not self.is_done(start):
                self._pend(start)

    def _forget(self, start: int) -> None:
        k = bisect_left(self.pending, start)
        if k < len(self.pending) and self.pending[k] == start:
            self.pending.pop(k)

    def _filled(self, at: tuple[int, int] | None) -> float | None:
        v = self.value(at)
        return v if v is not None or at is None else self.value(self.shift(at, -1))

    def _flags(self, at: tuple[int, int]) -> None:
        """The starts among a row and the two after it, and which of the runs around are pending."""
        rows = [p for p in (self.shift(at, k) for k in range(3)) if p is not None]
        touched = set()
        for p in rows:
            now, before = self._filled(p), self.shift(p, -1)
            start = before is None or now is None or (was := self._filled(before)) is None or now != was
            b = self.block(p[0])
            if b.start[p[1]] and not start:
                self._forget(b.ts[p[1]])
            if b.start[p[1]] != start:
                b.start[p[1]] = start
                touched.add(p[0])
        for i in touched:
            self.describe(i)
        for start in {self.start_of(p) for p in [self.shift(at, -1), *rows] if p is not None}:
            first, last = self.span(start)
            self._forget(start)
            if last > first and last - first >= self.min_micros and not self.is_done(start):
                insort(self.pending, start)

    def is_done(self, start: int) -> bool:
        k = bisect_left(self.done, start)
        return k < len(self.done) and self.done[k] == start

    def finish(self, start: int) -> None:
        if not self.is_done(start):
            insort(self.done, start)
        self._forget(start)

    def start_of(self, at: tuple[int, int]) -> int:
        """The time at which the run of a row starts; the first row of all is a start."""
        i, j = at
        b = self.block(i)
        while j >= 0 and not b.start[j]:
            j -= 1
        self.work += at[1] - j
        if j >= 0:
            return b.ts[j]
        return self._last_start(i)

    def span(self, start: int) -> tuple[int, int]:
        """First and last time of the run that starts there."""
        i, j = self.place(start)
        b = self.block(i)
        for k in range(j + 1, len(b.ts)):
            self.work += 1
            if b.start[k]:
                return start, b.ts[k - 1]
        for k in range(i + 1, len(self.header)):
            h = self.header[k]
            if h["first_start"] is not None:
                return start, self.header[k - 1]["last"] if h["first_start"] == h["first"] else self.time(self.shift(self.place(h["first_start"]), -1))
        return start, self.header[-1]["last"]

    def known_before(self, t: int, enough: int) -> int:
        """Readings before a time; no more blocks are looked at once there are enough."""
        i, j = self.place(t)
        self.work += j
        n = sum(v is not None for v in self.block(i).value[:j])
        while n < enough and i > 0:
            i -= 1
            self.work += 1
            n += self.header[i]["known"]
        return n

    def last_known(self) -> int | None:
        return next((h["last_known"] for h in reversed(self.header) if h["last_known"] is not None), None)

    def oldest(self) -> int:
        return self.header[0]["first"]

    def around(self, first: int, last: int, context: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Times and values of a run with up to ``context`` rows on either side, and where it begins among them."""
        a, z = self.place(first), self.place(last)
        begin = a
        for _ in range(len(self.header)):
            # Whole blocks back, as long as they are needed.
            had = sum(self.header[k]["n"] for k in range(begin[0], a[0])) + a[1]
            if had >= context or begin[0] == 0:
                break
            begin = (begin[0] - 1, 0)
        ts: list[int] = []
        value: list[float | None] = []
        after = 0
        for i in range(begin[0], len(self.header)):
            b = self.block(i)
            ts += b.ts
            value += b.value
            self.work += len(b.ts)
            after += len(b.ts) - (z[1] + 1 if i == z[0] else 0) if i >= z[0] else 0
            if after >= context:
                break
        at = bisect_left(ts, first)
        low, high = max(0, at - context), bisect_left(ts, last) + 1 + context
        return np.array(ts[low:high], np.int64), np.array([np.nan if v is None else v for v in value[low:high]], float), at - low

    def rows(self) -> Iterator[tuple[int, float | None]]:
        for i in range(len(self.header)):
            yield from zip(self.block(i).ts, self.block(i).value, strict=True)
