"""Quality rules: counts per document, and repetition from a suffix array over words.

Every document is handled alone inside an Arrow batch, so nothing is shuffled: one
scan, one pass. The suffix array orders the suffixes of the word sequence of each
document (prefix doubling, all documents of a piece at once). Neighbours' longest common
prefixes make intervals: suffixes that stand together with prefixes of ``WINDOW`` words or more
are the places of one repeat, whose longest common prefix can't be extended to the right;
those that can't be extended to the left either are the maximal repeats. The verdict comes
from them: the union of the spans of all places but the first of each interval is limited
to a part of the words, and so is the longest repeat.

Only ranks and one array of prefix hashes are kept, so a text of n words needs about
100 n bytes. Defined results: a null or empty text has zero words and fails the base rule;
repeated rows are judged alone, each with the same result; a very long text is a piece of
its own; extra columns of the input are ignored unless named in ``keep``; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .shared import map_arrow, read_table

WINDOW = 8
MIN_WORDS = 20
MAX_WINDOW_PERCENT = 30
#: The method's limits: percent of words in maximal repeats of at least WINDOW words, second
#: and later copies only, and the longest repeat in words.
MAX_REPEAT_PERCENT = 20
MAX_LONGEST = 100
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_copy_words", "n_repeats", "longest_repeat")


def suffix_order(word: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The suffixes in the order of their words; ``word`` differs between documents, which begin at ``first``.

    Ranks by the first 1, 2, 4, ... words until no two are equal; a rank is the position of the
    first suffix of its class, so classes that are split keep their place among the others.
    """
    last = first[1:][row]
    _, rank, count = np.unique(word, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[rank]
    n, k = len(rank), 1
    while True:
        open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if len(open_) == 0:
            order = np.empty(n, np.int64)
            order[rank] = np.arange(n)
            return order
        nxt = open_ + k
        second = np.where(nxt < last[open_], rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[open_]))
        a, b = rank[open_][order], second[order]
        start = np.concatenate([[True], a[1:] != a[:-1]])
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        at = np.arange(len(a))
        rank[open_[order]] = a + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(start, at, 0))
        k *= 2


def common_prefixes(order: np.ndarray, word: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the next one in the order, within a document."""
    prefix = tk.sequence_hash(word)
    a, b = order[:-1].copy(), order[1:].copy()
    left = np.minimum(first[1:][row[a]] - a, first[1:][row[b]] - b)
    live = np.flatnonzero((row[a] == row[b]) & (word[a] == word[b]))
    lcp = np.zeros(len(a), np.int64)
    size = 1 << max(0, int(left.max(initial=1)).bit_length() - 1)
    while size:
        some = live[lcp[live] + size <= left[live]]
        x, y = a[some] + lcp[some], b[some] + lcp[some]
        same = tk.sequence_span(prefix, x, size) == tk.sequence_span(prefix, y, size)
        lcp[some[same]] += size
        size //= 2
    return lcp


class Repeats:
    """Repeats of ``window`` words or more in the texts of a piece."""

    def __init__(self, word: np.ndarray, row: np.ndarray, first: np.ndarray, window: int):
        n = len(word)
        order = suffix_order(word, row, first)
        lcp = common_prefixes(order, word, row, first)
        #: The longest repeat that starts at each word.
        self.longest = np.zeros(n, np.int64)
        np.maximum.at(self.longest, order[:-1], lcp)
        np.maximum.at(self.longest, order[1:], lcp)
        # Intervals of suffixes that share the window; their first place isn't a copy.
        together = lcp >= window
        number = np.concatenate([[0], np.cumsum(~together)])[: n]
        earliest = np.full(n, n)
        np.minimum.at(earliest, number, order)
        inside = np.zeros(n, bool)
        inside[:-1] |= together
        inside[1:] |= together
        place = order[inside]
        self.places = np.sort(place)
        self.later = np.sort(place[place != earliest[number[inside]]])


def measure(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """All counts of the texts in one piece."""
    texts = len(offsets) - 1
    start, end, first = tk.word_spans(data, offsets)
    n = len(start)
    count = np.diff(first)
    row = np.repeat(np.arange(texts), count)
    per = lambda of, w: np.bincount(of, w, minlength=texts).astype(np.int64)
    out = {"n_words": count.astype(np.int64)}

    of_byte = np.repeat(np.arange(texts), np.diff(offsets))
    code_point = ((data & 0xC0) != 0x80) & ~tk.SPACE[data]
    out["word_chars"] = per(of_byte, code_point)
    out["n_symbols"] = per(of_byte, SYMBOLS[data])

    # Lines: pieces between "\n" and the ends of texts; those without a word don't count.
    cut = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([offsets[:-1], cut + 1])) if len(data) else np.zeros(0, np.int64)
    begins = begins[begins < len(data)]
    stops = np.concatenate([begins[1:], [len(data)]]) if len(begins) else begins
    stops = np.where((stops > 0) & (stops > begins), stops - (data[np.maximum(stops - 1, 0)] == 10), stops)
    full = np.searchsorted(start, stops) > np.searchsorted(start, begins)
    begins, stops = begins[full], stops[full]
    of_line = np.searchsorted(offsets, begins, "right") - 1
    key = tk.span_hash(data, begins, stops) if len(begins) else np.zeros(0, np.uint64)
    order = np.lexsort((key, of_line))
    again = (key[order][1:] == key[order][:-1]) & (of_line[order][1:] == of_line[order][:-1])
    out["n_dup_lines"] = per(of_line[order][1:][again], None)

    zero = np.zeros(texts, np.int64)
    out |= {k: zero.copy() for k in MEASURES[4:]}
    if n == 0:
        return out
    word = tk.span_hash(data, start, end)
    both = tk.mix(word ^ tk.mix(row.astype(np.uint64) + np.uint64(1)))
    found = Repeats(both, row, first, window)
    longest, hot, later = found.longest, found.places, found.later
    np.maximum.at(out["longest_repeat"], row, longest)
    if len(hot) == 0:
        return out
    out["n_repeat_words"] = per(row, tk.cover(n, hot, hot + longest[hot]))
    out["n_copy_words"] = per(row, tk.cover(n, later, later + window))
    # Maximal repeats: not to be extended to the left within the document.
    left = np.concatenate([[0], longest[:-1]])
    left[first[:-1][count > 0]] = 0
    out["n_repeats"] = per(row[hot[left[hot] != longest[hot] + 1]], None)
    return out


def repeated_spans(text: str | None, window: int = WINDOW) -> list[tuple[int, int]]:
    """Union of the spans of all maximal repeats of one text, as word positions ``[start, end)``."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    offsets = np.array([0, len(data)])
    start, end, first = tk.word_spans(data, offsets)
    if len(start) == 0:
        return []
    row = np.zeros(len(start), np.int64)
    found = Repeats(tk.span_hash(data, start, end), row, first, window)
    hot, longest = found.places, found.longest
    flag = np.concatenate([[0], tk.cover(len(start), hot, hot + longest[hot]).astype(np.int8), [0]])
    edge = np.diff(flag)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    window: int = WINDOW,
    min_words: int = MIN_WORDS,
    max_window_percent: int = MAX_WINDOW_PERCENT,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """The columns ``keep`` with all measures, ``base_failed`` and ``kept``."""
    narrow = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text"))
    fields = [*narrow.schema.fields[:-1]]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{m} bigint" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column(len(fields))):
                got = measure(data, offsets, window)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(len(fields))), *(pa.array(got[m], pa.int64()) for m in MEASURES)],
                    names=[*keep, *MEASURES],
                )

    out = map_arrow(narrow, run, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_window_percent * F.col("n_words"))
    verdict = (100 * F.col("n_copy_words") <= max_repeat_percent * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         w, text
  FROM d
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM b
), dl AS (
  SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines
  FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL)
  GROUP BY doc_id
), win AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + {WINDOW} - 1), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, n_words - {WINDOW} + 2)) AS p FROM b)
), rk AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n, row_number() OVER (PARTITION BY doc_id, s ORDER BY p) AS k FROM win
), cov AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words, count(DISTINCT CASE WHEN k > 1 THEN q END) AS n_copy_words
  FROM (SELECT doc_id, k, unnest(range(p, p + {WINDOW})) AS q FROM rk WHERE n > 1) GROUP BY doc_id
), lng AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, array_to_string(list_slice(w, p, p + {MAX_LONGEST}), ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, n_words - {MAX_LONGEST} + 1)) AS p FROM b WHERE doc_id IN (SELECT doc_id FROM cov))
  ) GROUP BY doc_id, s HAVING count(*) > 1
), f AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_copy_words, 0) AS n_copy_words,
         lng.doc_id IS NOT NULL AS long
  FROM b LEFT JOIN dl USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lng ON b.doc_id = lng.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_WINDOW_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_WINDOW_PERCENT} * n_words)
         AND 100 * n_copy_words <= {MAX_REPEAT_PERCENT} * n_words AND NOT long AS kept
FROM f
"""
