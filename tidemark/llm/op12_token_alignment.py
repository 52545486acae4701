"""Alignment of two tokenizers' tokens over whole texts, with corpus-wide counts of linked ids.

Both tokenizers give the bytes of one space and the text. For each, a packed bit set marks
the last byte of every token; their AND marks the cuts both share, their OR the ends of the
stretches that lie in one token of either. Ranks (popcounts) turn cuts into token ranges,
the groups, and stretches into pairs of overlapping tokens, the links: two tokens overlap
in exactly one stretch. A text longer than ``SEGMENT`` is cut before single spaces after
something else, where tokens of both kinds end anyway, so memory follows the segment.

Texts are tokenized once. Tasks write one row for each piece of some megabytes: the numbers
and digests of its documents, its distinct id pairs with the documents that hold them, and
which of them each document holds how often. Pairs are pre-aggregated in the task, then
counted by Spark; the highest count of each A id is a table no longer than the vocabulary,
so it may be broadcast. Pieces' distinct pairs meet their counts in a join by pair (the
side with counts is unique, so a pair that all pieces hold can be split), and answers meet
their piece again.

Defined results: texts that are null or empty, or whose tokens don't give back the bytes
(a literal U+2581, unknown symbols), have no tokens: zeros and an empty digest; white space
is text; strings of special tokens are plain text; a null id stays null; repeated rows and ids
are further documents; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as pc
from . import tokens as tk
from .shared import finished, map_arrow, read_table, stored

PIECE = 3 << 20
#: Longest stretch of one text, and of several, that is tokenized at once where it can be cut.
SEGMENT = 1 << 19
#: Pairs that a task counts before it hands them on.
HELD = 2_000_000
#: Ids of a vocabulary whose highest counts may be broadcast: 16 MB.
BROADCAST_IDS = 1_000_000


class Bits:
    """A packed bit set with a rank directory."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-(size + 1) // 64) * 64, bool)
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def rank(self, place: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, below = place >> 6, (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def places(self) -> np.ndarray:
        """Select: the places of all bits in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def has(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


class Vocabulary:
    """The bytes of each token by id, and the id's decimal digits."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.width = len(str(len(tokens) - 1))
        texts = [str(i).encode().ljust(self.width, b"\0") for i in range(len(tokens))]
        self.digits = np.frombuffer(b"".join(texts), np.uint8).reshape(len(tokens), self.width)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + size, size)]


def byte_alphabet() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def tokenizers(byte_level: bytes, pieces: bytes):
    """Both tokenizers and their vocabularies, once for each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(byte_level.decode())
    a.encode_special_tokens = True
    alphabet = byte_alphabet()
    names = {i: t for t, i in json.loads(byte_level)["model"]["vocab"].items()}
    tokens_a = [bytes(alphabet[c] for c in names.get(i, "") if c in alphabet) for i in range(max(names) + 1)]
    b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
    tokens_b = []
    for i in range(b.get_piece_size()):
        name = b.id_to_piece(i)
        tokens_b.append(bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode())
    return a, b, Vocabulary(tokens_a), Vocabulary(tokens_b)


def segments(text: str, limit: int) -> list[str]:
    """The text in parts that start with a space after something that isn't white space, all but the first."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        cut = re.compile(r"(?<=\S) ").search(text, at + limit)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class Aligned:
    """Parts of texts, each starting with its space, as both tokenizers cut them."""

    def __init__(self, texts: list[str], models: tuple):
        a, b, words_a, words_b = models
        self.ok = np.ones(len(texts), bool)
        raw = [t.encode() for t in texts]
        in_a = [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)]
        # The second tokenizer adds the space itself.
        in_b = b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        while True:
            ids_a, ids_b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (in_a, in_b))
            whole = np.frombuffer(b"".join(raw), np.uint8)
            if np.array_equal(words_a.spell(ids_a), whole) and np.array_equal(words_b.spell(ids_b), whole):
                break
            for i in range(len(texts)):
                spelt = (w.spell(np.array(ids[i], np.int64)).tobytes() for w, ids in ((words_a, in_a), (words_b, in_b)))
                if any(s != raw[i] for s in spelt):
                    self.ok[i], raw[i], in_a[i], in_b[i] = False, b"", [], []
        border = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
        last_a, last_b = (np.cumsum(w.size[ids]) - 1 for w, ids in ((words_a, ids_a), (words_b, ids_b)))
        ends_a, ends_b = Bits.at(last_a, len(whole)), Bits.at(last_b, len(whole))
        shared, either = Bits(ends_a.words & ends_b.words), Bits(ends_a.words | ends_b.words)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.diff(x.rank(border)) for x in (ends_a, ends_b, shared, either))

        stretch = either.places()
        link_a, link_b = ends_a.rank(stretch), ends_b.rank(stretch)
        self.pairs = ids_a[link_a] << 32 | ids_b[link_b]
        self.pair_row = np.repeat(np.arange(len(texts)), self.n_links)

        # Of each group the tokens of one kind, then those of the other, with what stands after each.
        cuts = shared.places() + 1
        upto_a, upto_b = ends_a.rank(cuts), np.concatenate([[0], ends_b.rank(cuts)])
        place_a = np.arange(len(ids_a)) + upto_b[shared.rank(last_a)]
        place_b = np.arange(len(ids_b)) + (upto_a[shared.rank(last_b)] if len(cuts) else 0)
        width = max(words_a.width, words_b.width)
        cells = np.zeros((len(ids_a) + len(ids_b), width + 1), np.uint8)
        cells[place_a, : words_a.width] = words_a.digits[ids_a]
        cells[place_b, : words_b.width] = words_b.digits[ids_b]
        cells[place_a, width] = np.where(shared.has(last_a), ord("|"), ord(","))
        cells[place_b, width] = np.where(shared.has(last_b), ord(";"), ord(","))
        used = cells != 0
        length = np.concatenate([[0], np.cumsum(used.sum(1))])
        self.groups, self.group_border = cells[used].tobytes(), length[ends_a.rank(border) + ends_b.rank(border)]


class Documents:
    """What a piece tells of its documents; added one run of texts at a time."""

    def __init__(self):
        self.numbers, self.digests, self.pairs = [], [], []

    def add(self, texts: list[str], models: tuple) -> None:
        """Texts that are tokenized together."""
        got = Aligned(texts, models)
        self.numbers.append(np.stack([got.n_a, got.n_b, got.n_groups, got.n_links], 1))
        for lo, hi in zip(got.group_border[:-1], got.group_border[1:], strict=True):
            self.digests.append(hashlib.sha256(got.groups[lo : hi - 1]).digest() if hi > lo else b"")
        border = np.concatenate([[0], np.cumsum(got.n_links)])
        self.pairs += [np.unique(got.pairs[lo:hi], return_counts=True) for lo, hi in zip(border[:-1], border[1:], strict=True)]

    def add_long(self, text: str, models: tuple) -> None:
        """One text in segments; both tokenizers cut where segments meet, so groups, numbers and links add up."""
        numbers, digest, pair, count, first = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64), True
        for part in segments(text, SEGMENT):
            got = Aligned([part], models)
            if not got.ok[0]:
                numbers[:], pair, count, first = 0, pair[:0], count[:0], True
                break
            numbers += [got.n_a[0], got.n_b[0], got.n_groups[0], got.n_links[0]]
            digest.update((b"" if first else b";") + got.groups[:-1])
            some, times = np.unique(got.pairs, return_counts=True)
            pair, back = np.unique(np.concatenate([pair, some]), return_inverse=True)
            count, first = np.bincount(back, np.concatenate([count, times]), len(pair)).astype(np.int64), False
        self.numbers.append(numbers[None])
        self.digests.append(b"" if first else digest.digest())
        self.pairs.append((pair, count))

    def row(self, ids: np.ndarray, name: bytes) -> pa.RecordBatch:
        keys, times = (np.concatenate([p[i] for p in self.pairs]) for i in (0, 1))
        pair, back = np.unique(keys, return_inverse=True)
        size = np.array([len(p[0]) for p in self.pairs], np.int64)
        step = np.diff(back, prepend=0)
        start = np.cumsum(size)[:-1]
        start = start[start < len(back)]
        step[start] = back[start]  # places among the piece's pairs, as steps inside a document
        known = np.array([d != b"" for d in self.digests])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int.from_bytes(name, "little", signed=True)]),
                *(
                    pa.array([v], pa.binary())
                    for v in (
                        ids.tobytes(), pc.squeeze(np.concatenate(self.numbers)), b"".join(d or bytes(32) for d in self.digests), known.tobytes(),
                        pc.planes(np.diff(pair, prepend=0).view(np.uint64), 8), pc.squeeze(np.bincount(back, minlength=len(pair)).astype(np.uint32)),
                        pc.squeeze(size), pc.planes(step.view(np.uint64), 4), pc.planes(times.view(np.uint64), 4),
                    )
                ),
            ],
            names=["piece", "ids", "numbers", "digests", "known", "pairs", "holders", "sizes", "steps", "times"],
        )


PIECE_SCHEMA = "piece bigint, ids binary, numbers binary, digests binary, known binary, pairs binary, holders binary, sizes binary, steps binary, times binary"


def tokenize(byte_level: bytes, pieces: bytes, limit: int):
    """Rows of (text, id) to one row for each piece of about ``limit`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = tokenizers(byte_level, pieces)
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column(0), limit):
                own = batch.column(1).slice(lo, hi - lo)
                ids = np.where(np.asarray(own.is_null()), pc.NO_ID, own.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
                name = hashlib.blake2b(ids.tobytes() + offsets.tobytes() + data.tobytes(), digest_size=8).digest()
                out, first = Documents(), 0
                text = lambda i, data=data, offsets=offsets: " " + bytes(data[offsets[i] : offsets[i + 1]]).decode() if offsets[i + 1] > offsets[i] else ""
                while first < hi - lo:
                    end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SEGMENT, "right")) - 1)
                    if offsets[first + 1] - offsets[first] > SEGMENT:
                        out.add_long(text(first), models)
                        end = first + 1
                    else:
                        out.add([text(i) for i in range(first, min(end, hi - lo))], models)
                    first = end
                yield out.row(ids, name)

    return run


def steps_of(batch: pa.RecordBatch | pa.Table, name: str, i: int, width: int) -> np.ndarray:
    return pc.from_planes(batch.column(name)[i].as_py(), width).view(np.int64)


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pair, n``: id pairs and documents that hold them, added up over the pieces of a task."""
    out = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["pair", "n"])
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        for i in range(batch.num_rows):
            pair = np.cumsum(steps_of(batch, "pairs", i, 8))
            n = np.frombuffer(pc.stretch(batch.column("holders")[i].as_py()), np.uint32)
            key, back = np.unique(np.concatenate([held[0], pair]), return_inverse=True)
            held = (key, np.bincount(back, np.concatenate([held[1], n]), len(key)).astype(np.int64))
            if len(key) > HELD:
                yield out(*held)
                held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    yield out(*held)


def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pair, piece, place`` of each piece's distinct pairs."""
    for batch in batches:
        for i in range(batch.num_rows):
            pair = np.cumsum(steps_of(batch, "pairs", i, 8))
            piece = np.full(len(pair), batch.column("piece")[i].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(piece), pa.array(np.arange(len(pair), dtype=np.int32))], names=["pair", "piece", "place"])


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def add_up(pieces: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one piece (or of equal ones) with the counts of their pairs."""
    place, n, best = (answers.column(c).to_numpy() for c in ("place", "n", "best"))
    count, top = np.zeros(int(place.max(initial=-1)) + 1, np.int64), np.zeros(int(place.max(initial=-1)) + 1, bool)
    count[place], top[place] = n, best
    out = []
    for i in range(pieces.num_rows):
        ids = np.frombuffer(pieces.column("ids")[i].as_py(), np.int64)
        numbers = np.frombuffer(pc.stretch(pieces.column("numbers")[i].as_py()), np.int64).reshape(-1, 4)
        known = np.frombuffer(pieces.column("known")[i].as_py(), bool)
        digests = pieces.column("digests")[i].as_py()
        border = np.concatenate([[0], np.cumsum(np.frombuffer(pc.stretch(pieces.column("sizes")[i].as_py()), np.int64))])
        step, times = steps_of(pieces, "steps", i, 4), steps_of(pieces, "times", i, 4)
        run = np.concatenate([[0], np.cumsum(step)])
        # Steps begin anew in each document.
        at = run[1:] - np.repeat(run[border[:-1]], np.diff(border))
        total = lambda v, border=border: np.diff(np.concatenate([[0], np.cumsum(v)])[border])
        hexa = [digests[32 * j : 32 * j + 32].hex() if k else "" for j, k in enumerate(known.tolist())]
        out.append(
            pa.table(
                [
                    pa.array(ids, mask=ids == pc.NO_ID), *(pa.array(numbers[:, j]) for j in range(4)),
                    pa.array(total(times * top[at])), pa.array(total(times * count[at])), pa.array(hexa, pa.string()),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )
        )
    return pa.concat_tables(out) if out else pa.table({c.split()[0]: pa.array([], pa.string() if "string" in c else pa.int64()) for c in RESULT.split(", ")})


def align_tokens(docs: DataFrame, byte_level: bytes, piece_model: bytes, text: str = "text", id_: str = "doc_id", piece: int = PIECE) -> DataFrame:
    """Alignment and counts of every document; the tokenizers are given as the bytes of their files."""
    rows = docs.select(F.encode(F.col(f"`{text}`").cast("string"), "UTF-8").alias("text"), F.col(f"`{id_}`").cast("long").alias("id"))
    pieces = stored(map_arrow(rows, tokenize(byte_level, piece_model, piece), PIECE_SCHEMA), "aligned")
    counts = stored(map_arrow(pieces.select("pairs", "holders"), count_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.shiftright("pair", 32)
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("top"))
    size = len(json.loads(byte_level)["model"]["vocab"])
    counts = counts.join(F.broadcast(highest) if size <= BROADCAST_IDS else highest, first == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    asked = map_arrow(pieces.select("piece", "pairs"), ask, "pair bigint, piece bigint, place int")
    answers = asked.join(counts, "pair").select("piece", "place", "n", "best")
    told = pieces.select("piece", "ids", "numbers", "digests", "known", "sizes", "steps", "times")
    return told.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(lambda p, a: add_up(p, a), RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = [Path(public_tokenizers.path(name)).read_bytes() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return finished(spark, "token-alignment", lambda: align_tokens(read_table(spark, sf_dir, "documents"), *files))
