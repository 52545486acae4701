"""Documents packed into pieces of about a megabyte, and hashes dealt out in packed arrays.

Some operators have to send a few bytes of every document to where equal bytes meet and
get an answer back. ``make_pieces`` writes the texts once, as a table bucketed by piece;
a later join on ``piece`` reads it where it is, so answers travel and texts don't.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .shared import map_arrow, new_path, note

PIECE = 1 << 20
#: Bytes of text in one bucket of a piece table, so that tasks stay the same size as the input grows.
BUCKET = 16 << 20
#: Spark allows no more buckets (spark.sql.sources.bucketing.maxBuckets).
MOST_BUCKETS = 100_000
#: Buckets of hashes: so many, and one more for each so many pieces, are enough for any number of tasks.
FEW_BUCKETS, SPREAD = 48, 32
NO_ID = np.int64(0x7FFFFFFFFFFFFFFF)


def blob(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def squeeze(data: bytes | np.ndarray) -> bytes:
    """Compressed, after the length: shuffles compress less well than this."""
    raw = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=5).compress(raw, asbytes=True) if raw else b"")


def stretch(data: bytes | None) -> bytes:
    n = int.from_bytes(data[:8], "little") if data else 0
    return pa.decompress(data[8:], n, "zstd", asbytes=True) if n and data else b""


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each 64-bit value, all first bytes, then all second ones and so on, compressed."""
    return squeeze(narrow(values, width).T)


def from_planes(data: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(stretch(data), np.uint8).reshape(width, -1)
    wide = np.zeros((flat.shape[1], 8), np.uint8)
    wide[:, :width] = flat.T
    return wide.reshape(-1).view("<u8")


def pack(limit: int):
    """Rows of (text, id, rest) to pieces. A piece is named by a hash of its ids and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.column(2)
            for lo, hi, data, offsets in tk.chunks(batch.column(0), limit):
                own = batch.column(1).slice(lo, hi - lo)
                ids = np.where(np.asarray(own.is_null()), NO_ID, own.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
                digests = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True))
                name = hashlib.blake2b(ids.tobytes() + digests, digest_size=8).digest()
                lists = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.concat_arrays([rest.slice(lo, hi - lo)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int.from_bytes(name, "little", signed=True)]), *(pa.array(x, pa.binary()) for x in (blob(ids), blob(offsets), [digests], [squeeze(data)])), lists,
                    ],
                    names=["piece", "ids", "offsets", "digests", "bytes", "rest"],
                )

    return run


def deal_pieces(docs: DataFrame, text: str, id_: str | None, keep: list[str], limit: int = PIECE, bucket: int = BUCKET) -> tuple[DataFrame, int, int]:
    """``piece, ids, offsets, digests, bytes, rest``, dealt out by piece; the number of parts, and the bytes of all texts.

    Texts have a 128-bit digest each; ``rest`` holds the columns ``keep``. A null id (and every
    id without ``id_``) is ``NO_ID``, a null text is empty. The number of parts follows the bytes
    of all texts, which are counted first.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("boolean")
    ids = F.lit(None) if id_ is None else F.col(f"`{id_}`")
    rows = docs.select(F.encode(F.col(f"`{text}`").cast("string"), "UTF-8").alias("text"), ids.cast("long").alias("id"), rest.alias("rest"))
    kind = rows.schema["rest"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")).cast("long"))).first()[0] or 0
    parts = min(MOST_BUCKETS, max(1, -(-total // bucket)))
    packed = map_arrow(rows, pack(limit), f"piece bigint, ids binary, offsets binary, digests binary, bytes binary, rest array<{kind}>")
    return packed.repartition(parts, "piece"), parts, total


def make_pieces(docs: DataFrame, text: str, id_: str | None, keep: list[str], limit: int = PIECE) -> DataFrame:
    """:func:`deal_pieces` as a written table, bucketed by piece, one file for each bucket.

    The table's attribute ``buckets`` is for :func:`by_piece`.
    """
    spark = docs.sparkSession
    dealt, buckets, _ = deal_pieces(docs, text, id_, keep, limit)
    name = f"pieces_{uuid.uuid4().hex[:12]}"
    # The texts in it are compressed already.
    dealt.write.bucketBy(buckets, "piece").option("path", new_path(spark, "pieces")).option("compression", "lz4").saveAsTable(name)
    note("table", name)
    table = spark.table(name)
    table.buckets = buckets
    return table


def by_piece(answers: DataFrame, pieces: DataFrame) -> DataFrame:
    """``answers`` dealt out as the table of pieces is, so that a join with it moves no texts."""
    return answers.repartition(pieces.buckets, "piece")


def bucket_count(pieces: DataFrame, each: int, at_least: int) -> int:
    """Buckets for the answers to all pieces: so many that at most about ``each`` pieces' hashes meet in one, whatever the input's size.

    Every piece sends a row to every bucket, so more of them than tasks need only make rows:
    ``at_least`` for each shuffle partition, but no more than some for each piece.
    """
    count, tasks = pieces.count(), at_least * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(min(tasks, FEW_BUCKETS + count // SPREAD), -(-count // each))


def unpack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and bytes of the piece in row ``i``."""
    get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py() or b"", kind)
    return get("ids", np.int64), get("offsets", np.int64), np.frombuffer(stretch(batch.column("bytes")[i].as_py()), np.uint8)


def narrow(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bytes of each 64-bit value, as rows of bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def widen(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return wide.reshape(-1).view("<u8")


def deal(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, the buckets that have entries, and the borders in that order."""
    order = np.argsort(bucket, kind="stable")
    border = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return order, np.flatnonzero(np.diff(border)), border


def lookup(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether and where each of ``wanted`` stands in a sorted array."""
    if len(sorted_) == 0:
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return sorted_[at] == wanted, at
