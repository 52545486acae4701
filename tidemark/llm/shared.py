"""Shared-folder helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is created and kept in the session's
    settings if all runs on one machine (tests); on a cluster that is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


_made: ContextVar[list[tuple[str, str]] | None] = ContextVar("made", default=None)


def note(kind: str, name: str) -> None:
    """Puts a path or table on the list of the innermost :func:`workspace`."""
    if (made := _made.get()) is not None:
        made.append((kind, name))


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all intermediate tables that were written inside.

    What is needed later has to be written to a path made outside.
    """
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get() or []
        _made.reset(token)
        jvm = spark._jvm
        for kind, name in made:
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    note("path", path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation, and
    lets several consumers share one computation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written as Parquet and read back; all other tables that were written for it are deleted."""
    path = new_path(spark, name)
    with workspace(spark):
        out = make()
        out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that may be broadcast: 16 bytes each, 8 MB.
BROADCAST_IDS = 500_000


def without_ids(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose id isn't in ``ids``; few ids (counted) are broadcast, more are joined by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, name, "left_anti").select(*df.columns)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package's modules sent to the executors first."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
