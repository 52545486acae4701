"""Makes this package importable on executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application.

    Spark's own file server hands them out, so no folder has to be shared.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


@contextmanager
def by_value() -> Iterator[None]:
    """Functions and classes of this package that are sent inside carry their code with them.

    Workers of stateful streams are also started before files of the application reach them.
    """
    import tidemark

    cloudpickle.register_pickle_by_value(tidemark)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(tidemark)
