"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowtide")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the operators that run Python there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="flowtide-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or the context's checkpoint folder. A local session without either (tests) gets a new one; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            root = set_before.get()
        elif spark.sparkContext.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="flowtide-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below shared_root()."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def folder(spark: SparkSession, path: str):
    """(path, file system) of a folder, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """The shared folders that this thread makes inside are removed at the end, but for those taken from the list: intermediate tables of a step whose result is written."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            p, fs = folder(spark, path)
            fs.delete(p, True)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder, for results that several branches of a plan read. Unlike a cache it survives lost executors, and readers still prune its columns."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
