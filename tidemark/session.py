"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session.

    Spark's own file server carries it, so workers find it whatever folder they start in.
    """
    if getattr(ship, "sent_to", None) == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    ship.sent_to = spark.sparkContext.applicationId


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session (a test or a laptop) may leave it
    unset and gets a temporary folder; elsewhere executors would write to folders of their own, so that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all nodes of {master} share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: What holds while a table is staged: shuffle files go with the job that wrote them, since nothing reads them again.
_STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: And where its steps run inside a key: rows that lie by some of a join's keys are not dealt out anew.
_INSIDE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
_LOCK, _HELD = threading.Lock(), {}


@contextmanager
def _holding(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Sets what holds while staging; the last one out of several threads puts back what was set before."""
    with _LOCK:
        for key, value in settings.items():
            count, before = _HELD.get((spark, key), (0, None))
            if not count:
                before = spark.conf.get(key, None)
                spark.conf.set(key, value)
            _HELD[spark, key] = count + 1, before
    try:
        yield
    finally:
        with _LOCK:
            for key in settings:
                count, before = _HELD.pop((spark, key))
                if count > 1:
                    _HELD[spark, key] = count - 1, before
                elif before is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, before)


def stage(frame: DataFrame, label: str, by: str | None = None, inside: bool = False) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where a result feeds several branches and is too dear to compute for each, and to cut the
    lineage of iterations. The copy survives lost executors, and it is columnar, so every branch
    reads only its own columns. With ``by`` it lies in buckets of that column; a frame made of it whose steps all
    run ``inside`` a value of that column then shuffles none of its rows.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}/{label}"
    with _holding(spark, _STAGING | (_INSIDE if inside else {})):
        if by is None:
            frame.write.parquet(path)
            return spark.read.schema(frame.schema).parquet(path)
        name = f"tidemark_{label}_{uuid.uuid4().hex}"
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        frame.write.bucketBy(parts, by).option("path", path).saveAsTable(name)
        return spark.table(name)
