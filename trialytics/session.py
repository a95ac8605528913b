"""Session settings, worker set-up, the shared folder and lineage cuts, for the whole library."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Rows of an Arrow batch at most: with texts of a few kB a batch stays in the tens of MB.
BATCH_ROWS = 1000

#: Settings that change results or plans; everything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build(app: str = "trialytics", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; conf overrides them, with '_' for '.' in the keys."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the same path as the driver, and keep their Arrow batches small."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if ROOT not in sys.path:
        sys.path.insert(0, ROOT)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local master; on a cluster an error."""
    prepare(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trialytics-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


#: The folders made inside a call of written(); None outside.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver ends, or with what it was made for (written, free)."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder is temporary then
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(*frames: DataFrame | None) -> None:
    """Delete what cut() wrote for these frames. Nothing that is still to be read may come from them; other frames are left alone."""
    for frame in frames:
        if path := getattr(frame, "_cut_path", None):
            _remove(frame.sparkSession, path)


def written(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """cut(make(), name), after which the folders that making it took are deleted."""
    mine: list[str] = []
    token = _made.set(mine)
    try:
        out = cut(make(), name)
    finally:
        _made.reset(token)
    for path in mine:
        if path != out._cut_path:
            _remove(spark, path)
    if (outer := _made.get()) is not None:
        outer.append(out._cut_path)
    return out
