"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

# Settings that can change at run time; the operators rely on the first one.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators expect to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str, cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session, for tests and for the benchmark; its folder goes with it."""
    folder = _own_folder(app)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folders: dict[str, str] = {}


def _own_folder(app: str) -> str:
    """A temporary folder of this process, removed when it ends."""
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="cohortweave-")
        atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
    return _own_folders[app]


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session whose driver and executors are one process may go without the
    setting; it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(context.applicationId)


def materialize(df: DataFrame, partition_by: Sequence[str] = (), **options: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For tables that a plan would otherwise compute several times. The copy outlives
    lost executors, and later steps read only the columns they need, and of those that it is stored
    by (``partition_by``: numbers) only the files they ask for. ``options`` are those of the Parquet writer.
    """
    path = f"{shared_dir(df.sparkSession)}/intermediate/{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def lenient(build: Callable) -> Callable:
    """For functions that build plans from the expressions of a request.

    Such expressions meet malformed data: what cannot be cast, parsed or found in an array
    is null there, not the end of the job. How an expression treats errors is fixed when its
    plan is built, so the setting is changed only meanwhile.
    """

    @wraps(build)
    def run(*args, **kwargs):
        conf = SparkSession.active().conf
        before = conf.get("spark.sql.ansi.enabled")
        conf.set("spark.sql.ansi.enabled", "false")
        try:
            return build(*args, **kwargs)
        finally:
            conf.set("spark.sql.ansi.enabled", before)

    return run
