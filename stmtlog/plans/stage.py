"""Stage tables: results written once to the cluster's shared folder and read back.

A written table outlives lost executors, cuts the lineage, is pruned by column when read, and
has a size the planner knows, so a side is broadcast only when it is small.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset in local mode.

    On a cluster a setting that names its file system (``hdfs://``, ``s3a://``, or ``file://`` for a mount that all
    machines share) is taken as it is.  For a bare path Spark makes its checkpoint folder on the default file system, and
    that one is taken.  Where that is ``file:`` it may be a mount or each machine's own disk, so executors write to it once:
    it is taken if the driver sees all their files.  If it does not, or nothing is set, Spark's warehouse is tried so, and
    refused too if it isn't shared.  The executors of ``local-cluster`` are processes of this machine.
    """
    context = spark.sparkContext
    local = context.master == "local" or context.master.startswith("local[")
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if local and folder is None:
        folder = tempfile.mkdtemp(prefix="stmtlog-")
        context.setCheckpointDir(folder)
    if local or folder and _names_file_system(folder):
        return folder
    made = context.getCheckpointDir()
    if made and _names_file_system(made) and (not made.startswith("file:") or context.master.startswith("local-cluster[")):
        return made
    try:
        return _found_shared(spark, made or folder)
    except Exception as error:  # whatever it is, tables can't be kept there
        raise RuntimeError(
            f"spark.checkpoint.dir is {folder}; set it to a folder all executors share, with its file system"
        ) from error


def _names_file_system(folder: str) -> bool:
    return "://" in folder or folder.startswith("file:/")


@dataclass(frozen=True)
class StageFolder:
    """A folder below the shared one for the stage tables of one piece of work."""

    spark: SparkSession
    path: str

    def close(self) -> None:
        """Remove this folder with its tables, which must not be read any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Folders found to be shared, by application, the hosts of its executors, and the folder tried first.
_shared: dict[tuple[str, frozenset[str], str | None], str] = {}


def _found_shared(spark: SparkSession, folder: str | None) -> str:
    """The first of ``folder`` and a folder in Spark's warehouse to which executors write for all; tried again on new hosts."""
    context = spark.sparkContext
    hosts = [x.host() for x in context._jsc.sc().statusTracker().getExecutorInfos()]
    key = context.applicationId, frozenset(hosts), folder
    if key not in _shared:
        last = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stmtlog-stages"
        tasks = 4 * max(len(hosts), context.defaultParallelism)
        try:
            _shared[key] = _tried(spark, folder or last, tasks)
        except Exception:
            if folder is None:
                raise
            _shared[key] = _tried(spark, last, tasks)
    return _shared[key]


def _tried(spark: SparkSession, folder: str, tasks: int) -> str:
    """``folder``, if a file from each of ``tasks`` tasks is there for the driver and the executors; an error if not."""
    trial = StageFolder(spark, f"{folder.rstrip('/')}/stmtlog/trial-{uuid.uuid4().hex}")
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(trial.path)
        seen = spark.read.schema("id long").parquet(trial.path).count()
    finally:
        trial.close()
    if seen != tasks:
        raise FileNotFoundError(f"{tasks - seen} of {tasks} files that executors wrote to {folder} are not there")
    return folder


_current: ContextVar[StageFolder | None] = ContextVar("stage_folder", default=None)


def new_folder(spark: SparkSession, name: str) -> StageFolder:
    return StageFolder(spark, f"{shared_folder(spark).rstrip('/')}/stmtlog/{name}-{uuid.uuid4().hex}")


@contextmanager
def staging_in(folder: StageFolder) -> Iterator[StageFolder]:
    """Within, stage tables go to ``folder``."""
    token = _current.set(folder)
    try:
        yield folder
    finally:
        _current.reset(token)


def stage(data: DataFrame, name: str) -> DataFrame:
    """Write ``data`` as a stage table and return a DataFrame that reads it."""
    spark, folder = data.sparkSession, _current.get()
    within = folder.path if folder else f"{shared_folder(spark).rstrip('/')}/stmtlog"
    path = f"{within}/{name}-{uuid.uuid4().hex}"
    data.write.parquet(path)
    return spark.read.schema(data.schema).parquet(path)


def stage_numbered(data: DataFrame, name: str, number: str) -> DataFrame:
    """stage() with a number of each row in the column ``number``.

    The number is stored, so all reads of the table agree on it.  monotonically_increasing_id() over two scans of the
    same files need not: how a scan is cut depends on the cores registered at that moment.
    """
    return stage(data.withColumn(number, F.monotonically_increasing_id()), name)
