"""Session set-up and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _folder(spark: SparkSession) -> str:
    """The folder that the cluster names for cut lineage.

    ``spark.checkpoint.dir`` is read from the session. Only where nothing names a folder (local
    tests) one is made; a machine-local folder is refused on a cluster.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tierline-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint (see _folder)."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a Parquet table in the same folder: smaller than a checkpoint, and later reads take only the columns they need."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whether Spark removes the shuffle files of an action when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A function that cuts lineage as ``written`` does, but into tables that are removed at the end of the block; rows kept under a name come on top of those before them.

    What is to outlive the block has to be cut or written inside it. Shuffle files of actions inside it are removed when the
    action ends; an action repeated on the same DataFrame would make them again.
    """
    folder, old = f"{_folder(spark)}/scratch-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, None)

    def keep(df: DataFrame, name: str | None = None) -> DataFrame:
        path = f"{folder}/{name or uuid.uuid4().hex}"
        df.write.mode("append").option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    spark.conf.set(_CLEANUP, "true")
    try:
        yield keep
    finally:
        spark.conf.unset(_CLEANUP) if old is None else spark.conf.set(_CLEANUP, old)
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
