"""Session factory, shared-folder checkpoints and table loading."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Query settings that every session of this library wants. Only adaptive execution is forced on:
#: partition counts and split sizes belong to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Checkpoints go when nothing refers to them any more; clusters set this themselves.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**DEFAULTS, "spark.driver.memory": "8g", **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables that driver and executors share.

    That is ``spark.checkpoint.dir`` of the session. Where it is unset, a local session gets a
    temporary folder and a cluster a folder in its warehouse.
    """
    context = spark.sparkContext
    set_to = context._jsc.sc().getCheckpointDir()
    if not set_to.isEmpty():
        return set_to.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="loomwright-")
        atexit.register(shutil.rmtree, folder, True)
    context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    The copy survives lost executors, and the partitions keep their numbers and contents.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
