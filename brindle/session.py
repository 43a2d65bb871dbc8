"""Session defaults and the small helpers every operator shares."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only by tests and bench.py; on a cluster the session that is handed in keeps its own settings.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.host": "127.0.0.1",
}


def local_session(cpus: int = 8, memory: str = "8g", shuffle_partitions: int = 8, name: str = "brindle") -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    b = b.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the session's Python workers this package, once; they need not have it installed or in their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="brindle-package-")  # on the driver, which serves the file
    home = Path(__file__).resolve().parent
    with zipfile.ZipFile(f"{folder}/brindle.zip", "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(f"{folder}/brindle.zip")
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of the cluster's spark.checkpoint.dir. Only a session in one process (tests, local runs) that has none
    gets a folder of this machine; on a cluster a missing setting is an error, since a machine's own folder would be
    lost with it or not be seen by the others."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="brindle-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder, so that the lineage ends there and a lost executor
    costs a read and not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like cut, but as a columnar table in the same shared folder, for tables that are read again by few columns."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it comes in fewer: a small table in one file would go through
    Python in one task. Tables of many files, as on a cluster, are left as they are and not shuffled."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def slots(spark: SparkSession) -> int:
    """Tasks worth having in a stage of Python work: several a core, never fewer than the session's own setting."""
    return max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))
