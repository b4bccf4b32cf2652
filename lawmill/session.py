"""Session helpers: a session for tests, table access, and tables staged in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lawmill")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only a local master may do without: it gets a
    folder of its own. On a cluster a folder of one machine would not do, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lawmill-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _stage_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lawmill-{spark.sparkContext.applicationId}"


_clearing: set[str] = set()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives the loss of executors,
    and is computed once however often it is used. The table stays until clear_staged, which runs at the latest when the
    driver's Python ends: a result that is not yet written may need it."""
    spark = df.sparkSession
    if spark.sparkContext.applicationId not in _clearing:
        _clearing.add(spark.sparkContext.applicationId)
        atexit.register(clear_staged, spark)
    path = f"{_stage_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Drop the tables this application staged; results that were not written elsewhere become unreadable."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stage_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, factor: int = 3) -> DataFrame:
    """Give a scan that arrives in few splits enough partitions to keep all cores busy with per-row work. A plan with an
    exchange is left alone: it has Spark's partitions, and counting them would run it."""
    spark = df.sparkSession
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores * factor) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lawmill-")) / "lawmill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
