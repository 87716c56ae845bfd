"""Session construction and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "rillwork", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the deployment's own session is used."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by spark.checkpoint.dir.

    Where the session names none, a temporary folder is used, but only in local mode: a machine-local folder on a cluster
    would lose its files with the machine.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="rillwork-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", "file://" + own)
    return "file://" + own


_made: list[str] = []


def work_path(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark)}/rillwork-{what}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the work folders this process has made; call it when the results that read them are used. The number of folders."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    gone = len(_made)
    _made.clear()
    return gone


def through_table(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage of df with a written table in the shared folder."""
    spark = df.sparkSession
    path = work_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
