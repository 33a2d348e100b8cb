"""Session helpers: a configured local session for tests and benches, and the
checkpoint folder rule (read it from the session, set one only when unset on a
local master)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_CHECKPOINT_ROOT = "/tmp"


def build_session(master: str | None = None, app: str = "segscope",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session tuned for this library. On a cluster, call with master=None
    and let spark-submit decide; the defaults only matter on a laptop."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        b = b.master(master or f"local[{cpus}]")
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.ansi.enabled": "true",
    }
    if master and "SPARK_DRIVER_MEMORY" not in os.environ:  # one JVM does all the work; on a cluster the launcher decides
        conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only a
    local master (tests, laptop) may get a fresh folder made here; on a cluster
    an unset folder is an error, because a machine-local folder does not
    survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="segscope-ckpt-", dir=_LOCAL_CHECKPOINT_ROOT)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one job in the shared checkpoint folder; the job deletes them when its result is there."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/segscope-{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df, by: tuple[str, ...] = ()):
        """Write, and read again: cuts the lineage, and each row is worked out once. Columns ``by`` have few values, and a
        filter on them reads only the files it needs."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
