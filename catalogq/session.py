"""Session, table and checkpoint helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Spark settings the engine wants on a cluster; the caller's own settings win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # what cut() wrote goes once nothing reads it any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # methods above 8000 bytes of bytecode are never compiled by the JVM; smaller ones are generated instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "catalogq", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS, overridden by ``conf``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and the whole session is this one process
    (tests) a temporary folder is made, which goes with the process; on any cluster, a local one too, this raises.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="catalogq-checkpoint-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
