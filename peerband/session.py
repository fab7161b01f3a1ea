"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "peerband", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on. Cluster settings win unless named in ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Call-site capture costs several driver round trips per column expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a private one only in local mode.

    Intermediate tables must outlive the executor that wrote them, so on a cluster an
    unset ``spark.checkpoint.dir`` is an error rather than a machine-local default.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="peerband-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back.

    Used where a result is read several times: later reads prune columns, nothing is
    recomputed, and a lost executor costs no more than re-reading files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/peerband/{uuid.uuid4().hex}/{name}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)
