"""Curated tables and the run manifest.

An output folder holds one folder a build and a small file that names the current one. A build is
published by renaming a new such file over it, so a reader sees one whole build or another.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("listings", "calendar_seasonality", "calendar_seasonality_detrended", "occupancy")
#: The file that names the current build, and how many builds stay: readers of the one before
#: may still be at work.
POINTER, KEPT_BUILDS = "CURRENT", 2


class OutputFolder:
    """The file system calls that builds and readers need, on whatever Hadoop opens."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self.files = self.place().getFileSystem(self._conf)

    def place(self, name: str = ""):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.files.exists(self.place(name))

    def delete(self, name: str = "") -> None:
        self.files.delete(self.place(name), True)

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.files.listStatus(self.place())]

    def read(self, name: str) -> str:
        stream = self.files.open(self.place(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.files.create(self.place(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def replace(self, name: str, by: str) -> None:
        """Rename ``by`` over ``name`` in one step, as the store's own rename does."""
        context = self._hadoop.FileContext.getFileContext(self.place().toUri(), self._conf)
        rename = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        source, target = (self.files.makeQualified(self.place(n)) for n in (by, name))
        context.rename(source, target, options)


def current_build(spark: SparkSession, out_dir: str) -> str:
    """The folder of the published build."""
    folder = OutputFolder(spark, out_dir)
    if not folder.exists(POINTER):
        raise FileNotFoundError(f"no build is published in {out_dir}")
    return f"{folder.path}/{folder.read(POINTER).strip()}"


def read_curated(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The tables of the published build, all of the same one."""
    build = current_build(spark, out_dir)
    return {name: spark.read.parquet(f"{build}/{name}.parquet") for name in TABLES}


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.json(f"{current_build(spark, out_dir)}/manifest.json")


def manifest(tables: dict[str, DataFrame], rows: dict[str, int], snapshot_date: str, source: str,
             files: DataFrame) -> DataFrame:
    """One row describing a build: row counts, optional columns, raw file fingerprints.

    ``rows`` was counted while the tables were written; ``files`` holds one row per raw file.
    """
    spark = files.sparkSession
    listed = files.agg(
        F.map_from_entries(
            F.sort_array(
                F.collect_list(F.struct("file", F.struct("sha256", "bytes").alias("print")))
            )
        ).alias("v")
    ).scalar()

    return spark.range(1).select(
        F.lit(snapshot_date).alias("snapshot_date"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(
            "generated_at"
        ),
        F.lit(source).alias("source"),
        F.lit(rows["listings"]).cast("long").alias("n_listings"),
        F.lit(rows["calendar_seasonality"]).cast("long").alias("n_seasonality_rows"),
        F.lit(rows["calendar_seasonality_detrended"]).cast("long").alias("n_seasonality_detrended_rows"),
        F.lit("estimated_occupancy_l365d" in tables["listings"].columns).alias(
            "has_estimated_occupancy"
        ),
        listed.alias("raw_files"),
    )


class Build:
    """A build's own folder, which the pointer names once all is there."""

    def __init__(self, spark: SparkSession, out_dir: str, stamp: str) -> None:
        self.spark, self.out = spark, OutputFolder(spark, out_dir)
        # Names sort by snapshot and time, so the oldest builds are the first.
        self.name = f"build-{stamp}-{uuid.uuid4().hex}"
        self._new = not self.out.exists()
        self.published = False

    def path(self, name: str) -> str:
        return f"{self.out.path}/{self.name}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(f"{name}.parquet"))
        return self.spark.read.parquet(self.path(f"{name}.parquet"))

    def write_manifest(self, row: DataFrame) -> None:
        row.coalesce(1).write.json(self.path("manifest.json"))

    def publish(self) -> None:
        """Point to this build, then remove all but the newest few others."""
        before = self.out.read(POINTER).strip() if self.out.exists(POINTER) else None
        pending = f"_{POINTER}-{self.name}"
        self.out.write(pending, self.name)
        self.out.replace(POINTER, pending)
        self.published = True
        keep = {self.name, before}
        others = sorted(n for n in self.out.names() if n.startswith("build-") and n not in keep)
        for name in others[:len(others) + len(keep - {None}) - KEPT_BUILDS]:
            self.out.delete(name)

    def clear(self) -> None:
        """Remove a build that was not published, and an output folder that holds nothing else."""
        if self.published:
            return
        for name in (self.name, f"_{POINTER}-{self.name}"):
            self.out.delete(name)
        if self._new and self.out.exists() and not self.out.names():
            self.out.delete()
