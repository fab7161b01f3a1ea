"""Raw layer: text-typed tables from delimited dumps, and their fingerprints."""

from __future__ import annotations

import csv
import re
from datetime import date
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerband.operators.distribution import join_same
from peerband.session import stage

#: Bytes of a file that are held at once while it is hashed.
CHUNK = 1 << 22
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


#: RFC 4180: a quote within a quoted field is written twice.
CSV_FORM = {"quote": '"', "escape": '"', "mode": "FAILFAST"}
#: Suffixes of files that only one task can read.
COMPRESSED = (".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate", ".xz")


def check_name(name: str) -> str:
    """Accept a plain identifier only."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a usable table name: {name!r}")
    return name


def check_snapshot_date(text: str) -> str:
    if not isinstance(text, str) or not _DATE.fullmatch(text):
        raise ValueError(f"not a YYYY-MM-DD snapshot date: {text!r}")
    date.fromisoformat(text)
    return text


def spread(df: DataFrame) -> DataFrame:
    """Deal what few tasks could read to all cores, so that the work after it is parallel."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def read_text_csv(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """RFC 4180 file(s) with a header, every column a string, extra columns kept.

    Rows of the wrong width and files whose header differs fail the read instead of being
    patched. Each file is parsed by one task, as its quoted fields may hold line ends: that is
    what a gzip file needs anyway. ``read_split_csv`` parses plain files in many tasks, and
    ``multi_line=False`` those whose fields hold no line ends.
    """
    return (
        spark.read.options(**CSV_FORM).option("header", True)
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .csv(path)
    )


def read_split_csv(spark: SparkSession, path) -> DataFrame:
    """As ``read_text_csv``, for files that are not compressed, in as many tasks as they have blocks.

    A line begins a record where the quotes before it in its file are even in number. They are
    counted per block; the parity before a block is that of all blocks before it, and within a block
    that of the lines before. A record of one line is parsed where it lies, and only the lines of
    the others are brought together.
    """
    place = ["file", "block"]
    raw = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.expr("length(value) - length(replace(value, '\"', ''))").alias("quotes"),
    )
    blocks = raw.groupBy(*place).agg(F.sum("quotes").alias("held"))
    blocks = stage(blocks, "blocks")
    open_files = blocks.groupBy("file").agg(F.sum("held").alias("n")).where("n % 2 = 1")
    broken = open_files.select("file").limit(1).collect()
    if broken:
        raise ValueError(f"a quoted field does not end in {broken[0]['file']}")
    over = "(partition by file order by block rows between unbounded preceding and 1 preceding)"
    parity = blocks.selectExpr(*place, f"coalesce(sum(held) over {over}, 0) as earlier")

    inside = "(partition by file, block order by line rows between unbounded preceding and"
    begun = join_same(raw, parity, place, ["earlier"], how="inner").selectExpr(
        "*",
        f"(earlier + coalesce(sum(quotes) over {inside} 1 preceding), 0)) % 2 = 0 as begins",
        "block = 0 and row_number() over (partition by file, block order by line) = 1 as first",
    )
    lines = stage(
        begun.selectExpr(
            "value", *place, "line", "begins", "first", "begins and quotes % 2 = 0 as alone",
            f"last(if(begins, line, null), true) over {inside} current row) as record",
        ),
        "lines",
    )
    # Lines that go on with a record of an earlier block: the last one that began before.
    ends = lines.groupBy(*place).agg(F.max("record").alias("ended")).selectExpr(
        *place, f"last(ended, true) over {over} as carried"
    )
    pieces = join_same(lines.where("not alone"), ends, place, ["carried"]).selectExpr(
        "coalesce(record, carried) as record", "line", "value", "first"
    )
    joined = pieces.groupBy("record").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(line, value))),"
               " x -> x.value), '\n')").alias("text"),
        F.bool_or("first").alias("first"),
    ).select("text", "first")
    records = lines.where("alone").select(F.col("value").alias("text"), "first").unionAll(joined)
    heads = [r["text"] for r in records.where("first").select("text").distinct().limit(3).collect()]
    if len({h.removesuffix("\r") for h in heads}) != 1:
        raise ValueError("the files have different headers" if heads else f"no header in {path}")
    # Where lines end by both characters, so do those within quotes, and they are read as one.
    paired = F.lit(all(h.endswith("\r") for h in heads)) | F.col("text").endswith("\r")
    text = F.regexp_replace("text", "\r$", "")
    records = records.select(
        F.when(paired, F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text).alias("text"),
        "first",
    )
    names = next(csv.reader([heads[0].removesuffix("\r").removeprefix("\ufeff")]))
    schema = ", ".join(f"{quoted_name(name)} string" for name in names)
    parsed = F.from_csv("text", schema, CSV_FORM).alias("row")
    return records.where("not first and trim(text) <> ''").select(parsed).select("row.*")


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def load_csv(spark: SparkSession, path, view: str, store: str | None = None) -> int:
    """Land a dump as the temporary view ``view`` and return its row count.

    With ``store`` the parsed text is kept there as Parquet and the view reads that, so the
    single-task decompression happens once.
    """
    check_name(view)
    files = list_files(spark, [path] if isinstance(path, str) else path)
    whole = any(uri.endswith(COMPRESSED) for uri, _ in files)
    raw = read_text_csv(spark, path) if whole else read_split_csv(spark, path)
    if store:
        spread(raw).write.mode("overwrite").parquet(store)
        raw = spark.read.parquet(store)
    raw.createOrReplaceTempView(view)
    return raw.count()


def raw_table(spark: SparkSession, view: str) -> DataFrame:
    return spark.table(check_name(view))


def list_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """(URI, size) of the files that paths, folders or globs name, empty ones included."""
    names = spark._jvm.org.apache.hadoop.fs
    out = []
    for path in paths:
        place = names.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        hits = system.globStatus(place)
        if not hits:
            raise FileNotFoundError(path)
        for hit in hits:
            below = system.listFiles(hit.getPath(), True)
            while below.hasNext():
                status = below.next()
                out.append((status.getPath().toString(), status.getLen()))
    return sorted(set(out))


#: Hadoop schemes and what Arrow calls the same store; Arrow opens all other schemes that it does
#: not know itself through Hadoop.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "file": "file", "gs": "gs",
                 "abfs": "abfs", "abfss": "abfss"}


def arrow_place(uri: str) -> tuple[str, bool]:
    """The URI that Arrow understands, and whether it must go through Hadoop.

    Names are quoted: Hadoop lists them as they are.
    """
    scheme, _, rest = uri.partition(":")
    rest = rest if rest.startswith("//") else f"//{rest}"
    native = ARROW_SCHEMES.get(scheme)
    return f"{native or scheme}:{quote(rest, safe='/:@')}", native is None


def fingerprints(spark: SparkSession, path, chunk: int = CHUNK) -> DataFrame:
    """sha256 and size of every file under ``path``.

    The driver lists files only; each is read by one task, ``chunk`` bytes at a time, so its size
    does not matter. Executors open files through Arrow, on every store that Spark reads.
    """
    found = list_files(spark, [path] if isinstance(path, str) else path)
    rows = [(uri.rsplit("/", 1)[-1], *arrow_place(uri), size) for uri, size in found]
    files = spark.createDataFrame(rows, "file string, uri string, hadoop boolean, bytes long")

    # Self-contained, so that executors need no copy of this package.
    def digest(batches):
        import hashlib
        from urllib.parse import unquote, urlsplit

        import pyarrow as pa
        from pyarrow.fs import FileSystem, HadoopFileSystem

        for batch in batches:
            prints = []
            for uri, hadoop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if hadoop:
                    system = HadoopFileSystem.from_uri(uri)
                    place = unquote(urlsplit(uri).path)
                else:
                    system, place = FileSystem.from_uri(uri)
                state = hashlib.sha256()
                with system.open_input_stream(place, compression=None) as stream:
                    while part := stream.read(chunk):
                        state.update(part)
                prints.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.string()), batch.column(3)],
                names=["file", "sha256", "bytes"],
            )

    return files.repartition("uri").mapInArrow(
        digest, "file string, sha256 string, bytes bigint"
    )
