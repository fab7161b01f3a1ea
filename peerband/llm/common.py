"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerband.functions.buckets import quoted


_SHIPPED: set[str] = set()
#: Rows of an Arrow batch, where the session has Spark's default. Texts are long, and a Python
#: worker holds a batch several times over.
BATCH_ROWS, BATCH_CONF = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each application, and bound batches.

    Spark serves the archive itself, so executors need neither this file nor an installed copy.
    """
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


_RESIDENT: dict[tuple, object] = {}


def resident(kind: str, key: str, make: Callable[[], object]):
    """What a Python worker keeps from task to task: one vocabulary or model with its caches.

    Workers are used again by other operators, so asking for another one drops it.
    """
    if (kind, key) not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[kind, key] = make()
    return _RESIDENT[kind, key]


#: Largest table that is broadcast to rows with texts, after its size was counted.
BROADCAST_BYTES = 16 << 20


def decide(docs: DataFrame, found: DataFrame, on: Column, how: str, n_bytes: int) -> DataFrame:
    """Join rows that carry texts with a stored table of ``n_bytes``.

    A small table is broadcast, so texts stay where they are. With a larger one texts are shuffled
    once, but never sorted: the table is the hashed side.
    """
    side = F.broadcast(found) if n_bytes <= BROADCAST_BYTES else found.hint("shuffle_hash")
    return docs.join(side, on, how)


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under private names, so that other columns can never clash."""
    return df.select(*[quoted(source).alias(name) for name, source in columns.items()])


def private(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        free = f"__{name}"
        while free.lower() in taken:
            free = f"_{free}"
        taken.add(free.lower())
        out.append(free)
    return out


def text_or_empty(name: str):
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def slabs(texts: list[str | None], chars: int) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``chars`` characters together, at least one at a time."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def append_columns(
    df: DataFrame, text_col: str, fn: Callable[[list], dict[str, pa.Array]], extra: str
) -> DataFrame:
    """Every column of ``df`` unchanged, followed by columns computed from the text of a batch.

    ``fn`` gets the texts (None where null) and returns one array for each column of ``extra``, a
    DDL list. An input column of the same name, in whatever case, is replaced.
    """
    prepare(df.sparkSession)
    added = T.StructType.fromDDL(extra)
    names = {c.lower() for c in added.fieldNames()}
    kept = df.select(*[quoted(c) for c in df.columns if c.lower() not in names or c == text_col])
    at = kept.columns.index(text_col)
    schema = T.StructType(kept.schema.fields + added.fields)
    # Spark looks up the input of a map by unquoted names.
    plain = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = fn(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[new[f] for f in added.fieldNames()]],
                names=schema.fieldNames(),
            )

    return plain.mapInArrow(run, schema)
