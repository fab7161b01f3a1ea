"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Every distinct direction is projected on many random lines. Tables of a few lines each bring
vectors together that lie near one another on all of a table's lines. Among those, each vector is
the centre of a window on every counting line, and a pair collides on a line where one lies in the
other's window; only pairs with enough collisions are compared exactly. Tables, windows and the
count are calibrated for the recall of a pair just at the limit.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerband.llm.common import narrow, prepare
from peerband.llm.components import components
from peerband.session import stage

COSINE = 0.95
SEED = 20
#: Lines on which collisions are counted.
LINES = 32
#: Half a window in units of a limiting pair's distance.
REACH = 2.0
#: Width of a table's cells on a line; lines are scaled so that a unit vector spreads by 1.
CELL = 2.0
#: Unrelated vectors that a cell holds at most, on average: more vectors get more lines a table.
OCCUPANCY = 16
#: Chance that a pair at the limit meets in a table, and that it then has enough collisions.
MEETING, COUNTED = 0.99, 0.999
#: Vectors of a block; cells with more are dealt to pairs of blocks.
BLOCK = 1024
QUERIES = 256


def _normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def same_cell(distance: float, width: float = CELL) -> float:
    """Chance that two points at a distance share a cell of a randomly placed grid on a line."""
    r = width / distance
    return 1 - 2 * _normal(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Layout:
    """How many tables of how many lines, and how many collisions a pair needs."""

    tables: int
    lines: int
    window: float
    collisions: int
    cosine: float

    @classmethod
    def calibrated(cls, vectors: int, cosine: float = COSINE) -> Layout:
        near = math.sqrt(max(2 - 2 * cosine, 1e-12))
        apart = -math.log(same_cell(math.sqrt(2)))
        lines = max(1, math.ceil(math.log(max(vectors / OCCUPANCY, 1)) / apart))
        meet = same_cell(near) ** lines
        tables = max(1, math.ceil(math.log(1 - MEETING) / math.log(1 - meet)))
        p = 2 * _normal(REACH) - 1
        need = LINES
        while need and sum(math.comb(LINES, i) * p**i * (1 - p) ** (LINES - i)
                           for i in range(need, LINES + 1)) < COUNTED:
            need -= 1
        return cls(tables, lines, REACH * near, need, cosine)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """One number for each vector's cell in every table (vectors x tables)."""
        rng = np.random.default_rng([SEED, vectors.shape[1]])
        count = self.tables * self.lines
        lines = rng.normal(size=(count, vectors.shape[1])).T
        place = vectors @ lines + rng.uniform(0, CELL, count)
        cell = np.floor(place / CELL).astype(np.int64).reshape(len(vectors), self.tables, -1)
        mix = rng.integers(1 << 62, size=self.lines) * 2 + 1
        return (cell * mix).sum(axis=2) + vectors.shape[1]

    def projections(self, vectors: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng([SEED + 1, vectors.shape[1]])
        return vectors @ rng.normal(size=(LINES, vectors.shape[1])).T


def unit(values: list | None) -> np.ndarray | None:
    """A unit vector; None for null, zero, or where a component is null or not finite."""
    if not values or any(v is None for v in values):
        return None
    v = np.array(values, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top  # keeps squares of very large or small components finite
    return v / np.sqrt(v @ v) + 0.0


def _directions(rows: DataFrame) -> DataFrame:
    """(id, key, direction): key tells directions apart and is null for vectors that can't link."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if (v := unit(x)) is None else v.tobytes()
                   for x in batch.column(1).to_pylist()]
            key = [r and hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(key, pa.binary()), pa.array(raw, pa.binary())],
                names=["id", "key", "direction"],
            )

    return rows.mapInArrow(run, f"id {id_type}, key binary, direction binary")


def block_links(
    vectors: np.ndarray, cells: np.ndarray, table: int, chunk: np.ndarray, layout: Layout
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked index pairs i, j of one block, and whether ``table`` is the first to find each.

    Rows of different chunks are compared when there are two, all rows when there is one. Rows are
    sorted on the first line; a query's window there bounds the rows whose collisions are counted.
    """
    lines = layout.projections(vectors)
    order = np.argsort(lines[:, 0], kind="stable")
    line0 = lines[order, 0]
    lines32 = lines[order].astype(np.float32)
    upto = np.searchsorted(line0, line0 + layout.window, side="right")
    two = chunk.min() != chunk.max()
    left, right = [], []
    for at in range(0, len(order), QUERIES):
        stop = min(at + QUERIES, len(order))
        end = int(upto[at:stop].max())
        count = np.zeros((stop - at, end - at), np.uint8)
        for k in range(LINES):
            count += np.abs(lines32[at:stop, k, None] - lines32[None, at:end, k]) <= layout.window
        hit = count >= layout.collisions
        hit &= np.arange(end - at) > np.arange(stop - at)[:, None]
        if hit.any():
            cosine = vectors[order[at:stop]] @ vectors[order[at:end]].T
            i, j = np.nonzero(hit & (cosine >= layout.cosine))
            left.append(order[at + i])
            right.append(order[at + j])
    i = np.concatenate(left) if left else np.empty(0, np.int64)
    j = np.concatenate(right) if right else np.empty(0, np.int64)
    if two:
        cross = chunk[i] != chunk[j]
        i, j = i[cross], j[cross]
    first = ~(cells[i, :table] == cells[j, :table]).any(axis=1)
    return i, j, first


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component within a block."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block_rows(group: pa.Table, layout: Layout) -> pa.RecordBatch:
    """(a, b, n) for each vector of a block that has links: its root there, and links it gained."""
    keys = group.column("key").to_pylist()
    raw = group.column("direction").to_pylist()
    weight = group.column("copies").to_numpy()
    chunk = group.column("chunk").to_numpy()
    table = group.column("table")[0].as_py()
    a, b, n = [], [], []
    by_width: dict[int, list[int]] = {}
    for at, r in enumerate(raw):
        by_width.setdefault(len(r), []).append(at)
    cells = group.column("cells").to_pylist()
    for at in by_width.values():
        if len(at) < 2:
            continue
        at = np.array(at)
        vectors = np.frombuffer(b"".join(raw[x] for x in at)).reshape(len(at), -1)
        own = np.frombuffer(b"".join(cells[x] for x in at), np.int64).reshape(len(at), -1)
        i, j, first = block_links(vectors, own, table, chunk[at], layout)
        if not len(i):
            continue
        label = _labels(len(at), i, j)
        mass = weight[at]
        gained = (np.bincount(i[first], weights=mass[j[first]], minlength=len(at))
                  + np.bincount(j[first], weights=mass[i[first]], minlength=len(at)))
        for x in np.unique(np.concatenate([i, j])):
            a.append(keys[at[x]])
            b.append(keys[at[label[x]]])
            n.append(int(gained[x]))
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())],
        names=["a", "b", "n"],
    )


BLOCK_KEYS = ("table", "cell", "low", "high")


def _found(members: DataFrame, layout: Layout) -> DataFrame:
    """Links of all blocks; rows of a block come together in key order and are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            marks = np.stack([rows.column(k).to_numpy() for k in BLOCK_KEYS])
            cut = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cut.tolist()]
            for start, stop in zip(bounds, bounds[1:]):
                if stop - start > 1:
                    yield _block_rows(rows.slice(start, stop - start), layout)
            rest = rows.slice(bounds[-1])
        if rest is not None and rest.num_rows > 1:
            yield _block_rows(rest, layout)

    return members.mapInArrow(run, "a binary, b binary, n bigint")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    cosine: float = COSINE, block: int = BLOCK,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link where their cosine is at least ``cosine``, in double precision. ``n_links`` counts
    the other rows linked directly, ``component_id`` is the smallest id reachable through links,
    the own one included, and ``kept`` tells whether that is the row's own. A vector that is null,
    empty or zero or has a null or non-finite component links with nothing, nor do vectors of
    different lengths. Rows of one direction are one vector with a weight, so any number of copies
    costs no more than one. Ids may repeat or be null; other columns are ignored.
    """
    prepare(vectors.sparkSession)
    rows = stage(_directions(narrow(vectors, id=id_col, vector=vector_col)), "directions")
    distinct = stage(
        rows.where("key is not null").groupBy("key").agg(
            F.first("direction").alias("direction"), F.min("id").alias("lowest"),
            F.count(F.lit(1)).alias("copies"),
        ),
        "distinct",
    )
    layout = Layout.calibrated(distinct.count(), cosine)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            out: list[bytes] = [b""] * len(raw)
            for width in {len(r) for r in raw}:
                at = [i for i, r in enumerate(raw) if len(r) == width]
                own = layout.cells(np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1))
                for i, row in zip(at, own):
                    out[i] = row.tobytes()
            number = np.frombuffer(b"".join(out), np.int64).reshape(len(raw), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary()), pa.array(number.tolist(),
                                                                     pa.list_(pa.int64()))],
                names=["key", "cells", "numbers"],
            )

    celled = stage(
        distinct.select("key", "direction").mapInArrow(
            cells, "key binary, cells binary, numbers array<bigint>"
        ),
        "cells",
    )
    places = celled.select("key", F.posexplode("numbers").alias("table", "cell"))
    sizes = places.groupBy("table", "cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    chunks = F.ceil(F.col("size") / block).cast("int")
    shared = places.join(sizes, ["table", "cell"]).select(
        "key", "table", "cell", chunks.alias("chunks"),
        F.pmod(F.xxhash64("key", "table"), chunks).cast("int").alias("chunk"),
    )
    payload = celled.select("key", "cells").join(
        distinct.select("key", "direction", "copies"), "key"
    )
    # A cell of several chunks is compared chunk against chunk.
    members = shared.join(payload, "key").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    ).select(
        "table", "cell", F.least("chunk", "other").alias("low"),
        F.greatest("chunk", "other").alias("high"), "chunk", "key", "direction", "cells", "copies",
    )
    found = stage(
        _found(members.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS), layout), "found"
    )
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.select("a", "b"))
    known = (
        distinct.select("key", "lowest", "copies")
        .join(roots.withColumnRenamed("a", "key"), "key", "left")
        .join(links.withColumnRenamed("a", "key"), "key", "left")
        .select(
            "key", F.coalesce("root", "key").alias("root"), "lowest",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    lowest = known.groupBy("root").agg(F.min("lowest").alias("component_id"))
    answers = known.join(lowest, "root").select(
        F.col("key").alias("known_key"), "n_links", "component_id"
    )
    out = rows.select("id", "key").join(answers, F.col("key") == F.col("known_key"), "left").select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
        .alias("component_id"),
    )
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
