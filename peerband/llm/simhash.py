"""SimHash fingerprints and their links at a small Hamming distance, by pivot distance tables.

Every distinct fingerprint gets its Hamming distances to fixed reference fingerprints (pivots).
Two fingerprints at distance d differ by at most d in each such coordinate, so a pair whose largest
coordinate difference exceeds the limit is discarded unseen; the survivors are verified. Pairs are
looked for only where fingerprints agree on enough bands of bits: with two differing bits and five
bands, three bands agree, which gives ten tables of 38 bits. A block of one table with more than
``BLOCK`` distinct fingerprints is not paired. Its fingerprints go to the exact way for hot blocks:
each one lists every word at distance one or less, and all that list the same word are within two.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerband.llm.common import append_columns, decide, map_batches, narrow, private, quoted
from peerband.llm.components import components
from peerband.session import stage

BITS = 64
#: Differing bits that still link; the bands and the way for hot blocks are laid out for it.
DISTANCE = 2
BANDS = 5
SHARED = BANDS - DISTANCE
PIVOTS = 24
BLOCK = 64
SHINGLE = 3
SEED = 42
#: Shingles whose bits are counted at once.
SLAB = 1 << 16
#: Bytes of an id in a hashed table.
DROP_BYTES = 64


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same in every run."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text; 0 where there is no word.

    A-Z are lower-cased, words lie between space and the five ASCII control blanks, and each
    shingle (the whole sequence when there are fewer words) votes with its XXH64 of seed 42. A bit
    is 1 if it is set in over half the hashes.
    """
    # bytes.lower() and bytes.split() know ASCII only, which is just what is asked for.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    last = ends[k - 1:].tolist()
    first = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    n = len(last)
    for at in range(0, n, SLAB):
        hashes = np.fromiter(
            (digest(line[a:b], SEED) for a, b in zip(first[at:at + SLAB], last[at:at + SLAB])),
            np.uint64,
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit number."""
    source = narrow(docs, id=id_col, text=text_col)
    id_type = source.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64,
                          batch.num_rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"]
        )

    return map_batches(source, run, f"id {id_type}, fp bigint")


def _band_masks() -> list[int]:
    edges = np.linspace(0, BITS, BANDS + 1).round().astype(int)
    return [sum(1 << int(i) for i in range(a, b)) for a, b in zip(edges, edges[1:])]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _tables() -> list[int]:
    """One mask for each choice of bands that two linked fingerprints may agree on."""
    bands = _band_masks()
    return [_signed(sum(c)) for c in combinations(bands, SHARED)]


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, coords): the Hamming distance of each fingerprint to every pivot."""
    return fps.select(
        "fp",
        F.array(
            *[
                F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(p))))).cast("tinyint")
                for p in pivots()
            ]
        ).alias("coords"),
    )


def verified_links(fps: np.ndarray, coords: np.ndarray, limit: int = DISTANCE) -> np.ndarray:
    """Index pairs within ``limit`` bits, from fingerprints of one block and their coordinates.

    Rows are swept in the order of the first coordinate, so a row meets only those within the
    limit there; the other coordinates discard, and the exact distance decides.
    """
    order = np.argsort(coords[:, 0], kind="stable")
    fps, coords = fps[order], coords[order].astype(np.int16)
    upto = np.searchsorted(coords[:, 0], coords[:, 0] + limit, side="right")
    found = []
    for i in range(len(fps)):
        near = np.abs(coords[i + 1:upto[i]] - coords[i]).max(axis=1) <= limit
        j = np.flatnonzero(near) + i + 1
        j = j[np.bitwise_count(fps[j] ^ fps[i]) <= limit]
        found.append(np.stack([np.full(len(j), i), j], axis=1))
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return order[pairs]


def spanning(pairs: np.ndarray, n: int) -> np.ndarray:
    """Links of a forest with the same components as ``pairs`` over n rows: fewer than n."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return np.array(kept, dtype=np.int64).reshape(-1, 2)


def block_links(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links of distinct fingerprints that keep every component, from the pivot table."""
    keyed = points.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _tables()])).alias(
            "table", "key"
        ),
    )
    sizes = stage(
        keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"),
        "blocks",
    )
    members = keyed.join(sizes, ["table", "key"])
    small = (
        members.where(F.col("size") <= block)
        .join(points, "fp")
        .groupBy("table", "key")
        .agg(F.collect_list(F.struct("fp", "coords")).alias("rows"))
        .select(F.col("rows.fp").alias("fps"), F.col("rows.coords").alias("coords"))
    )

    def pair(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends = [[], []]
        for fps, coords in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.array(fps, np.int64)
            pairs = verified_links(own.view(np.uint64), np.array(coords, np.int16))
            for side, at in zip(ends, spanning(pairs, len(own)).T):
                side.append(own[at])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in ends],
            names=["a", "b"],
        )

    found = map_batches(small, pair, "a bigint, b bigint")
    words = F.array(
        F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)]
    )
    hot = members.where(F.col("size") > block).select("fp").distinct()
    near = hot.select("fp", F.explode(words).alias("word"))
    centre = near.groupBy("word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n"))
    stars = near.join(centre.where("n > 1"), "word").select(F.col("fp").alias("a"), "b")
    return found.union(stars.where("a <> b").distinct())


def _labelled(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """(id, fp, component_id, n_linked, keep_fp) of every row.

    ``keep_fp`` is the smallest fingerprint of the component that a row with its smallest id has.
    """
    rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stage(
        rows.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct"
    )
    roots = components(block_links(stage(pivot_table(distinct), "pivots"), block))
    member = distinct.join(roots, distinct["fp"] == roots["a"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low", "n"
    )
    keeper = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp"))
    groups = member.groupBy("root").agg(keeper.alias("keeper"), F.sum("n").alias("n_linked"))
    groups = groups.select(
        "root", F.col("keeper.low").alias("component_id"), "n_linked",
        F.col("keeper.fp").alias("keep_fp"),
    )
    return rows.join(member.select("fp", "root").join(groups, "root").drop("root"), "fp")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per row: id, fingerprint (16 hex digits), component_id, n_linked.

    ``component_id`` is the smallest id reachable through links, the row's own included; null ids
    are not counted and give null only where a component has no other. ``n_linked`` is the number
    of rows of the component. Null and empty texts have fingerprint 0 and link like any other.
    Rows may repeat; other columns are ignored; an empty table gives no rows.
    """
    return _labelled(docs, id_col, text_col, block).select(
        "id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "n_linked",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component, one with the smallest id; null ids come last.

    Of rows that share this id, one with the smallest fingerprint stays, and one of those that
    share both. Where no id repeats, rows are told apart by id; otherwise by id and fingerprint,
    which is computed again, so an id that repeats in another component is judged there alone.
    """
    drop_id, drop_fp, own_fp = private(docs, "drop_id", "drop_fp", "fp")
    found = stage(
        _labelled(docs, id_col, text_col, BLOCK).select(
            "id", "fp", (F.col("id").eqNullSafe(F.col("component_id"))
                         & (F.col("fp") == F.col("keep_fp"))).alias("keeps")
        ),
        "kept",
    )
    drops = stage(
        found.where("not keeps")
        .select(F.col("id").alias(drop_id), F.col("fp").alias(drop_fp))
        .distinct(),
        "drops",
    )
    same, n_bytes = quoted(id_col).eqNullSafe(F.col(drop_id)), drops.count() * DROP_BYTES
    if not found.groupBy("id").count().where("count > 1").limit(1).count():
        return decide(docs, drops, same, "left_anti", n_bytes)

    def run(texts: list) -> dict[str, pa.Array]:
        fps = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
        return {own_fp: pa.array(fps.view(np.int64))}

    marked = append_columns(docs, text_col, run, f"{own_fp} bigint")
    same &= F.col(own_fp) == F.col(drop_fp)
    out = decide(marked, drops, same, "left_anti", n_bytes)
    if found.where("keeps").groupBy("id", "fp").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, own_fp])
    return out.select(*[quoted(c) for c in docs.columns])
