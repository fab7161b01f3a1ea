"""Line deduplication by winnowing over line hashes.

Each document is a row of hashes of its lines that hold a word. A window is a shortest span of lines
with enough words: one starts at every line and one ends there. The least hash of a window is its
fingerprint, so two places that hold the same window have the same fingerprint, and every repeated
run with enough words, which has at least one whole window, is guaranteed to share one. Windows
whose fingerprint stands nowhere else are done with. The others are joined by position: a window's
content, named by its fingerprint and a 128-bit hash of its line hashes, is looked up at its first
place. Windows that match along one diagonal extend each other both ways to runs, and runs that are
not at their first place are deleted.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerband.llm.common import decide, prepare, quoted, text_or_empty
from peerband.session import stage

#: Words a run must have to be deleted.
LEAST_WORDS = 50
#: Bytes of a document's name and of a run in a hashed table.
DOC_BYTES, RUN_BYTES = 128, 32
#: Bytes of a fingerprint in a hashed table.
MARK_BYTES = 16
#: A key at more places than this, and than this share of all windows, is joined by broadcast:
#: there are at most as many such keys as the share says.
HOT_PLACES, HOT_SHARE = 10_000, 50_000


def content_lines(text: str) -> tuple[list[int], list[str]]:
    """Numbers and texts of the lines that hold a word. Lines end at a line feed."""
    lines = text.split("\n")
    at = [i for i, line in enumerate(lines) if line.split()]
    return at, [lines[i] for i in at]


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and number of words of each line that holds a word."""
    lines = content_lines(text)[1]
    digest = xxhash.xxh64_intdigest
    return (
        np.fromiter((digest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64,
                    len(lines)),
        np.fromiter((len(x.split()) for x in lines), np.int64, len(lines)),
    )


def windows(words: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of every shortest span of lines with ``least_words``, from and to each line."""
    n, least = len(words), max(least_words, 1)
    total = np.concatenate([[0], np.cumsum(words)])
    stop = np.searchsorted(total, total[:-1] + least)
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    from_line, to_line = np.flatnonzero(stop <= n), np.flatnonzero(start >= 0)
    spans = np.unique(np.concatenate([
        from_line * (n + 1) + stop[from_line], start[to_line] * (n + 1) + to_line + 1
    ]))
    return spans // (n + 1), spans % (n + 1)


def winnow(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Position of the least hash of each window, the last of equal ones."""
    best = np.empty(len(start), np.int64)
    # Windows go on from left to right, so what is passed by a lesser hash is never looked at again.
    line, kept = 0, deque()
    for k, (a, b) in enumerate(zip(start.tolist(), stop.tolist())):
        while line < b:
            while kept and hashes[kept[-1]] >= hashes[line]:
                kept.pop()
            kept.append(line)
            line += 1
        while kept[0] < a:
            kept.popleft()
        best[k] = kept[0]
    return best


def fingerprints(
    hashes: np.ndarray, words: np.ndarray, least_words: int
) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(mark, at, key, start, stop) of every window of one document.

    ``mark`` is the window's fingerprint and ``at`` the line it stands in.
    """
    start, stop = windows(words, least_words)
    at = winnow(hashes, start, stop)
    raw = hashes.tobytes()
    digest = xxhash.xxh3_128_digest
    keys = [digest(raw[8 * a:8 * b]) for a, b in zip(start.tolist(), stop.tolist())]
    return hashes[at], at, keys, start, stop


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same lines as ``spans``, as runs in order that neither overlap nor touch."""
    runs = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(hi, runs[-1][1]))
        else:
            runs.append((lo, hi))
    return runs


def extended(matches: list[dict]) -> list[tuple[int, int]]:
    """Runs of windows that overlap or touch on one diagonal: each extends the others both ways."""
    diagonals: dict[tuple, list[tuple[int, int]]] = {}
    for m in matches:
        on = diagonals.setdefault((m["first_doc"], m["diagonal"]), [])
        on.append((m["start"], m["stop"]))
    return [run for spans in diagonals.values() for run in merged(spans)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, text). ``doc`` names a document by id and text; rows that repeat both are one."""
    text = text_or_empty(text_col)
    name = F.concat(F.coalesce(quoted(id_col).cast("string"), F.lit("?")), F.lit(":"),
                    F.hex(F.xxhash64(text)))
    return docs.select(name.alias("doc"), quoted(id_col).alias("id"), text.alias("text"))


def repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(doc, runs) of documents with later repeated runs; runs count lines that hold a word."""
    prepare(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    id_type = keyed.schema["id"].dataType.simpleString()
    window = pa.struct([("mark", pa.int64()), ("key", pa.binary()), ("start", pa.int32()),
                        ("stop", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, found, sizes = [], [], []
            for text in batch.column(2).to_pylist():
                mark, at, key, start, stop = fingerprints(*line_hashes(text), least_words)
                # A fingerprint counts once a line, however many windows chose it.
                marks.append(mark[np.unique(at, return_index=True)[1]].view(np.int64))
                sizes.append(len(key))
                found.append((mark.view(np.int64), key, start, stop))
            rows = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([f[0] for f in found]), pa.int64()),
                 pa.array([k for f in found for k in f[1]], pa.binary()),
                 pa.array(np.concatenate([f[2] for f in found]), pa.int32()),
                 pa.array(np.concatenate([f[3] for f in found]), pa.int32())],
                fields=list(window),
            )
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(marks, pa.list_(pa.int64())),
                 pa.ListArray.from_arrays(offsets, rows)],
                names=["doc", "id", "marks", "windows"],
            )

    lines = stage(
        keyed.mapInArrow(
            read, f"doc string, id {id_type}, marks array<bigint>,"
            " windows array<struct<mark: bigint, key: binary, start: int, stop: int>>"
        ),
        "lines",
    )
    # Rows that repeat id and text are one document, so their lines are not each other's copies.
    shared = stage(
        lines.select("doc", F.posexplode("marks").alias("i", "mark"))
        .groupBy("mark").agg(F.min(F.struct("doc", "i")).alias("a"),
                             F.max(F.struct("doc", "i")).alias("b"))
        .where("a <> b").select(F.col("mark").alias("shared")),
        "shared",
    )
    spans = lines.select("doc", "id", F.explode("windows").alias("w")).select("doc", "id", "w.*")
    spans = stage(
        decide(spans, shared, F.col("mark") == F.col("shared"), "left_semi",
               shared.count() * MARK_BYTES),
        "windows",
    )
    place = F.struct("id", "doc", "start")
    key = ["mark", "key"]
    firsts = stage(
        spans.groupBy(*key)
        .agg(F.min(place).alias("first"), F.max(place).alias("last"),
             F.count(F.lit(1)).alias("places"))
        .where("first <> last")
        .select(*[F.col(c).alias(f"first_{c}") for c in key], "places",
                F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start")),
        "firsts",
    )
    total = firsts.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    hot = F.col("places") > max(HOT_PLACES, total // HOT_SHARE)
    same = (F.col("mark") == F.col("first_mark")) & (F.col("key") == F.col("first_key"))
    own = ["doc", "start", "stop", "first_doc", "first_start"]
    often = spans.join(F.broadcast(firsts.where(hot)), same).select(*own)
    seldom = spans.join(firsts.where(~hot), same).select(*own)
    later = (
        often.unionAll(seldom)
        .where("doc <> first_doc or start <> first_start")
        .groupBy("doc").agg(
            F.collect_set(F.struct("first_doc", (F.col("start") - F.col("first_start"))
                                   .alias("diagonal"), "start", "stop")).alias("spans"))
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [
                [{"start": a, "stop": b} for a, b in merged(extended(at))]
                for at in batch.column(1).to_pylist()
            ]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(runs, kind)], names=["doc", "runs"]
            )

    return later.mapInArrow(merge, "doc string, runs array<struct<start: int, stop: int>>")


def cut_lines(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, list[int]]:
    """The text without the lines of the runs; how many lines hold a word; numbers of lines cut."""
    at, _ = content_lines(text)
    gone = sorted({at[i] for lo, hi in runs for i in range(lo, hi)})
    if not gone:
        return text, len(at), []
    drop = set(gone)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop), len(at), gone


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """One row per row: id, n_lines (with a word), n_deleted, deleted (line numbers), text.

    Documents are in the order of their ids, a null id first, then of a hash of their texts. A line
    is deleted where it is in a run of lines of at least ``least_words`` words that stands in an
    earlier document or further up in the same one, wherever that is; what stands first stays.
    Lines are equal when identical, told by their 64-bit hashes and a 128-bit hash of a window's;
    lines without a word are skipped in matching and stay. Null texts count as empty. Rows that repeat both id and text
    get the same answer. Other columns are ignored; an empty table gives no rows.
    """
    found = stage(repeated_runs(docs, id_col, text_col, least_words), "runs")
    held = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("runs")).alias("runs")).first()
    joined = decide(
        _keyed(docs, id_col, text_col), found.withColumnRenamed("doc", "run_doc"),
        F.col("doc") == F.col("run_doc"), "left",
        held.n * DOC_BYTES + (held.runs or 0) * RUN_BYTES,
    ).select("id", "text", "runs")
    id_type = joined.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                cut_lines(text, [(r["start"], r["stop"]) for r in runs or []])
                for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([len(r[2]) for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[0] for r in rows], pa.string())],
                names=["id", "n_lines", "n_deleted", "deleted", "text"],
            )

    return joined.mapInArrow(
        cut, f"id {id_type}, n_lines bigint, n_deleted bigint, deleted array<int>, text string"
    )
