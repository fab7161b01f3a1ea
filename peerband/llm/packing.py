"""Best-fit packing of token pieces by planning over the histogram of lengths.

The driver sees only how many pieces have each length (at most ``capacity`` numbers). Best fit in
order of falling length is run over those counts, whole ranges of equal sequences at a time, and
gives segments: items lo..hi of one length go to consecutive sequences at one offset. Each piece
then takes the slot of its rank within its length. Ranks are local ranks of the task that made the
piece plus the counts of the tasks before it, so no length is ever ordered in one task.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerband.llm.common import map_batches, narrow, prepare, resident, slabs
from peerband.session import stage

CAPACITY = 2048
END_ID = 0
#: Entries each word cache of a Python worker holds before it starts anew, and characters of the
#: longest word that is kept: text without spaces is one word, and is not.
CACHE_WORDS, CACHE_CHARS = 250_000, 64
#: Characters of text that are split into words at once.
SLAB_CHARS = 1 << 20


def best_fit_plan(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Segments (length, lo, hi, sequence, offset) for ``counts[length]`` pieces of each length.

    Item ``lo <= rank < hi`` of a length goes to ``sequence + rank - lo`` at ``offset``. The open
    sequence with the least room that suffices is taken first; a new one is filled with as many
    pieces of the length as fit before the next is opened. Sequences are numbered from 0.
    """
    capacity = len(counts) - 1
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    segments, opened = [], 0

    def fill(first: int, bins: int, each: int, free: int) -> None:
        """Put ``each`` pieces of the length into every one of ``bins`` sequences."""
        nonlocal rank
        for j in range(each):
            segments.append((length, rank, rank + bins, first, capacity - free + j * length))
            rank += bins
        room[free - each * length].append((first, bins))

    for length in range(capacity, 0, -1):
        rank, left = 0, int(counts[length])
        for free in range(length, capacity):
            fit = free // length
            while left and room[free]:
                first, size = room[free].pop()
                # A sequence that got one piece is the best fit for the next until it is full.
                bins, each = (min(left // fit, size), fit) if left >= fit else (1, left)
                if bins < size:
                    room[free].append((first + bins, size - bins))
                fill(first, bins, each, free)
                left -= bins * each
            if not left:
                break
        fit = capacity // length
        for bins, each in ((left // fit, fit), (1 if left % fit else 0, left % fit)):
            if bins:
                fill(opened, bins, each, capacity)
                opened += bins
    table = np.array(segments, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "lo", "hi", "sequence", "offset"), table.T.copy()))


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte.

    Visible Latin-1 characters stand for themselves, all other bytes for code points from 256 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordEncoder:
    """Token ids of whole texts by the ``tokenizers`` library, with its answers kept by word.

    The vocabulary splits text at white space first, so a text's ids are those of its words in
    turn. A word of Latin letters with a punctuation tail is split by the library's pattern into
    just these two, and lower-cased letter by letter; both are asked of the library's model. Any
    other word is asked of the whole library as it is.
    """

    # The letters' case mapping is one to one; the tail holds nothing that the pattern joins to them.
    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?-@\[-`{}~]*)")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}
        self.passing: list[str] = []

    def _part(self, part: str) -> bytes:
        code = self.parts.get(part)
        if code is None:
            plain = part if part.isascii() else part.encode().decode("latin-1").translate(
                self.symbols
            )
            ids = [t.id for t in self.model.tokenize(plain)]
            code = struct.pack(f"<{len(ids)}I", *ids)
            if len(part) <= CACHE_CHARS:
                self.parts[part] = code
        return code

    def learn(self, words: set[str]) -> None:
        """Know all of ``words``; long ones until the next call only."""
        for w in self.passing:
            self.words.pop(w, None)
        self.passing = [w for w in words if len(w) > CACHE_CHARS]
        if len(self.words) > CACHE_WORDS:
            self.words = {"": b""}
        if len(self.parts) > CACHE_WORDS:
            self.parts = {"": b""}
        other = []
        for w in words:
            if w not in self.words:
                m = self.SIMPLE.fullmatch(w)
                if m:
                    self.words[w] = self._part(m[1].lower()) + self._part(m[2])
                else:
                    other.append(w)
        if other:
            codes = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
            self.words.update((w, struct.pack(f"<{len(e.ids)}I", *e.ids))
                              for w, e in zip(other, codes))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, which should be few at a time."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        self.learn(set().union(*split))
        get = self.words.__getitem__
        for words in split:
            yield b"".join(map(get, words))


def _encoder(path: str) -> WordEncoder:
    return resident("words", path, lambda: WordEncoder(path))


def token_pieces(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, with_ids: bool = True,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids, with the task that made each and its rank there.

    Columns: id, piece, start, length, ids_crc32, task, local_rank (within task and length) and,
    if wanted, ids. Every text ends with id 0, so a null or empty one is a piece of length 1.
    ``vocabulary`` is the tokenizer file, which must be readable on the executors.
    """
    prepare(docs.sparkSession)
    source = narrow(docs, id=id_col, text=text_col)
    id_type = source.schema["id"].dataType.simpleString()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        task = TaskContext.get().partitionId()
        made = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, length, crc, ids, at = [], [], [], [], [], 0
            for slab in slabs(batch.column(1).to_pylist(), SLAB_CHARS):
                for code in encoder.encode(slab):
                    code += end
                    for k, cut in enumerate(range(0, len(code), 4 * capacity)):
                        part = code[cut:cut + 4 * capacity]
                        row.append(at)
                        piece.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                    at += 1
            size = np.array(length, np.int64)
            order = np.argsort(size, kind="stable")
            each = np.bincount(size, minlength=capacity + 1)
            first = np.cumsum(each) - each
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - first[size[order]] + made[size[order]]
            made += each
            number = np.array(piece, np.int32)
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(number),
                pa.array(number.astype(np.int64) * capacity),
                pa.array(size),
                pa.array(crc, pa.int64()),
                pa.array(np.full(len(size), task, np.int32)),
                pa.array(rank),
            ]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = (f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, task int,"
              " local_rank bigint") + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return source.mapInArrow(run, schema)


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, with_ids: bool = True,
) -> DataFrame:
    """All pieces of all documents with the sequence and offset that best fit gives them.

    Returns id, piece, start, length, ids_crc32, sequence_id, offset and, if wanted, ids. Null
    texts count as empty; rows may repeat; an empty table gives no rows; other columns are
    ignored. Sequences hold at most ``capacity`` ids and are filled without gaps from 0.
    """
    pieces = stage(
        token_pieces(docs, vocabulary, id_col, text_col, capacity, with_ids), "pieces"
    )
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    per_task = stage(per_task, "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    plan = best_fit_plan(counts)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = per_task.select(
        "task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    ranked = pieces.join(bases, ["task", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.col("local_rank")).alias("rank"),
        *(["ids"] if with_ids else []),
    )
    id_type = ranked.schema["id"].dataType.simpleString()
    starts = np.searchsorted(plan["length"], np.arange(capacity + 2))
    # A segment's place is length * span + lo, which orders segments by length and then by rank.
    span = int(counts.max(initial=0)) + 1
    place = plan["length"] * span + plan["lo"]

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        at = np.searchsorted(place, length * span + rank, side="right") - 1
        assert (at >= starts[length]).all() and (rank < plan["hi"][at]).all()
        slot = [
            pa.array(plan["sequence"][at] + rank - plan["lo"][at]),
            pa.array(plan["offset"][at]),
        ]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], *slot, *batch.columns[6:]],
            names=[*batch.schema.names[:5], "sequence_id", "offset", *batch.schema.names[6:]],
        )

    return map_batches(
        ranked, assign,
        f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint,"
        " sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else ""),
    )
