"""Token ids in ORC files, sorted by document id.

Documents are dealt to ranges of their ids and sorted there, encoded, and written as they come:
one list of ids a document, which ORC stores with its integer run-length encoding. Stripes can be
read in parallel; row indexes and Bloom filters on the document id let a reader of some documents
skip the stripes and row groups without them. A row also holds its part and its place there, so a
document's place in the whole corpus needs one number a part beside it.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerband.llm.common import decide, map_batches, prepare, quoted, resident, slabs, text_or_empty
from peerband.llm.packing import byte_symbols
from peerband.session import shared_folder

END_ID = 0
#: Bytes of a stripe before compression, and rows of a row group of its index.
STRIPE_BYTES, GROUP_ROWS = 16 << 20, 1000
#: Rows after which the writer asks whether a stripe is full: documents may be long.
CHECK_ROWS = 100
#: A Bloom filter's share of false answers.
FALSE_SHARE = 0.01
#: Entries of each of the four generations a Python worker keeps, and characters of the longest
#: kept text: about 200 MB as a rule and 600 MB at most, whatever the texts are.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 64
#: Characters of text that are split at once.
SLAB_CHARS = 1 << 20
#: Bytes of a part's number and place in a hashed table.
PART_BYTES = 32


class Recent(dict):
    """Codes by text, made when first asked for. Two generations are kept: when the younger one is
    full it becomes the older one, from which what is asked for again comes back."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        code = self.older.get(text)
        if code is None:
            code = self.make(text)
        if len(text) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[text] = code
        return code


class Irregular(Exception):
    """A text whose spaces or line ends do not all stand alone."""


class ChunkEncoder:
    """Token ids by the ``tokenizers`` library, with its answers kept for short chunks of text.

    The vocabulary's pattern never joins characters over a line end or a space that stands alone:
    a line end is a token and a space begins the next one. So text may be cut there, and the ids
    are those of the chunks in turn. A chunk of letters with a tail of punctuation is split by the
    pattern into just these two, which are asked of the library's model; any other chunk is asked
    of the whole library. Nothing of a longer chunk is kept. Letters after a space are a chunk of
    their own, so they are kept once, whatever tails they are seen with.
    """

    LINE, WORD = re.compile(r"(?<=\S)\n(?=\S)"), re.compile(r"(?<=\S) (?=\S)")
    SIMPLE = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?-@\[-`{}~]*)")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.symbols = dict(enumerate(byte_symbols()))
        self.parts, self.chunks = Recent(self._part), Recent(self._chunk)
        self.space = self.symbols[ord(" ")]
        self.line_end = self._part("\n")

    def _part(self, part: str) -> bytes:
        """What the pattern leaves in one piece."""
        return self._shown(part.encode().decode("latin-1").translate(self.symbols))

    def _shown(self, part: str) -> bytes:
        """A piece that is written with the vocabulary's symbols for bytes."""
        return array("I", [t.id for t in self.tokenize(part)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, word: str) -> bytes:
        """What stood after a space, or after a line end that the word still has."""
        if word.isascii() and word.isalpha():  # these letters are their own symbols
            return self._shown(self.space + word)
        m = self.SIMPLE.fullmatch(word)
        if m:
            line, letters, tail = m.groups()
            if line:
                code = self.line_end + self.parts[letters]
            else:
                code = self.chunks[letters] if tail else self._part(" " + letters)
            return code + self.parts[tail] if tail else code
        begun = word[1:] if word[:1] == "\n" else word
        if not begun or begun.strip() != begun:
            raise Irregular
        return self._whole(word if begun is not word else " " + word)

    def _regular(self, text: str) -> bytes:
        first, *words = text.replace("\n", " \n").split(" ")
        if not first or first.strip() != first:
            raise Irregular
        return self._whole(first) + b"".join(map(self.chunks.__getitem__, words))

    def _any(self, text: str) -> bytes:
        lines = []
        for line in self.LINE.split(text):
            first, *words = self.WORD.split(line)
            lines.append(self._whole(first) + b"".join([
                self.chunks[w] if w.strip() == w else self._whole(" " + w) for w in words
            ]))
        return self.line_end.join(lines)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Unsigned 32-bit ids of each text, in the machine's byte order."""
        for text in texts:
            try:
                code = self._regular(text) if text else b""
            except Irregular:
                code = self._any(text)
            yield code


def _ranged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) in ranges of ids, sorted; a null id is first.

    Rows of one id are in the order of their texts' XXH64. The row's place in the source ends the
    key, so an id or a text that stands in very many rows spans as many parts as it needs.
    """
    text = text_or_empty(text_col)
    key = ["id", "hash", "row"]
    return (
        docs.select(
            quoted(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"),
            F.monotonically_increasing_id().alias("row"),
        )
        .repartitionByRange(*map(F.col, key))
        .sortWithinPartitions(*key)
        .select("id", "text")
    )


def write_tokens(
    docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text",
    stripe_bytes: int = STRIPE_BYTES, group_rows: int = GROUP_ROWS,
) -> None:
    """Write the token ids of every document, each ended by id 0, as ORC files under ``path``.

    Columns: id, part (files in the order of ids), at (ids before the document in its part),
    n_tokens (with the end) and ids. Documents ascend by id, a null id first; of one id, by the
    XXH64 of the text. Null texts count as empty, so they are the end alone; rows may repeat; an
    empty table writes no rows; other columns are ignored. ``vocabulary`` is a tokenizer file that
    executors can read. The folder must not exist yet; Spark's committer puts each part in place
    once, so a task that ran twice leaves one file.
    """
    prepare(docs.sparkSession)
    source = _ranged(docs, id_col, text_col)
    id_type = source.schema["id"].dataType.simpleString()
    end = array("I", [END_ID]).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = resident("chunks", vocabulary, lambda: ChunkEncoder(vocabulary))
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            done = 0
            for slab in slabs(batch.column(1).to_pylist(), SLAB_CHARS):
                codes = [code + end for code in encoder.encode(slab)]
                size = np.array([len(c) // 4 for c in codes], np.int64)
                stops = np.cumsum(size)
                ids = np.frombuffer(b"".join(codes), np.uint32).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(codes)),
                     pa.array(np.full(len(codes), part, np.int32)),
                     pa.array(at + stops - size), pa.array(size),
                     pa.ListArray.from_arrays(
                         pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(ids))],
                    names=["id", "part", "at", "n_tokens", "ids"],
                )
                at += int(stops[-1])
                done += len(codes)

    rows = source.mapInArrow(
        encode, f"id {id_type}, part int, at bigint, n_tokens bigint, ids array<int>"
    )
    (
        rows.write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", group_rows)
        .option("orc.rows.between.memory.checks", CHECK_ROWS)
        .option("orc.bloom.filter.columns", "id")
        .option("orc.bloom.filter.fpp", FALSE_SHARE)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: Iterable | None = None) -> DataFrame:
    """The rows that ``write_tokens`` wrote; with ``ids`` only those of these documents.

    The condition reaches the files: row indexes and Bloom filters skip row groups without them.
    """
    rows = spark.read.orc(path)
    return rows if ids is None else rows.where(F.col("id").isin(list(ids)))


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """Add ``start``: the ids of all documents before the row's, over all parts.

    ``rows`` come from ``read_tokens``, some or all. Reads two numbers of each row of the files and
    sends one number a part; parts are at most the ranges of the shuffle that wrote them.
    """
    spark = rows.sparkSession
    totals = {
        r.part: r.n for r in spark.read.orc(path).groupBy("part")
        .agg(F.max(F.col("at") + F.col("n_tokens")).alias("n")).collect()
    }
    before, bases = 0, []
    for part in sorted(totals):
        bases.append((part, before))
        before += totals[part]
    table = spark.createDataFrame(bases, "base_part int, base bigint")
    joined = decide(rows, table, F.col("part") == F.col("base_part"), "inner",
                    len(bases) * PART_BYTES)
    return joined.withColumn("start", F.col("base") + F.col("at")).drop("base_part", "base")


def token_digests(rows: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of rows with starts, from the ids as read."""
    source = rows.select("id", "start", "ids")
    id_type = source.schema["id"].dataType.simpleString()

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(2)
        size = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        raw = memoryview(ids.flatten().to_numpy().astype("<u4").tobytes())
        stop = 4 * np.cumsum(size)
        crc = [zlib.crc32(raw[a:b]) for a, b in zip((stop - 4 * size).tolist(), stop.tolist())]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size), pa.array(crc, pa.int64())],
            names=["id", "start", "n_tokens", "ids_crc32"],
        )

    return map_batches(
        source, digest, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def tokens_round_trip(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all documents to a new folder in the shared one, and digest what the files hold.

    Returns id, start, n_tokens and ids_crc32 for every row; see ``write_tokens`` for its order and
    for null, empty, repeated and missing rows.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/peerband/{uuid.uuid4().hex}/tokens.orc"
    write_tokens(docs, vocabulary, path, id_col, text_col)
    return token_digests(with_starts(read_tokens(spark, path), path))
