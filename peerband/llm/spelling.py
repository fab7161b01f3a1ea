"""Groups of spelling variants by asymmetric q-chunks.

Of two words within one edit, the shorter one gives two disjoint chunks, its halves, and the longer
one all its grams of that size with their positions. One edit harms one chunk at most; the other
stands in the longer word, shifted by the difference of lengths at most. So words that share a
chunk and gram within a shift of one are all that need verifying.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerband.llm.common import narrow, prepare
from peerband.operators.distribution import join_same
from peerband.session import stage

RUN = "A-Za-zÀ-ÿ"
#: Words count from so many code points and occurrences on.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent as the word.
TIMES = 5
#: One run in so many loses a code point.
DAMAGE = 199
#: Characters that are searched at once; a cut is made where no run is.
WINDOW_CHARS = 1 << 20
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000
#: Grams of one key that are verified together; a key with more is dealt to several.
SIDE = 512


def damaged(doc_id: bytes, run: bytes) -> bytes:
    """The lower-cased run, with one code point less where the checksum of both says so."""
    h = zlib.crc32(run, zlib.crc32(doc_id + b":"))
    if h % DAMAGE:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


_RUN, _GAP = re.compile(f"[{RUN}]+"), re.compile(f"[^{RUN}]")


def runs_of(text: str) -> Iterator[list[str]]:
    """All maximal runs of letters, some at a time, with A-Z lower-cased."""
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > WINDOW_CHARS:
            gap = _GAP.search(text, at + WINDOW_CHARS)
            stop = gap.start() if gap else stop
        # Only A-Z change in bytes.
        part = text[at:stop].encode("utf-8", "replace").lower().decode()
        yield _RUN.findall(part)
        at = stop


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all runs of all documents, damaged as stated, whatever their length or count."""
    prepare(docs.sparkSession)
    source = narrow(docs, id=id_col, text=text_col).select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in counts], pa.string()),
             pa.array(counts.values(), pa.int64())], names=["word", "n"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = doc_id.encode()
                for runs in runs_of(text):
                    for run, n in Counter(runs).items():
                        held[damaged(name, run.encode())] += n
                    if len(held) > HELD_WORDS:
                        yield batch_of(held)
                        held.clear()
        yield batch_of(held)

    return (
        source.mapInArrow(count, "word string, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n"))
    )


def vocabulary_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words that are long and frequent enough."""
    return word_counts(docs, id_col, text_col).where(
        (F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT)
    )


def chunks(word: Column) -> Column:
    """The two chunks of a word as (q, at, gram) for every shift that a partner may show.

    A partner of the same length shows a chunk where it is, one with a code point more shows it
    there or one further. ``size`` is the word's own length.
    """
    size = F.length(word)
    q = F.floor(size / 2).cast("int")
    cut = [(F.lit(1), q), (q + 1, q)]
    return F.array(*[
        F.struct(
            size.alias("size"), (size + more).alias("other_size"), (start + shift).alias("at"),
            F.substring(word, start, length).alias("gram"),
        )
        for start, length in cut for more in (0, 1) for shift in range(more + 1)
    ])


def grams(word: Column) -> Column:
    """All positional grams of a word, for partners of its length and of one code point less."""
    size = F.length(word)

    def cut(less: int) -> Column:
        q = F.floor((size - less) / 2).cast("int")
        return F.transform(
            F.sequence(F.lit(1), size - q + 1),
            lambda at: F.struct(
                (size - less).alias("size"), size.alias("other_size"), at.alias("at"),
                F.substring(word, at, q).alias("gram"),
            ),
        )

    return F.concat(cut(0), cut(1))


KEY = ["size", "other_size", "at", "gram"]


def near_pairs(words: DataFrame, side: int = SIDE) -> DataFrame:
    """(word, other) once for each two words within exactly one edit; ``words`` is stored.

    A key that many words share is dealt out: its grams to parts of about ``side``, its chunks to
    all of them. Pairs are verified inside the join and never written before.
    """
    chunked = words.select("word", F.explode(chunks(F.col("word"))).alias("k")).select("word", "k.*")
    gram_rows = words.select(F.col("word").alias("other"), F.explode(grams(F.col("word"))).alias("k")).select(
        "other", "k.*"
    )
    # Grams without a chunk meet nothing, so they need not be moved again.
    asked = chunked.groupBy(*KEY).agg(F.count(F.lit(1)).alias("chunks"))
    sizes = (
        gram_rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("grams"))
        .join(asked, KEY)
        .where("grams > 1 or other_size > size")
        .select(*KEY, F.ceil(F.col("grams") / side).cast("int").alias("parts"))
    )
    sizes = stage(sizes, "key_sizes")
    left = chunked.join(sizes, KEY).select(
        "word", *KEY, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    right = gram_rows.join(sizes, KEY).select(
        "other", *KEY, F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part")
    )
    met = left.join(right, [*KEY, "part"]).where(
        # Words of one length meet from both sides; one is enough.
        ((F.col("other_size") > F.col("size")) | (F.col("word") < F.col("other")))
        & (F.levenshtein("word", "other", 1) == 1)
    )
    return met.select("word", "other").distinct()


def with_roots(formed: DataFrame, most: int, times: int = TIMES) -> DataFrame:
    """Add ``root``: the last word when forms are followed; the word itself where there is none.

    Each step is to a word at least ``times`` as frequent, so ``most`` bounds the steps, and as
    every round doubles the steps taken, their number is known beforehand.
    """
    steps = math.log(max(most, 2), times) + 1
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        links = stage(links, "links")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")
        )
    return join_same(formed, links, ["word"], ["root"]).withColumn(
        "root", F.coalesce("root", "word")
    )


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES,
    side: int = SIDE,
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, after the stated
    damage, with at least 6 code points and 5 occurrences in the whole table. Two are near at
    exactly one inserted, deleted or replaced code point. ``form`` is the most frequent near word,
    of equal ones the first in code-point order, if it is at least ``times`` as frequent, else
    null. A null text holds no word; a null id is an empty one in the checksum; rows that repeat
    count each time; an empty table, or one without such words, gives no rows. Other columns are
    ignored.
    """
    words = stage(vocabulary_of(docs, id_col, text_col), "words")
    pairs = stage(near_pairs(words, side), "pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = (
        both.join(counts, "other").groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"),
             F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
        .select("word", "n_near", F.col("best.other").alias("near"),
                (-F.col("best.less")).alias("near_n"))
    )
    enough = F.col("near_n") >= F.col("n") * times
    formed = stage(
        join_same(words, best, ["word"], ["n_near", "near", "near_n"]).select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("near")).alias("form"),
            F.when(enough, F.col("near_n")).alias("form_n"),
        ),
        "formed",
    )
    most = formed.agg(F.max("n")).first()[0]
    return with_roots(formed, most or 1, times)
