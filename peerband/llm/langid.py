"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of the bytes that follow every context of up to three bytes. A
byte seen after its context has n / (N + D) of the probability there, N being all bytes seen after
it and D their kinds; the escape to the next shorter context has D / (N + D); after the empty one
every byte is equally likely; a context that was never seen costs nothing to leave. With frozen
counts the code length of a byte depends on the last four bytes only, so the trees are flattened
into one row of code lengths for every four bytes that any language has seen, and the same for
shorter runs and for escapes. A text's code length in a language is the exact sum over its bytes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerband.llm.common import append_columns, narrow, prepare, private, quoted, resident
from peerband.session import stage

ORDER = 3
#: Every byte value is its own symbol. A text is read as if three zero bytes stood before it.
SYMBOLS = 256
#: Documents of each language that the counts are taken from, on average.
SAMPLE_PER_LANGUAGE = 1000
UNKNOWN = "und"
#: Bytes scored at once.
SLAB = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ``ORDER`` zeros; where texts start; which bytes are text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b"".join(bytes(ORDER) + r for r in raw), np.uint8)
    lengths = np.fromiter((len(r) + ORDER for r in raw), np.int64, len(raw))
    starts = np.cumsum(lengths) - lengths
    real = np.ones(len(joined), bool)
    for k in range(ORDER):
        real[starts + k] = False
    return joined, starts, real


@dataclass
class Trees:
    """Frozen context trees. ``codes[k]``, sorted, are the runs of k + 1 bytes of ``bits[k]``."""

    languages: list[str]
    #: Symbol of each byte value: itself.
    classes: np.ndarray = field(default_factory=lambda: np.arange(SYMBOLS))
    codes: list[np.ndarray] = field(default_factory=list)
    bits: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def grow(cls, grams: np.ndarray, language: np.ndarray, counts: np.ndarray,
             languages: list[str]) -> Trees:
        """From counts of four-byte runs (big-endian numbers) of each language."""
        trees = cls(languages)
        lower = np.full((1, len(languages)), np.log2(SYMBOLS))
        for k in range(ORDER + 1):
            tail = grams % SYMBOLS ** (k + 1)
            seen, at = np.unique(tail, return_inverse=True)
            table = np.zeros((len(seen), len(languages)))
            np.add.at(table, (at, language), counts)
            context, where = np.unique(seen // SYMBOLS, return_inverse=True)
            total = np.zeros((len(context), len(languages)))
            kinds = np.zeros_like(total)
            np.add.at(total, where, table)
            np.add.at(kinds, where, table > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                direct = -np.log2(table / (total + kinds)[where])
            if k:
                shorter = np.searchsorted(trees.codes[-1], seen % SYMBOLS**k)
                lower = trees.bits[-1][shorter]
            bits = np.where(table > 0, direct, escape[where] + lower)
            trees.codes.append(seen)
            trees.bits.append(bits)
            trees.contexts.append(context)
            trees.escapes.append(escape)
        return trees


class Scorer:
    """Trees with rows found by binary search; row 0 is that of runs that were not seen."""

    def __init__(self, trees: Trees) -> None:
        self.trees = trees
        self.codes = [c.astype(np.uint32) for c in trees.codes]
        self.contexts = [c.astype(np.uint32) for c in trees.contexts]
        none = np.zeros((1, len(trees.languages)))
        self.bits = [np.concatenate([none, b]).astype(np.float32) for b in trees.bits]
        self.escapes = [np.concatenate([none, e]).astype(np.float32) for e in trees.escapes]

    @staticmethod
    def _rows(seen: np.ndarray, code: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(seen, code), len(seen) - 1)
        return np.where(seen[at] == code, at + 1, 0)

    def _lengths(self, code: np.ndarray, k: int) -> np.ndarray:
        """Code lengths (positions x languages) at order ``k`` of codes of k + 1 symbols."""
        if k < 0:
            width = len(self.trees.languages)
            return np.full((len(code), width), np.log2(SYMBOLS), np.float32)
        row = self._rows(self.codes[k], code)
        out = self.bits[k][row]
        missed = np.flatnonzero(row == 0)
        if len(missed):
            left = code[missed]
            escape = self.escapes[k][self._rows(self.contexts[k], left // SYMBOLS)]
            out[missed] = escape + self._lengths(left % SYMBOLS**k, k - 1)
        return out

    def total_bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each whole text in each language."""
        joined, starts, real = _padded(texts)
        code = joined.astype(np.uint32)
        for k in range(1, ORDER + 1):
            code[k:] += joined[:-k].astype(np.uint32) << np.uint32(8 * k)
        totals = np.zeros((len(texts), len(self.trees.languages)))
        text_of = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(joined))))
        at = np.flatnonzero(real)
        for a in range(0, len(at), SLAB):
            some = at[a:a + SLAB]
            lengths = self._lengths(code[some], ORDER)
            owner = text_of[some]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            totals[owner[first]] += np.add.reduceat(lengths, first, axis=0, dtype=np.float64)
        return totals


def _scorer(trees: Trees) -> Scorer:
    return resident("trees", trees.key, lambda: Scorer(trees))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
) -> Trees | None:
    """Context trees of the labelled rows of ``docs``; None if there are none.

    Of a language with more rows, those whose hashed id falls below the share that gives
    ``sample_per_language`` are used, with their whole texts. Runs of four bytes are counted on
    the executors; only the distinct ones reach the driver, whose number the sample bounds.
    """
    prepare(docs.sparkSession)
    rows = narrow(docs, id=id_col, text=text_col, lang=label_col).where(
        "lang is not null and text is not null and id is not null"
    )
    shares = {
        r.lang: sample_per_language / r.n
        for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    if not shares:
        return None
    languages = sorted(shares)
    spread = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    share = F.coalesce(*[
        F.when(F.col("lang") == name, F.lit(float(shares[name]))) for name in languages
    ])
    sample = rows.where(spread < share).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = batch.column(1).to_pylist()
            for name in languages:
                mine = [texts[i] for i in np.flatnonzero(label == name)]
                if not mine:
                    continue
                joined, _, real = _padded(mine)
                gram = joined.astype(np.int64)
                for k in range(1, ORDER + 1):
                    gram[k:] += joined[:-k].astype(np.int64) << (8 * k)
                seen, n = np.unique(gram[real], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(seen)), pa.array(seen), pa.array(n)],
                    names=["lang", "gram", "n"],
                )

    counts = (
        sample.mapInArrow(run, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    found = stage(counts, "runs").toPandas()
    if found.empty:
        return None
    number = {name: i for i, name in enumerate(languages)}
    found = found.sort_values(["lang", "gram"])
    return Trees.grow(
        found["gram"].to_numpy(np.int64), found["lang"].map(number).to_numpy(np.int64),
        found["n"].to_numpy(np.float64), languages,
    )


def identify(
    docs: DataFrame, trees: Trees | None, text_col: str = "text",
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``docs`` with lang_pred and score, the posterior of that language under equal priors.

    A null text and one without a letter give ``und`` with score 0, and so does every text when
    nothing was learned; ties go to the first name. Every row is judged alone on its whole text.
    Columns of ``docs`` with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(texts: list) -> dict[str, pa.Array]:
        model = shared.value
        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        able = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)]
        some, size = [], 0
        for n, i in enumerate(able if model else []):
            some.append(i)
            size += len(texts[i])
            if size < SLAB and n + 1 < len(able):
                continue
            bits = _scorer(model).total_bits([texts[j] for j in some])
            best = bits.argmin(axis=1)
            behind = bits - bits.min(axis=1, keepdims=True)
            sure = 1.0 / np.exp2(-behind).sum(axis=1)
            for j, b, s in zip(some, best, sure):
                pred[j], score[j] = model.languages[b], float(s)
            some, size = [], 0
        return {names[0]: pa.array(pred, pa.string()), names[1]: pa.array(score, pa.float64())}

    return append_columns(docs, text_col, run, f"{names[0]} string, {names[1]} double")


def keep_identified(
    docs: DataFrame, trees: Trees | None, text_col: str = "text", least: float = 0.5
) -> DataFrame:
    """Rows of ``docs`` whose language is told with a posterior of ``least``, with their columns."""
    lang, score = private(docs, "lang", "score")
    judged = identify(docs, trees, text_col, (lang, score))
    sure = (F.col(lang) != UNKNOWN) & (F.col(score) >= least)
    return judged.where(sure).select(*[quoted(c) for c in docs.columns])


def held_out(id_col: str = "doc_id", fold: int = 0, folds: int = 5):
    """Whether crc32 of the id as text falls in the fold; false for a null id."""
    digest = F.crc32(quoted(id_col).cast("string").cast("binary"))
    return F.coalesce(digest % folds == fold, F.lit(False))
