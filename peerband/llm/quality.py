"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is encoded from what
its bytes look like; gated attention weighs the passages; the weighted sum of their encodings is
scored. Encoder, attention and score are learned together from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerband.llm.common import append_columns, narrow, prepare, private, quoted

#: Bytes of a passage; the last one of a text may be shorter.
PASSAGE = 512
#: Labelled documents that the classifier is fitted on, on average.
SAMPLE_DOCUMENTS = 4000
#: Bytes encoded at once.
SLAB = 1 << 19
HIDDEN, GATE, EPOCHS, BATCH, STEP, DECAY = 24, 12, 40, 128, 0.01, 1e-4
#: Kinds of bytes: other, lower, upper, digit, blank, line end, sentence marks, symbols, beyond ASCII.
KINDS = 9
LAGS = (1, 2, 3)
WIDTH = KINDS * KINDS + len(LAGS) + 4


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[ord("a"):ord("z") + 1] = 1
    kind[ord("A"):ord("Z") + 1] = 2
    kind[ord("0"):ord("9") + 1] = 3
    kind[[32, 9]] = 4
    kind[[10, 13]] = 5
    kind[[ord(c) for c in ".,;:?'\"-()"]] = 6
    kind[[c for c in range(33, 127) if kind[c] == 0]] = 7
    kind[128:] = 8
    return kind


_KIND = _kinds()


def passage_features(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features of consecutive passages of ``raw`` that begin at ``starts``; none may be empty.

    Shares of neighbouring kinds of bytes, of words equal to the word one to three before, the
    share and mean length of words, of words that end in a symbol, and of long words. A passage's
    features depend on its own bytes only.
    """
    n = len(starts)
    size = np.diff(np.append(starts, len(raw)))
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    kind = _KIND[raw]
    out = np.zeros((n, WIDTH), np.float32)
    inside = owner[1:] == owner[:-1]
    pair = (kind[:-1].astype(np.int32) * KINDS + kind[1:] + owner[:-1] * (KINDS * KINDS))[inside]
    out[:, : KINDS * KINDS] = np.bincount(pair, minlength=n * KINDS * KINDS).reshape(n, -1)
    out[:, : KINDS * KINDS] /= np.maximum(size - 1, 1)[:, None]
    blank = (kind == 4) | (kind == 5)
    begins = ~blank
    begins[1:] &= blank[:-1] | ~inside
    first = np.flatnonzero(begins)
    if len(first):
        # The last byte of each word: just before a blank, or where the passage ends.
        stop = ~blank
        stop[:-1] &= blank[1:] | ~inside
        last = np.flatnonzero(stop)
        length = last - first + 1
        at = np.arange(len(raw), dtype=np.int64)
        word = np.cumsum(begins) - 1
        power = (at - first[np.maximum(word, 0)]).astype(np.uint64)
        term = (raw.astype(np.uint64) + np.uint64(1)) * (
            power * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        )
        term[blank] = 0
        code = np.add.reduceat(term, first)
        place = owner[first]
        count = np.bincount(place, minlength=n)
        words = np.maximum(count, 1)
        col = KINDS * KINDS
        for lag in LAGS:
            same = np.zeros(len(code), bool)
            same[lag:] = (code[lag:] == code[:-lag]) & (place[lag:] == place[:-lag])
            out[:, col] = np.bincount(place[same], minlength=n) / words
            col += 1
        out[:, col] = count / size
        out[:, col + 1] = np.log1p(np.bincount(place, weights=length, minlength=n) / words)
        out[:, col + 2] = np.bincount(place[kind[last] == 7], minlength=n) / words
        out[:, col + 3] = np.bincount(place[length > 24], minlength=n) / words
    return out


def passages(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, features) of all passages, in slabs; an empty text has one of zeros."""
    parts, owners, size = [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(parts), np.uint8)
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        full = length > 0
        features = np.zeros((len(parts), WIDTH), np.float32)
        if full.any():
            features[full] = passage_features(raw, (np.cumsum(length) - length)[full])
        return np.array(owners), features

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(len(raw), 1), PASSAGE):
            parts.append(raw[at:at + PASSAGE])
            owners.append(i)
            size += PASSAGE
            if size >= SLAB:
                yield flush()
                parts, owners, size = [], [], 0
    if parts:
        yield flush()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Classifier:
    """Scaling, encoder, gated attention and output weights."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def encode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of passages and their unscaled attention weights."""
        w = self.weights
        x = np.clip((features - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["W"] + w["b"])
        a = (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["w"]
        return h, np.exp(np.clip(a, -40, 40))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        top = np.zeros((len(texts), HIDDEN))
        total = np.zeros(len(texts))
        for owner, features in passages(texts):
            h, weight = self.encode(features)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            top[owner[first]] += np.add.reduceat(h * weight[:, None], first, axis=0)
            total[owner[first]] += np.add.reduceat(weight, first)
        z = top / np.maximum(total, 1e-300)[:, None]
        return _sigmoid(z @ self.weights["c"] + self.weights["c0"])


def slopes(
    w: dict[str, np.ndarray], x: np.ndarray, size: np.ndarray, labels: np.ndarray
) -> dict[str, np.ndarray]:
    """Gradient of the mean cross entropy of bags of ``size`` scaled passages each, in a row."""
    first = np.cumsum(size) - size
    bag = np.repeat(np.arange(len(size)), size)
    h = np.tanh(x @ w["W"] + w["b"])
    v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    a = np.exp((v * u) @ w["w"])
    alpha = a / np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(h * alpha[:, None], first, axis=0)
    error = (_sigmoid(z @ w["c"] + w["c0"]) - labels) / len(size)
    dz = error[:, None] * w["c"]
    pull = (dz[bag] * h).sum(axis=1)
    da = alpha * (pull - np.add.reduceat(alpha * pull, first)[bag])
    dg = da[:, None] * w["w"]
    dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
    dh = (alpha[:, None] * dz[bag] + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du,
            "w": (v * u).T @ da, "c": z.T @ error, "c0": error.sum(keepdims=True)}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Classifier:
    """Fit on feature bags and 0/1 labels by minibatch Adam, the same way every time."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate(bags).astype(np.float64)
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    bags = [np.clip((b - mean) / scale, -8, 8) for b in bags]

    def start(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    w = {"W": start(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": start(HIDDEN, GATE),
         "U": start(HIDDEN, GATE), "w": start(GATE), "c": start(HIDDEN), "c0": np.zeros(1)}
    slow = {k: np.zeros_like(v) for k, v in w.items()}
    fast = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            x = np.concatenate([bags[i] for i in chosen])
            size = np.array([len(bags[i]) for i in chosen])
            slope = slopes(w, x, size, labels[chosen])
            step += 1
            for k in w:
                g = slope[k] + DECAY * w[k]
                slow[k] = 0.9 * slow[k] + 0.1 * g
                fast[k] = 0.999 * fast[k] + 0.001 * g * g
                w[k] -= STEP * (slow[k] / (1 - 0.9**step)) / (
                    np.sqrt(fast[k] / (1 - 0.999**step)) + 1e-8)
    return Classifier(mean, scale, w)


def held_out(id_col: str = "doc_id", fold: int = 1, folds: int = 3):
    """Whether crc32 of the id as text falls in the fold; false for a null id."""
    digest = F.crc32(quoted(id_col).cast("string").cast("binary"))
    return F.coalesce(digest % folds == fold, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample: int = SAMPLE_DOCUMENTS,
) -> Classifier | None:
    """A classifier fitted on labelled documents; None where there are none of both labels.

    Of more labelled ids, those whose hash falls below the share that gives ``sample`` are used.
    A label that repeats for an id counts as 1 if any is 1. Only the features of these documents'
    passages reach the driver, those of all passages of each.
    """
    prepare(docs.sparkSession)
    known = narrow(labels, id=id_col, label=label_col).where("id is not null and label is not null")
    n = known.count()
    if not n:
        return None
    spread = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(spread < sample / n).groupBy("id").agg(
        (F.max("label") > 0).cast("int").alias("label")
    )
    rows = narrow(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                bag = np.concatenate([f for _, f in passages([text])])
                found.append(bag.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(2), pa.array(found)],
                names=["id", "label", "bag"],
            )

    bags = rows.select("id", "text", "label").mapInArrow(
        run, "id string, label int, bag binary"
    ).collect()
    bags.sort(key=lambda r: (r.id, r.bag))
    target = np.array([r.label for r in bags], np.float64)
    if len(set(target)) < 2:
        return None
    return fit([np.frombuffer(r.bag, "<f4").reshape(-1, WIDTH) for r in bags], target)


def score_quality(
    docs: DataFrame, model: Classifier | None, text_col: str = "text",
    names: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on), or as ``names`` calls them.

    Every passage of every text counts; a null text counts as empty, which is one passage of
    zeros. Without a model every score is 0.5. Rows are judged alone; nothing is shuffled. Columns
    of ``docs`` with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> dict[str, pa.Array]:
        model = shared.value
        found = model.scores(texts) if model and texts else np.full(len(texts), 0.5)
        return {names[0]: pa.array(found.astype(np.float64)),
                names[1]: pa.array((found >= 0.5).astype(np.int32))}

    return append_columns(docs, text_col, run, f"{names[0]} double, {names[1]} int")


def keep_quality(docs: DataFrame, model: Classifier | None, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the classifier predicts as 1, with their columns; all without one."""
    score, predicted = private(docs, "score", "predicted")
    scored = score_quality(docs, model, text_col, (score, predicted))
    return scored.where(F.col(predicted) == 1).select(*[quoted(c) for c in docs.columns])
