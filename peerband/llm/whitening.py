"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become integers and each distinct one is fitted once. The covariance V is never formed:
a pass over the stored vectors adds up the centred product XᵀXQ for a thin block Q, and the driver
holds only blocks as long as a vector and as wide as Q. A Chebyshev polynomial of V, one pass a
degree, damps the part of the spectrum that is not wanted; then QR and a Rayleigh-Ritz step give
estimates, until their residuals certify the wanted components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerband.llm.common import narrow, prepare
from peerband.session import stage

COMPONENTS = 4
#: Entries are multiplied by this and floored to integers.
SCALE = 256
SEED = 13
#: Columns iterated on beyond the wanted ones, degree of the filter, steps that bound the spectrum.
EXTRA, DEGREE, BOUND_STEPS = 12, 10, 8
#: A component is certified when its residual is at most this share of the largest variance.
RESIDUAL = 2e-14
#: Residuals that no longer fall are at the rounding of the sums; they may then be this large.
STALLED = 1e-11
MOST_ROUNDS = 60
#: Variances below this share of all variance count as zero.
RANK = 1e-12
#: Bytes of the vectors stored in one row.
BLOCK_BYTES = 1 << 16
KINDS = ("<i2", "<i4", "<i8")
TOP = 2.0**63 - 1024


def integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, int64 vectors) of the usable lists of each length.

    A list with a null or non-finite entry is left out, and so are null and empty lists. Scaled
    entries beyond 64 bits stop at the largest that fits.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for width in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == width)
        rows = entries[starts[at][:, None] + np.arange(width)]
        good = np.isfinite(rows).all(axis=1)
        if good.any():
            with np.errstate(over="ignore"):
                scaled = np.floor(SCALE * rows[good])
            yield at[good], np.clip(scaled, -(2.0**63), TOP).astype(np.int64)


def _kind(rows: np.ndarray) -> np.ndarray:
    """Index of the smallest integer kind that holds each row."""
    low, high = rows.min(axis=1), rows.max(axis=1)
    fits = [(low >= np.iinfo(k).min) & (high <= np.iinfo(k).max) for k in KINDS]
    return np.argmax(fits, axis=0)


def fit_list(vectors: DataFrame) -> DataFrame:
    """(width, kind, data): each distinct integer vector of ``v`` once, many of them in a row.

    A vector's bytes tell it apart, so copies combine before the shuffle, however many there are.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, kind, raw = [], [], []
            for _, rows in integers(batch.column(0)):
                kinds = _kind(rows)
                for k in np.unique(kinds).tolist():
                    some = rows[kinds == k].astype(KINDS[k])
                    width += [rows.shape[1]] * len(some)
                    kind += [k] * len(some)
                    raw += [row.tobytes() for row in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(width, pa.int32()), pa.array(kind, pa.int32()),
                 pa.array(raw, pa.binary())],
                names=["width", "kind", "data"],
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple[int, int], list[bytes]] = {}
            for key in zip(*[c.to_pylist() for c in batch.columns]):
                groups.setdefault(key[:2], []).append(key[2])
            out = []
            for (width, kind), raw in groups.items():
                step = max(1, BLOCK_BYTES // len(raw[0]))
                out += [(width, kind, b"".join(raw[i:i + step])) for i in range(0, len(raw), step)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()),
                 pa.array([r[1] for r in out], pa.int32()),
                 pa.array([r[2] for r in out], pa.binary())],
                names=["width", "kind", "data"],
            )

    schema = "width int, kind int, data binary"
    return vectors.mapInArrow(read, schema).distinct().mapInArrow(join, schema)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield np.frombuffer(data, KINDS[kind]).reshape(-1, width)


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for rows in _blocks(batches, width):
            n += len(rows)
            # Halves of 32 bits cannot overflow when added up.
            high, low = rows.astype(np.int64) >> 32, rows.astype(np.int64) & 0xFFFFFFFF
            sums = zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist())
            total = [t + (h << 32) + x for t, (h, x) in zip(total, sums)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, width), pa.int32()),
                 pa.array([n, *total], pa.decimal128(38, 0))],
                names=["i", "s"],
            )

    added = fit.mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    sums = {r.i: int(r.s) for r in added.collect()}
    return sums[-1], [sums[i] for i in range(width)]


def _added(fit: DataFrame, width: int, mean: np.ndarray, shape: tuple[int, int],
           part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part(centred rows)``, a small matrix, over all stored vectors.

    Each task adds up its own rows; Spark adds the tasks' matrices up by row number.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape), False
        for rows in _blocks(batches, width):
            total += part(rows - mean)
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(shape[0]), pa.int32()), *map(pa.array, total.T.copy())],
                names=names,
            )

    names = ["i", *[f"q{j}" for j in range(shape[1])]]
    schema = "i int, " + ", ".join(f"{q} double" for q in names[1:])
    rows = fit.mapInArrow(add, schema).groupBy("i").agg(*[F.sum(q).alias(q) for q in names[1:]])
    out = np.zeros(shape)
    for r in rows.collect():
        out[r[0]] = r[1:]
    return out


def spectrum_floor(multiply: Callable[[np.ndarray], np.ndarray], start: np.ndarray) -> float:
    """A number below the smallest variance: the lowest Ritz value of a few Lanczos steps less the
    norm of what they leave. Only the filter's speed depends on it."""
    steps = min(BOUND_STEPS, len(start))
    basis, diagonal, beside, spare = [start / np.linalg.norm(start)], [], [], 0.0
    for _ in range(steps):
        v = basis[-1]
        w = multiply(v[:, None])[:, 0]
        diagonal.append(v @ w)
        for _ in range(2):
            for u in basis:
                w = w - (u @ w) * u
        spare = float(np.linalg.norm(w))
        if spare <= 1e-10 * abs(diagonal[0]) or len(basis) == steps:
            break
        beside.append(spare)
        basis.append(w / spare)
    inner = np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1)
    return max(0.0, float(np.linalg.eigvalsh(inner)[0] - spare))


def chebyshev(multiply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, image: np.ndarray,
              low: float, high: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V times ``block``: small on [low, high], scaled to 1 at ``top``.

    ``image`` is V times ``block``, known already, which saves the first pass.
    """
    centre, half = (high + low) / 2, (high - low) / 2
    first = half / (top - centre)
    sigma, before = first, block
    now = (image - centre * block) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        now, before = (
            (multiply(now) - centre * now) * (2 * following / half) - (sigma * following) * before,
            now,
        )
        sigma = following
    return now


@dataclass(frozen=True)
class Whitener:
    """What vectors of one length are whitened with; all of it is as long as a vector."""

    n: int
    sums: tuple[int, ...]
    variances: np.ndarray  # of the components, falling
    components: np.ndarray  # width x number of components
    trace: float
    identity_error: float
    residuals: np.ndarray  # as shares of the largest variance
    rounds: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fit_whitener(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitener:
    """The leading components of stored vectors of one length, at most ``components``.

    Directions without variance are no components. Raises where no certificate is reached.
    """
    fit = fit.where(F.col("width") == width).select("kind", "data")
    n, sums = exact_sums(fit, width)
    mean = np.array([s / n for s in sums])
    squares = _added(fit, width, mean, (1, width), lambda x: (x * x).sum(axis=0)[None])
    trace = float(squares.sum()) / n

    def multiply(block: np.ndarray) -> np.ndarray:
        return _added(fit, width, mean, block.shape, lambda x: x.T @ (x @ block)) / n

    if trace <= 0:
        empty = np.zeros((width, 0))
        return Whitener(n, tuple(sums), np.zeros(0), empty, trace, 0.0, np.zeros(0), 0)
    rng = np.random.default_rng([SEED, width])
    size = min(width, components + EXTRA)
    block = np.linalg.qr(rng.normal(size=(width, size)))[0]
    floor = spectrum_floor(multiply, rng.normal(size=width)) if size < width else 0.0
    want, worst, rounds = min(components, width), math.inf, 0
    while True:
        image = multiply(block)
        inner = block.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        off = np.linalg.norm(image - block * values, axis=0)[:want] / values[0]
        certified = off.max() <= RESIDUAL or (off.max() <= STALLED and off.max() > worst / 2)
        if certified or size == width:
            break
        if rounds == MOST_ROUNDS:
            raise ArithmeticError(f"residuals of {off.tolist()} after {rounds} rounds")
        worst, rounds = off.max(), rounds + 1
        high = float(values[-1])
        low = min(floor, high)
        if high - low > 1e-9 * values[0] and values[0] > high:
            block = chebyshev(multiply, block, image, low, high, float(values[0]), DEGREE)
        else:
            block = image  # nothing to damp: V has no more directions than the block
        block = np.linalg.qr(block)[0]
    real = int((values[:want] > RANK * trace).sum())
    top, axes = values[:real], block[:, :real]
    weights = axes / np.sqrt(top)

    def second(x: np.ndarray) -> np.ndarray:
        z = x @ weights
        return np.vstack([z.T @ z, z.sum(axis=0)])

    moments = _added(fit, width, mean, (real + 1, real), second) / n
    spread = moments[:-1] - np.outer(moments[-1], moments[-1])
    error = float(np.abs(spread - np.eye(real)).max())
    return Whitener(n, tuple(sums), top, axes, trace, error, off[:real], rounds)


def exact_deviations(rows: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """The sum over entries of (n * x - S)² of each row, exactly."""
    s = np.array(sums, dtype=object)
    most = max(abs(int(rows.min())), abs(int(rows.max())), 1)
    most_sum = max(max(map(abs, sums)), 1)
    wide = rows if most * max(most, most_sum) * rows.shape[1] < 2**63 else rows.astype(object)
    squares = (wide * wide).sum(axis=1).tolist()
    cross = (wide @ (s.astype(np.int64) if wide is rows else s)).tolist()
    own = sum(x * x for x in sums)
    return [n * n * a - 2 * n * b + own for a, b in zip(squares, cross)]


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained,
    identity_error.

    A vector that is null or empty or has a null or non-finite entry is dropped. Entries x are
    floor(256 * entry), at most what 64 bits hold. The fit list has each distinct x once: n of them,
    with sums S. ``deviation`` is the exact sum of (n * x - S)² as decimal(38,0), null where that
    is too large for 38 digits; ``whitened`` is the centred x along a unit eigenvector of the fit
    list's covariance, divided by the square root of its variance; ``explained`` is its share of
    all variance and ``identity_error`` the largest entry of the whitened covariance minus the
    identity, measured in a pass of its own. Components are numbered from 1 by falling variance;
    directions without variance are none, so equal vectors give no rows. Vectors of different
    lengths are fitted apart. Ids may be null or repeat: rows with equal vectors get equal answers.
    Other columns are ignored; an empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    source = narrow(vectors, id=id_col, v=vector_col).select(
        "id", F.col("v").cast("array<double>").alias("v")
    )
    fit = stage(fit_list(source.select("v")), "fit_list")
    widths = sorted(r.width for r in fit.select("width").distinct().collect())
    models = {w: fit_whitener(fit, w, components) for w in widths}
    id_type = source.schema["id"].dataType.simpleString()
    schema = (f"id {id_type}, component int, n bigint, deviation decimal(38,0), whitened double,"
              " explained double, identity_error double")
    names = [c.split()[0] for c in schema.split(", ")]
    most = 10**38

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in integers(batch.column(1)):
                model = models[rows.shape[1]]
                k = len(model.variances)
                if not k:
                    continue
                far = [d if d < most else None
                       for d in exact_deviations(rows, model.n, model.sums)]
                white = ((rows - model.mean) @ model.components) / np.sqrt(model.variances)
                size = len(at) * k
                each = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(at, k))),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                     pa.array(np.full(size, model.n)),
                     pa.array(far, pa.decimal128(38, 0)).take(each),
                     pa.array(white.ravel()),
                     pa.array(np.tile(model.variances / model.trace, len(at))),
                     pa.array(np.full(size, model.identity_error))],
                    names=names,
                )

    return source.mapInArrow(project, schema)


