"""Product sums of a model's columns per group, from one scan and one exchange.

A design has dense columns of numbers and factors, whose levels stand for indicator columns that
are never made. Each row is dealt into one entry per dense column, one per factor level it holds
and one per pair of them; an entry carries the row's dense values once more and is summed against
them by its key. So an indicator's products with numbers are sums per level, and two indicators'
product is a count per pair of levels. No plan grows faster than the number of columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerband.functions.buckets import quoted
from peerband.session import stage

#: Dense values an entry is summed against at once; wider rows are dealt to several.
BLOCK = 64
#: The normal equations are solved on the driver, so a model cannot have more columns.
MOST_COLUMNS = 4000
RANK_TOLERANCE = 1e-11

#: Factor columns, each with its levels that have an indicator and the indicator's name.
Factors = Mapping[str, Mapping[str, str]]


def entries(features: DataFrame, dense: Sequence[Column], factors: Sequence[Column],
            group: Column) -> DataFrame:
    """(g, d, a, la, b, lb, x): what each row adds. ``d`` has the dense values and a final 1.

    Entry ``a`` below the number of dense columns is that column, the next one is the constant,
    and each later one a factor at level ``la``; ``b`` and ``lb`` name the second of a pair.
    """
    m = len(dense)
    base = features.select(
        group.alias("g"), F.array(*dense, F.lit(1.0)).alias("d"),
        *[c.cast("string").alias(f"f{k}") for k, c in enumerate(factors)],
    )
    none = "cast(null as string)"

    def entry(a, la, b, lb, x):
        return f"named_struct('a', {a}, 'la', {la}, 'b', {b}, 'lb', {lb}, 'x', {x})"

    made = [entry(i, none, -1, none, f"d[{i}]") for i in range(m + 1)]
    for k in range(len(factors)):
        made.append(entry(m + 1 + k, f"f{k}", -1, none, "1.0D"))
        for h in range(k + 1, len(factors)):
            both = f"if(f{h} is null, null, f{k})"
            made.append(entry(m + 1 + k, both, m + 1 + h, f"f{h}", "1.0D"))
    return (
        base.select("g", "d", F.expr(f"explode(array({', '.join(made)})) as e"))
        .select("g", "d", "e.*")
        .where((F.col("a") <= m) | F.col("la").isNotNull())
    )


def group_moments(features: DataFrame, dense: Sequence[Column], factors: Sequence[Column],
                  group: Column) -> DataFrame:
    """(g, a, la, b, lb, block, s): entry times each dense value, summed over the group's rows.

    ``s`` holds ``BLOCK`` dense values from the block's place on. Sums combine before the exchange,
    so a group with most rows is harmless.
    """
    width = len(dense) + 1
    blocks = -(-width // BLOCK)
    rows = entries(features, dense, factors, group)
    if blocks > 1:
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    else:
        rows = rows.withColumn("block", F.lit(0))
    each = range(min(width, BLOCK))
    at = (lambda k: f"get(d, block * {BLOCK} + {k})") if blocks > 1 else (lambda k: f"d[{k}]")
    return rows.groupBy("g", "a", "la", "b", "lb", "block").agg(
        *[F.expr(f"sum(x * {at(k)}) as s{k}") for k in each]
    ).select("g", "a", "la", "b", "lb", "block", F.array(*[f"s{k}" for k in each]).alias("s"))


@dataclass(frozen=True)
class Moments:
    """Products of named columns, the last of which is the target; as wide as the model."""

    names: tuple[str, ...]
    n: int
    groups: int
    first_group: str | None
    total: np.ndarray  # products about the overall mean
    within: np.ndarray  # products about the group means
    means: np.ndarray
    sums: DataFrame  # (g, name, v): the columns' sums per group, and the rows under name NULL

    def only(self, names: Sequence[str]) -> Moments:
        """The same with only some columns and the target: a nested design needs no scan."""
        at = [self.names.index(c) for c in [*names, self.names[-1]]]
        cut = np.ix_(at, at)
        return Moments(
            tuple(self.names[i] for i in at), self.n, self.groups, self.first_group,
            self.total[cut], self.within[cut], self.means[at], self.sums,
        )


def design_moments(features: DataFrame, names: Sequence[str], target: Column, group: Column,
                   factors: Factors | None = None) -> Moments:
    """Moments of the columns ``names`` and a target.

    A name is an indicator of ``factors``, or else a column of numbers. A level that is NULL or has
    no indicator is the baseline. What comes to the driver is as wide as the model, whatever the
    number of groups: products of every two columns.
    """
    factors = factors or {}
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"{len(names)} columns; normal equations have at most {MOST_COLUMNS}")
    indicators = {name for levels in factors.values() for name in levels.values()}
    numbers = [c for c in names if c not in indicators]
    columns = [*[quoted(c).cast("double") for c in numbers], target]
    # Typical values are subtracted first, which keeps the later subtraction accurate.
    centre = features.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shifts = np.array([v or 0.0 for v in centre])
    shifted = [c - F.lit(float(s)) for c, s in zip(columns, shifts)]
    levels = [
        F.when(quoted(f).isin(list(known)), quoted(f)) for f, known in factors.items()
    ]
    moments = stage(group_moments(features, shifted, levels, group), "moments")

    m = len(columns)
    own = [*numbers, None]  # the target has no name, the constant comes after it
    index = {(i, None): i for i in range(m + 1)}
    for k, known in enumerate(factors.values()):
        for level, name in known.items():
            index[m + 1 + k, level] = len(index)
            own.append(name)
    size = len(index)
    raw = np.zeros((size, size))
    each = range(min(m + 1, BLOCK))
    for r in moments.groupBy("a", "la", "b", "lb", "block").agg(
        *[F.expr(f"sum(s[{k}]) as s{k}") for k in each]
    ).collect():
        i = index[r["a"], r["la"]]
        if r["b"] >= 0:
            j = index[r["b"], r["lb"]]
            if r["block"] == m // BLOCK:
                raw[i, j] = raw[j, i] = r[f"s{m % BLOCK}"]
            continue
        for k in each:
            j = r["block"] * BLOCK + k
            if j <= m:
                raw[i, j] = raw[j, i] = r[f"s{k}"]
        if i > m:
            raw[i, i] = raw[i, m]
    n = int(round(raw[m, m]))
    if n == 0:
        raise ValueError("no rows to fit")

    # Column sums per group; a group's list is at most as long as the model is wide.
    sums = moments.where(F.expr(f"b < 0 and block = {m // BLOCK}")).select(
        "g", "a", "la", F.col("s")[m % BLOCK].alias("v")
    )
    lists = sums.groupBy("g").agg(
        F.collect_list(F.struct("a", "la", "v")).alias("e"),
        F.max(F.expr(f"if(a = {m}, v, null)")).alias("n"),
    )
    pairs = (
        lists.select("g", "n", "e", F.explode("e").alias("l"))
        .select("g", "n", "l", F.explode("e").alias("r"))
        .where("l.a < r.a or (l.a = r.a and (l.la is null or l.la <= r.la))")
        .groupBy("l.a", "l.la", F.col("r.a").alias("b"), F.col("r.la").alias("lb"))
        .agg(F.expr("sum(l.v * r.v / n) as v"), F.count(F.lit(1)).alias("groups"),
             F.min("g").alias("first"))
    )
    between, groups, first = np.zeros((size, size)), 0, None
    for r in pairs.collect():
        i, j = index[r["a"], r["la"]], index[r["b"], r["lb"]]
        between[i, j] = between[j, i] = r["v"]
        if i == j == m:
            groups, first = r["groups"], r["first"]

    place = {name: i for i, name in enumerate(own) if name is not None and i < m - 1}
    place |= {name: m + 1 + i for i, name in enumerate(own[m:])}
    order = [*[place[c] for c in names], m - 1]
    whole = raw - np.outer(raw[m], raw[m]) / n
    inside = raw - between
    cut = np.ix_(order, order)
    means = raw[m] / n
    means[:m] += shifts
    named = [(i, None, c, float(s)) for i, (c, s) in enumerate(zip([*numbers, ""], shifts))]
    named += [(m, None, None, 0.0)]
    named += [(m + 1 + k, level, name, 0.0)
              for k, known in enumerate(factors.values()) for level, name in known.items()]
    table = features.sparkSession.createDataFrame(
        named, "na int, nla string, name string, shift double"
    )
    # At most as many rows as the model has columns.
    labelled = sums.join(
        F.broadcast(table), F.expr("a = na and la <=> nla")
    ).select("g", "name", "v", "shift")
    return Moments(
        (*names, ""), n, groups, first, whole[cut], inside[cut], means[order], labelled
    )


def group_levels(moments: Moments, effects: Sequence[float]) -> DataFrame:
    """(neighbourhood, n, level): a group's mean target less what its mean columns explain."""
    weights = dict(zip(moments.names[:-1], [-float(b) for b in effects])) | {"": 1.0}
    table = moments.sums.sparkSession.createDataFrame(
        list(weights.items()), "wname string, weight double"
    )
    joined = moments.sums.join(F.broadcast(table), F.col("name") == F.col("wname"), "left")
    return joined.groupBy(F.col("g").alias("neighbourhood")).agg(
        F.round(F.max(F.expr("if(name is null, v, null)"))).cast("bigint").alias("n"),
        F.expr(
            "sum(weight * v) / max(if(name is null, v, null)) + sum(weight * shift)"
        ).alias("level"),
    )


def pseudo_inverse(gram: np.ndarray) -> tuple[np.ndarray, int]:
    """Minimum-norm inverse and rank of a Gram matrix, judged on its correlation scale."""
    scale = np.sqrt(np.clip(np.diag(gram), 0.0, None))
    live = scale > 1e-9 * (scale.max() if scale.size else 0.0)
    inverse = np.zeros_like(gram)
    if not live.any():
        return inverse, 0
    s = scale[live]
    values, vectors = np.linalg.eigh(gram[np.ix_(live, live)] / np.outer(s, s))
    good = values > RANK_TOLERANCE * values.max()
    part = (vectors[:, good] / values[good]) @ vectors[:, good].T
    inverse[np.ix_(live, live)] = part / np.outer(s, s)
    return inverse, int(good.sum())


@dataclass(frozen=True)
class Solution:
    """A design's normal equations solved within groups."""

    names: tuple[str, ...]
    effects: np.ndarray
    inverse: np.ndarray
    rank: int
    freedom: int
    sse: float
    r2: float | None  # None where the target is constant
    adj_r2: float | None  # or no freedom is left


def solve(moments: Moments, sse: float | None = None) -> Solution:
    """Effects, and the quality that ``sse`` (else the one the products give) stands for."""
    inverse, rank = pseudo_inverse(moments.within[:-1, :-1])
    effects = inverse @ moments.within[:-1, -1]
    if sse is None:
        sse = max(0.0, float(moments.within[-1, -1] - effects @ moments.within[:-1, -1]))
    freedom = moments.n - rank - moments.groups
    sst = float(moments.total[-1, -1])
    r2 = 1.0 - sse / sst if sst > 0 else None
    adj = 1.0 - (sse / freedom) / (sst / (moments.n - 1)) if freedom > 0 and sst > 0 else None
    return Solution(moments.names[:-1], effects, inverse, rank, freedom, sse, r2, adj)


def vif_values(total: np.ndarray) -> list[float | None]:
    """Variance inflation per column, without fixed effects.

    NULL for a constant column, and for one the others reproduce exactly: of the null space of the
    correlations it has a part, and the others' inverse diagonal is as if the rest were gone.
    """
    p = len(total)
    out: list[float | None] = [None] * p
    scale = np.sqrt(np.clip(np.diag(total), 0.0, None))
    live = np.flatnonzero(scale > 1e-12 * max(1.0, scale.max(initial=0.0)))
    if not len(live):
        return out
    s = scale[live]
    values, vectors = np.linalg.eigh(total[np.ix_(live, live)] / np.outer(s, s))
    good = values > RANK_TOLERANCE * values.max()
    lost = (vectors[:, ~good] ** 2).sum(axis=1)
    inflation = (vectors[:, good] ** 2 / values[good]).sum(axis=1)
    for at, gone, v in zip(live, lost, inflation):
        out[at] = float(v) if gone < 1e-6 and v < 1e12 else None
    return out
