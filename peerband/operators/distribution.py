"""Exact order statistics over grouped values, whatever the sizes of the groups.

All of them start from a value histogram (one row per group and distinct value, combined
map-side). It is stored in ranges of (group, value), so a group of any size is dealt to as many
ranges as its share of the rows asks for. Ranges are added up per group, and only rows of one range
are ever ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerband.session import stage


def histogram(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Rows of (keys, value, weight) for the non-NULL values of each group."""
    return (
        df.select(*keys, value.alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def _names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], kept: Sequence[str],
              how: str = "left") -> DataFrame:
    """Join on ``keys`` with NULL matching NULL, adding the ``kept`` columns of ``right``.

    Adaptive execution picks the join from measured sizes.
    """
    right = right.selectExpr(*[f"`{k}` as `_r_{k}`" for k in keys], *[f"`{c}`" for c in kept])
    same = F.expr(" and ".join(f"`{k}` <=> `_r_{k}`" for k in keys))
    return left.join(right, same, how).drop(*[f"_r_{k}" for k in keys])


def value_ranges(hist: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The histogram stored in value ranges, and what each range holds of each group.

    Rows gain ``_part``, their range. The second table has ``_start`` (weight of the group below
    the range), ``_n`` (in the range) and ``total`` per (keys, _part); a group has one row for each
    range it reaches into.
    """
    rows = stage(
        hist.repartitionByRange(*[F.col(f"`{k}`") for k in keys], "value").withColumn(
            "_part", F.spark_partition_id()
        ),
        "ranges",
    )
    group = f"partition by {_names(keys) or '0'}"
    earlier = f"over ({group} order by _part rows between unbounded preceding and 1 preceding)"
    held = rows.groupBy(*keys, "_part").agg(F.sum("weight").alias("_n")).selectExpr(
        "*",
        f"coalesce(sum(_n) {earlier}, 0) as _start",
        f"sum(_n) over ({group}) as total",
    )
    return rows, held


def _below(rows: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` of the ranges in ``held`` with the group's weight below each value, and its total."""
    spots = [*keys, "_part"]
    joined = join_same(rows, held, spots, ["_start", "total"], how="inner")
    return joined.selectExpr(
        "* except (_start, _part)",
        f"_start + coalesce(sum(weight) over (partition by {_names(spots)} order by value"
        " rows between unbounded preceding and 1 preceding), 0) as below",
    )


def ranked_values(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``below`` (weight strictly under the value in its group) and ``total``.

    ``hist`` has one row per (keys, value) and a ``weight``; other columns pass through.
    """
    rows, held = value_ranges(hist, keys)
    return _below(rows, held, list(keys)).select(
        *[F.col(f"`{c}`") for c in hist.columns], "below", "total"
    )


def histogram_quantiles(hist: DataFrame, keys: Sequence[str], probs: dict[str, float],
                        also: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated exact quantiles per group from a histogram.

    Output: keys, ``n``, one column per entry of ``probs``, and any ``also`` aggregates, given
    as "expression as name".
    """
    return range_quantiles(*value_ranges(hist, keys), keys, probs, also)


def range_quantiles(rows: DataFrame, held: DataFrame, keys: Sequence[str],
                    probs: dict[str, float], also: Sequence[str] = ()) -> DataFrame:
    """``histogram_quantiles`` of stored ranges. Only those that hold a wanted rank are ordered."""
    keys = list(keys)
    wanted, picks = _rank_picks(probs)
    values = _below(rows, held.where(wanted), keys).groupBy(*keys).agg(*map(F.expr, picks))
    sums = rows.groupBy(*keys).agg(
        *map(F.expr, ("coalesce(sum(weight), 0) as n", *also))
    )
    extra = sums.columns[len(keys) + 1:]
    made = [c for c in values.columns if c not in keys]
    if keys:
        joined = join_same(sums, values, keys, made)
    else:
        joined = sums.withColumn("_v", values.select(F.struct(*made)).scalar()).select(
            *sums.columns, "_v.*"
        )
    return joined.selectExpr(
        *[f"`{k}`" for k in keys],
        "n",
        *_between(probs),
        *[f"`{c}`" for c in extra],
    )


#: Slices of a group's span of values in which its wanted ranks are looked for.
SLICES = 1024


def selected_quantiles(df: DataFrame, keys: Sequence[str], value: Column,
                       probs: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` of a stored table for few ranks: (keys, n, quantiles).

    Rows are counted by slices of their group's span, and only values of the slices that hold a
    wanted rank are grouped and ordered. Values in one slice all the same cost what
    ``exact_quantiles`` does. ``df`` is read three times; there is at least one key.
    """
    keys = list(keys)
    spots = [*keys, "_slice"]
    rows = df.select(*[F.col(f"`{k}`") for k in keys], value.cast("double").alias("value")).where(
        F.col("value").isNotNull()
    )
    spans = stage(
        rows.groupBy(*[F.col(f"`{k}`") for k in keys])
        .agg(F.min("value").alias("_least"), F.max("value").alias("_most")),
        "spans",
    )
    # Never falls as the value rises; without a finite span all or most values share a slice.
    share = "nanvl(coalesce(try_divide(value - _least, _most - _least), 0D), 1D)"
    sliced = join_same(rows, spans, keys, ["_least", "_most"], how="inner").selectExpr(
        *[f"`{k}`" for k in keys], "value",
        f"cast(floor(least({share}, 1D) * {SLICES - 1}) as int) as _slice",
    )
    counts = stage(
        sliced.groupBy(*[F.col(f"`{k}`") for k in spots]).agg(F.count(F.lit(1)).alias("_n")),
        "slices",
    )
    group = f"partition by {_names(keys)}"
    earlier = f"over ({group} order by _slice rows between unbounded preceding and 1 preceding)"
    wanted, picks = _rank_picks(probs)
    held = stage(
        counts.selectExpr(
            "*", f"coalesce(sum(_n) {earlier}, 0) as _start", f"sum(_n) over ({group}) as total"
        ).where(wanted),
        "held_slices",
    )
    few = histogram(join_same(sliced, held, spots, [], how="inner"), spots, F.col("value"))
    ranked = join_same(
        ranked_values(few, spots).drop("total"), held, spots, ["_start", "total"], how="inner"
    ).selectExpr("* except (below)", "_start + below as below")
    found = ranked.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.max("total").alias("n"), *map(F.expr, picks)
    )
    return found.selectExpr(*[f"`{k}`" for k in keys], "n", *_between(probs))


def _rank_picks(probs: dict[str, float]) -> tuple[str, list[str]]:
    """The condition that a range holds a rank around a quantile, and the aggregates that pick
    the values of these ranks."""

    def spot(p):
        return f"({float(p)!r}D * (total - 1))"

    ends = {name: (f"floor({spot(p)})", f"ceil({spot(p)})") for name, p in probs.items()}
    wanted = " or ".join(
        f"(_start <= {end} and {end} < _start + _n)" for pair in ends.values() for end in pair
    )

    def at(rank):
        return f"max(if(below <= {rank} and {rank} < below + weight, value, null))"

    picks = []
    for name, p in probs.items():
        low, high = ends[name]
        picks += [
            f"{at(low)} as `_lo_{name}`",
            f"{at(high)} as `_hi_{name}`",
            f"max({spot(p)} - floor({spot(p)})) as `_part_{name}`",
        ]
    return wanted, picks


def _between(probs: dict[str, float]) -> list[str]:
    return [f"`_lo_{q}` + (`_hi_{q}` - `_lo_{q}`) * `_part_{q}` as `{q}`" for q in probs]


#: Distinct values that a full leaf of a ladder holds at least.
LEAF_VALUES = 64
#: Halvings of a search in an array: enough for 2 ** 20 entries, so for groups of 2 ** 40 values.
SEARCH_STEPS = 20


def ladders(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaves (id, keys, low, n, sum, squares, steps, cum) in which a value's rank can be read off.

    ``rows`` has keys without NULLs, a ``value`` (double) and a positive ``weight``, any number of
    rows for one value; it is read three times, so it should start from a stored table. Rows are
    ranged by (keys, value) and sorted there once, and one pass over each range cuts them into
    leaves: consecutive distinct values of a group, about the square root of its rows and
    ``LEAF_VALUES`` at least, so neither a leaf nor a group's list of leaves grows as fast as the
    group. A range begins a leaf of its own; equal values are never apart.

    ``id`` is unique. ``steps`` has the leaf's values in order and ``cum[i]`` its weight below step
    i; one more entry has the weight of all. ``sum`` is the weighted sum of the values and
    ``squares`` that of their squared distances from the leaf's mean.
    """
    keys = list(keys)
    size = F.greatest(F.lit(LEAF_VALUES), F.ceil(F.sqrt(F.count(F.lit(1))))).cast("bigint")
    # A group is a number from here on: rows that are moved, sorted and cut hold no keys.
    groups = stage(
        rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(size.alias("size"))
        .withColumn("group", F.monotonically_increasing_id()),
        "leaf_groups",
    )
    numbered = join_same(
        rows.select(*[F.col(f"`{k}`") for k in keys], "value", "weight"),
        groups, keys, ["group", "size"], how="inner",
    ).select("group", "size", "value", "weight")
    dealt = numbered.repartitionByRange("group", "value").sortWithinPartitions("group", "value")

    def cut(batches):
        from itertools import chain

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 40

        def starts(changed):
            return np.flatnonzero(np.concatenate([[True], changed]))

        def leaves(ids, table, value, weight, first, stop):
            """The leaves that begin at ``first``, of the rows before ``stop``."""
            value, weight = value[:stop], weight[:stop]
            length = np.diff(first, append=stop)
            upto = np.cumsum(weight)
            n = np.add.reduceat(weight, first)
            leaf = np.repeat(np.arange(len(first)), length)
            below = upto - weight - np.repeat((upto - weight)[first], length)
            cum = np.empty(stop + len(first), np.int64)
            cum[np.arange(stop) + leaf] = below
            cum[first + length + np.arange(len(first))] = n
            with np.errstate(all="ignore"):
                total = np.add.reduceat(value * weight, first)
                apart = value - np.repeat(total / n, length)
                squares = np.add.reduceat(apart * apart * weight, first)
            ends = np.concatenate([[0], first + length]).astype(np.int32)
            spots = np.arange(len(ends), dtype=np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids + np.arange(len(first))),
                 table.column(0).take(pa.array(first)),
                 pa.array(value[first]), pa.array(n), pa.array(total), pa.array(squares),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(value)),
                 pa.ListArray.from_arrays(pa.array(ends + spots), pa.array(cum))],
                names=["id", "group", "low", "n", "sum", "squares", "steps", "cum"],
            )

        held = None  # rows of the leaf that the next batch may go on with, one for each value
        for batch in chain(batches, [None]):
            some = [b for b in (held, batch) if b is not None and b.num_rows]
            if not some:
                continue
            # By arrays: fields of the same type may differ in whether they are nullable.
            table = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(c) for c in zip(*[b.columns for b in some])],
                names=["group", "size", "value", "weight"],
            )
            number = table.column(0).to_numpy()
            other = number[1:] != number[:-1]
            value = table.column(2).to_numpy()
            run = starts(other | (value[1:] != value[:-1]))
            weight = np.add.reduceat(table.column(3).to_numpy(), run)
            value, group = value[run], np.isin(run, starts(other), assume_unique=True)
            begins = np.flatnonzero(group)
            place = np.arange(len(run)) - np.repeat(begins, np.diff(begins, append=len(run)))
            first = np.flatnonzero(place % table.column(1).to_numpy()[run] == 0)
            table = table.take(pa.array(run))
            if batch is None:
                yield leaves(made, table, value, weight, first, len(run))
                return
            stop = int(first[-1])
            held = pa.RecordBatch.from_arrays(
                [*[c.slice(stop) for c in table.columns[:-1]], pa.array(weight[stop:])],
                names=table.schema.names,
            )
            if stop:
                yield leaves(made, table, value, weight, first[:-1], stop)
                made += len(first) - 1

    made = dealt.mapInArrow(
        cut,
        "id bigint, group bigint, low double, n bigint, sum double, squares double,"
        " steps array<double>, cum array<bigint>",
    )
    named = groups.select(F.col("group").alias("_group"), *[F.col(f"`{k}`") for k in keys])
    return made.join(named, F.col("group") == F.col("_group")).select(
        "id", *[F.col(f"`{k}`") for k in keys], "low", "n", "sum", "squares", "steps", "cum"
    )


def ladder_index(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored leaves without their values, with ``start`` (the group's weight below the leaf) and
    ``total`` (all of it)."""
    group = f"partition by {_names(keys)}"
    return leaves.drop("steps", "cum").selectExpr(
        "*",
        f"coalesce(sum(n) over ({group} order by low rows between unbounded preceding and"
        " 1 preceding), 0) as start",
        f"sum(n) over ({group}) as total",
    )


def ladder_quantiles(leaves: DataFrame, index: DataFrame, keys: Sequence[str],
                     probs: dict[str, float], also: Sequence[str] = ()) -> DataFrame:
    """``histogram_quantiles`` read off leaves; ``also`` aggregates rows of the index."""
    keys = list(keys)

    def spot(p):
        return f"({float(p)!r}D * (total - 1))"

    ends = {name: (f"floor({spot(p)})", f"ceil({spot(p)})") for name, p in probs.items()}
    wanted = " or ".join(
        f"(start <= {end} and {end} < start + n)" for pair in ends.values() for end in pair
    )

    def at(rank):
        place = f"aggregate(cum, -1, (i, x) -> i + if(x <= {rank} - start, 1, 0))"
        return f"max(if(start <= {rank} and {rank} < start + n, get(steps, {place}), null))"

    picks = []
    for name, p in probs.items():
        low, high = ends[name]
        picks += [
            f"{at(low)} as `_lo_{name}`", f"{at(high)} as `_hi_{name}`",
            f"max({spot(p)} - floor({spot(p)})) as `_part_{name}`",
        ]
    held = index.where(wanted).select(*[F.col(f"`{k}`") for k in keys], "id", "n", "start", "total")
    values = held.join(leaves.select("id", "steps", "cum"), "id").groupBy(*keys).agg(
        *map(F.expr, picks)
    )
    sums = index.groupBy(*keys).agg(*map(F.expr, ("sum(n) as n", *also)))
    joined = join_same(sums, values, keys, [c for c in values.columns if c not in keys])
    return joined.selectExpr(
        *[f"`{k}`" for k in keys],
        "n",
        *[f"`_lo_{q}` + (`_hi_{q}` - `_lo_{q}`) * `_part_{q}` as `{q}`" for q in probs],
        *[f"`{c}`" for c in sums.columns[len(keys) + 1:]],
    )


def search(steps: str, value: str, below: str) -> str:
    """How many entries of the sorted array ``steps`` are ``below`` ("<" or "<=") ``value``, by
    halving; 0 where either is NULL."""
    halves = ", ".join(str(1 << i) for i in reversed(range(SEARCH_STEPS)))
    return (f"aggregate(array({halves}), 0,"
            f" (n, half) -> n + if(get({steps}, n + half - 1) {below} {value}, half, 0))")


def searched(df: DataFrame, name: str, steps: str, value: str, below: str,
             most: int) -> DataFrame:
    """Add ``name``: ``search`` in arrays of at most ``most`` entries.

    Each halving is a projection of its own: all of them run in one generated loop over the rows
    of a join, in which the arrays stay where they lie. The lambda of ``search`` is interpreted,
    and each row gets copies of its arrays first, which grow with the market.
    """
    df = df.withColumn(name, F.lit(0))
    for half in (1 << i for i in reversed(range(most.bit_length()))):
        found = f"get({steps}, {name} + {half - 1}) {below} {value}"
        df = df.withColumn(name, F.expr(f"{name} + if({found}, {half}, 0)"))
    return df


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column,
                    probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of ``value`` per group; NULL values are ignored."""
    return histogram_quantiles(histogram(df, keys, value), keys, probs)


def share_below(hist: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each (keys, value) of ``targets``: the group's share strictly below the value.

    Targets join the histogram as zero-weight values, so no range join is needed and repeated
    targets are looked up once. Groups without weight get NULL.
    """
    both = (
        hist.select(*keys, "value", "weight", F.lit(False).alias("asked"))
        .unionByName(
            targets.select(*keys, "value", F.lit(0).cast("bigint").alias("weight"),
                           F.lit(True).alias("asked"))
        )
        .groupBy(*keys, "value")
        .agg(F.sum("weight").alias("weight"), F.bool_or("asked").alias("asked"))
    )
    return (
        ranked_values(both, keys)
        .where("asked")
        .select(*keys, "value", F.try_divide("below", "total").alias("share"))
    )


def level_counts(df: DataFrame, level: str) -> DataFrame:
    """Row count per level."""
    return df.groupBy(level).agg(F.count(F.lit(1)).alias("n"))


def top_levels(df: DataFrame, level: str, k: int) -> DataFrame:
    """The k most frequent levels; ties by name."""
    return (
        level_counts(df.where(F.col(level).isNotNull()), level)
        .orderBy(F.desc("n"), F.asc(level))
        .limit(k)
    )
