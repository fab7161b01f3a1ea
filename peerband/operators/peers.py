"""Position against comparable listings, with tiered fallback and shrinkage.

The market is reduced once to leaves of consecutive prices per comparison group of every tier, and
the groups' statistics are read off them. A request looks up the groups it could belong to, with
one join for tiers that differ by capacity only, then its group's list of leaves and the leaf of its
price. Requests are not read twice, stored or grouped, and never meet individual listings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerband.functions.buckets import capacity_bucket, quoted
from peerband.operators.distribution import (
    exact_quantiles,
    histogram_quantiles,
    ladder_index,
    ladder_quantiles,
    ladders,
    searched,
)
from peerband.params import DEFAULTS, Params
from peerband.session import stage

GROUP = ["neighbourhood", "room_type", "cap_bucket"]
TIER_KEYS = ["tier", *GROUP]
#: The tier of the whole market, which has every row.
WHOLE = -1


def _key(tier: tuple[str, ...], column: str, prefix: str = "") -> Column:
    """A tier's key value; columns the tier ignores hold an empty string."""
    return F.col(prefix + column) if column in tier else F.lit("")


def with_capacity(listings: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    if "cap_bucket" in listings.columns:
        return listings
    return listings.withColumn(
        "cap_bucket",
        capacity_bucket(F.col("accommodates").cast("double"), params.capacity_buckets),
    )


def price_cells(listings: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(keys, value, weight) of the finest comparison groups, NULL keys included."""
    return (
        with_capacity(listings, params)
        .where(F.col("price").isNotNull())
        .groupBy(*GROUP, F.col("price").cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def market_histogram(listings: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(tier, keys, value, weight) for every tier; a row with a NULL key is in no such group."""
    return tier_histogram(price_cells(listings, params), params)


def tier_cells(cells: DataFrame, params: Params = DEFAULTS, whole: bool = False) -> DataFrame:
    """Cells dealt to their group of every tier, and with ``whole`` to the market's; a group may
    have several rows of one value."""
    kinds = [*enumerate(params.tiers), *([(WHOLE, ())] if whole else [])]
    tiers = F.array(
        *[
            F.struct(
                F.lit(i).alias("tier"), *[_key(tier, c).alias(c) for c in GROUP]
            )
            for i, tier in kinds
        ]
    )
    known = F.col("neighbourhood").isNotNull() & F.col("room_type").isNotNull() & F.col(
        "cap_bucket"
    ).isNotNull()
    return (
        cells.select(F.explode(tiers).alias("t"), "value", "weight")
        .select("t.*", "value", "weight")
        .where(known)
    )


def tier_histogram(cells: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return tier_cells(cells, params).groupBy(*TIER_KEYS, "value").agg(
        F.sum("weight").alias("weight")
    )


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def group_statistics(hist: DataFrame, centre: float | Column) -> DataFrame:
    """n, quartiles, IQR, mean, sample deviation and CV per comparison group.

    ``centre`` (the market median) is subtracted before squaring to keep the sums accurate.
    """
    centred = hist.withColumn("_d", F.col("value") - _column(centre))
    return _statistics(histogram_quantiles(
        centred, TIER_KEYS, QUARTILES,
        also=[
            "sum(_d * weight) as _s1",
            "sum(_d * _d * weight) as _s2",
            "sum(value * weight) as _sum",
        ],
    ))


def ladder_statistics(leaves: DataFrame, index: DataFrame, centre: float | Column) -> DataFrame:
    """``group_statistics`` read off leaves and their index."""
    centred = index.withColumn("_d", F.col("sum") / F.col("n") - _column(centre))
    return _statistics(ladder_quantiles(
        leaves, centred, TIER_KEYS, QUARTILES,
        also=[
            "sum(_d * n) as _s1",
            "sum(squares + _d * _d * n) as _s2",
            "sum(sum) as _sum",
        ],
    ))


def _column(centre: float | Column) -> Column:
    return centre if isinstance(centre, Column) else F.lit(centre)


def _statistics(stats: DataFrame) -> DataFrame:
    """Statistics from quartiles and sums of distances from the centre, their squares and values."""
    n = F.col("n")
    spread = F.sqrt(
        F.greatest(
            F.try_divide(F.col("_s2") - F.col("_s1") * F.col("_s1") / n, n - 1), F.lit(0.0)
        )
    )
    mean = F.col("_sum") / n
    return stats.select(
        *TIER_KEYS,
        "n",
        "q25",
        "median",
        "q75",
        (F.col("q75") - F.col("q25")).alias("iqr"),
        mean.alias("mean"),
        F.when(n >= 2, spread).alias("std"),
        F.when(n >= 2, F.try_divide(spread, mean)).alias("cv"),
    )


def global_median(listings: DataFrame) -> DataFrame:
    return exact_quantiles(
        listings, [], F.col("price").cast("double"), {"median": 0.5}
    )


@dataclass(frozen=True)
class PeerTables:
    """A market reduced for lookups. Tables are stored, so the planner knows their sizes."""

    median: float
    #: Capacity buckets of the market; a request's other ones are like a missing one.
    capacities: tuple[str, ...]
    #: For each set of key columns beside capacity, finest first: the columns, capacity (one of
    #: them or NULL) and ``answer``, what a request with these keys is told.
    answers: tuple[DataFrame, ...]
    #: Every group's leaves in order: their lows, ids and starts.
    groups: DataFrame
    leaves: DataFrame


#: Capacity buckets that a market may have.
MOST_CAPACITIES = 1000
CAPACITY = "cap_bucket"
LEAVES = ("lows", "ids", "starts")


def lookup_columns(params: Params = DEFAULTS) -> list[tuple[str, ...]]:
    """The key columns beside capacity of every lookup, in the order of the tiers."""
    sets = [tuple(c for c in tier if c != CAPACITY) for tier in params.tiers]
    out = list(dict.fromkeys(sets))
    if any(not set(b) <= set(a) for a, b in zip(out, out[1:])):
        raise ValueError("the key columns of a tier must be among those of the tiers before it")
    return out


def group_tables(statistics: DataFrame, params: Params = DEFAULTS) -> list[DataFrame]:
    """One table per lookup. A row's map has at most one entry per tier and capacity bucket."""
    entry = F.struct(
        F.concat_ws(":", "tier", CAPACITY).alias("k"),
        F.struct("n", "median", "iqr", "cv").alias("v"),
    )
    out = []
    for columns in lookup_columns(params):
        tiers = [i for i, t in enumerate(params.tiers)
                 if tuple(c for c in t if c != CAPACITY) == columns]
        out.append(
            statistics.where(F.col("tier").isin(tiers)).groupBy(*columns)
            .agg(F.map_from_entries(F.collect_list(entry)).alias("found"))
        )
    return out


def resolve(requests: DataFrame, groups: Sequence[DataFrame], median: float,
            params: Params = DEFAULTS) -> DataFrame:
    """Add the answering tier of each key combination, its size, spread and shrunk median.

    The prior starts at the market median and walks finest to coarsest: a tier with too few
    rows hands its own shrunk median on as the prior of the next; an empty one hands on
    nothing. The last tier answers with any rows at all.
    """
    kept = [quoted(c) for c in requests.columns]
    out, found = requests, {}
    for k, (columns, table) in enumerate(zip(lookup_columns(params), groups, strict=True)):
        side = table.select(
            *[F.col(c).alias(f"_k{k}_{c}") for c in columns], F.col("found").alias(f"_found{k}")
        )
        match = F.lit(True)
        for c in columns:
            match = match & (F.col(c) == F.col(f"_k{k}_{c}"))  # NULL matches nothing
        out = out.join(side, match, "left")
        found[columns] = f"_found{k}"
    picked = []
    for i, tier in enumerate(params.tiers):
        name = found[tuple(c for c in tier if c != CAPACITY)]
        key = f"concat('{i}:', {CAPACITY})" if CAPACITY in tier else f"'{i}:'"
        picked.append(F.expr(f"try_element_at({name}, {key})").alias(f"_t{i}"))
    out = out.select(*kept, *picked)

    last = len(params.tiers) - 1
    prior = F.lit(median)
    tier = answer = chosen = None
    for i in range(last + 1):
        here = F.col(f"_t{i}")
        n = F.coalesce(here["n"], F.lit(0))
        share = n / (n + params.prior_strength)
        # With no rows the share is 0 and the prior passes through unchanged.
        prior = share * F.coalesce(here["median"], F.lit(0.0)) + (1 - share) * prior
        accepts = (n > 0) if i == last else (n >= params.min_tier_rows)
        tier = (F.when if tier is None else tier.when)(accepts, F.lit(i))
        answer = (F.when if answer is None else answer.when)(accepts, prior)
        chosen = (F.when if chosen is None else chosen.when)(accepts, here)
    tier = F.coalesce(tier, F.lit(last))
    placed = out.select(
        *kept, tier.alias("tier"), answer.otherwise(prior).alias("shrunk_median"),
        chosen.alias("_chosen"),
    )
    return placed.select(
        *kept,
        "tier",
        F.coalesce(F.col("_chosen")["n"], F.lit(0)).cast("bigint").alias("n_effective"),
        "shrunk_median",
        F.coalesce(F.col("_chosen")["iqr"], F.lit(0.0)).alias("iqr"),
        F.col("_chosen")["cv"].alias("cv"),
    )


ANSWER = ("tier", "n_effective", "shrunk_median", "iqr", "cv")


def answer_tables(groups: Sequence[DataFrame], capacities: Sequence[str], median: float,
                  params: Params = DEFAULTS) -> list[DataFrame]:
    """What requests are told, for every combination of keys that any group has.

    A request whose finest columns are unknown is told what the coarser ones alone would be, so
    there is a row for each known set of columns and each capacity, NULL among them.
    """
    out = []
    for columns, table in zip(lookup_columns(params), groups, strict=True):
        sizes = F.array(*[F.lit(c) for c in capacities], F.lit(None).cast("string"))
        known = table.select(*columns, F.explode(sizes).alias(CAPACITY)).select(
            *[F.col(c) if c in (*columns, CAPACITY) else F.lit(None).cast("string").alias(c)
              for c in GROUP]
        )
        found = resolve(known, groups, median, params)
        out.append(found.select(*columns, CAPACITY, F.struct(*ANSWER).alias("answer")))
    return out


def position_requests(requests: DataFrame, peers: PeerTables,
                      params: Params = DEFAULTS) -> DataFrame:
    """Add the peer position of each request's ``target_price``.

    Requests need neighbourhood, room_type, cap_bucket and target_price. Tables that fit are
    broadcast, so requests stay where they are; a larger one is joined by shuffling them, and
    adaptive execution splits a key that most of them share.
    """
    price = F.col("target_price").cast("double")
    known_size = F.when(F.col(CAPACITY).isin(list(peers.capacities)), F.col(CAPACITY))
    placed = requests.withColumns({"_price": price, "_size": known_size})
    lookups = list(enumerate(zip(lookup_columns(params), peers.answers, strict=True)))
    for k, (columns, table) in lookups:
        side = table.select(
            *[F.col(c).alias(f"_k{k}_{c}") for c in (*columns, CAPACITY)],
            F.col("answer").alias(f"_a{k}"),
        )
        match = F.col("_size").eqNullSafe(F.col(f"_k{k}_{CAPACITY}"))
        for c in columns:
            match = match & (F.col(c) == F.col(f"_k{k}_{c}"))  # NULL matches nothing
        placed = placed.join(side, match, "left")
    told = F.coalesce(*[F.col(f"_a{k}") for k, _ in lookups])
    placed = placed.select(*[quoted(c) for c in requests.columns], "_price", told.alias("_told"))
    last = len(params.tiers) - 1
    placed = placed.select(
        *[quoted(c) for c in requests.columns], "_price",
        F.coalesce(F.col("_told")["tier"], F.lit(last)).alias("tier"),
        F.coalesce(F.col("_told")["n_effective"], F.lit(0).cast("bigint")).alias("n_effective"),
        F.coalesce(F.col("_told")["shrunk_median"], F.lit(peers.median)).alias("shrunk_median"),
        F.coalesce(F.col("_told")["iqr"], F.lit(0.0)).alias("iqr"),
        F.col("_told")["cv"].alias("cv"),
    )
    names = F.array(*[F.array(*[F.lit(c) for c in tier]) for tier in params.tiers])
    groups = peers.groups.select(
        *[F.col(c).alias(f"_k_{c}") for c in TIER_KEYS], *[F.col(c).alias(f"_{c}") for c in LEAVES]
    )
    match = F.col("tier") == F.col("_k_tier")
    for c in GROUP:
        used = [i for i, tier in enumerate(params.tiers) if c in tier]
        key = F.when(F.col("tier").isin(used), F.col(c)).otherwise(F.lit(""))
        match = match & (key == F.col(f"_k_{c}"))
    # Without peers a request has no group: its tier is the last one, or its key is in no group.
    longest = peers.groups.agg(F.max(F.size("ids"))).first()[0] or 0
    listed = searched(
        placed.join(groups, match, "left"), "_at", "_lows", "_price", "<", longest
    )
    at = F.greatest(F.col("_at") - 1, F.lit(0))
    asked = listed.withColumns({"_leaf": F.get("_ids", at), "_start": F.get("_starts", at)}).drop(
        "_at", *[f"_{c}" for c in LEAVES], *[f"_k_{c}" for c in TIER_KEYS])
    leaves = peers.leaves.select(
        F.col("id").alias("_id"), F.col("steps").alias("_steps"), F.col("cum").alias("_cum")
    )
    # A leaf has no more values than rows.
    longest = peers.leaves.agg(F.max("n")).first()[0] or 0
    found = searched(
        asked.join(leaves, F.col("_leaf") == F.col("_id"), "left"),
        "_at", "_steps", "_price", "<", longest,
    )
    share = (F.col("_start") + F.get("_cum", "_at")) / F.col("n_effective")
    known = F.col("n_effective") > 0
    # An unknown price is below nothing; without peers the position is neutral.
    percentile = F.when(~known, F.lit(0.5)).when(
        F.col("_price").isNull(), F.lit(0.0)
    ).otherwise(share)
    return found.select(
        *[quoted(c) for c in requests.columns], "tier",
        F.get(names, F.col("tier")).alias("tier_used"), "n_effective",
        "shrunk_median", "iqr", "cv", percentile.alias("price_percentile"),
        known.alias("has_peer_signal"),
    )


def fit_peers(listings: DataFrame, params: Params = DEFAULTS) -> PeerTables:
    """Reduce a market to its median price, group statistics and price ranks, in one scan."""
    cells = stage(price_cells(listings, params), "price_cells")
    leaves = stage(ladders(tier_cells(cells, params, whole=True), TIER_KEYS), "peer_leaves")
    index = stage(ladder_index(leaves, TIER_KEYS), "peer_index")
    whole = ladder_quantiles(
        leaves, index.where(F.col("tier") == WHOLE), TIER_KEYS, {"median": 0.5}
    ).first()
    median = whole["median"] if whole else None
    index = index.where(F.col("tier") != WHOLE)
    statistics = stage(ladder_statistics(leaves, index, F.lit(median)), "peer_statistics")
    lists = F.array_sort(F.collect_list(F.struct("low", "id", "start")))
    groups = stage(
        index.groupBy(*TIER_KEYS).agg(lists.alias("at")).select(
            *TIER_KEYS, *[F.col("at")[c].alias(f"{c}s") for c in ("low", "id", "start")]
        ),
        "peer_groups",
    )
    tables = [stage(g, f"peer_tiers_{k}")
              for k, g in enumerate(group_tables(statistics, params))]
    sizes = statistics.where(F.col(CAPACITY) != "").select(CAPACITY).distinct()
    found = [r[0] for r in sizes.limit(MOST_CAPACITIES + 1).collect()]
    if len(found) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacity buckets")
    answers = answer_tables(tables, sorted(found), median, params)
    return PeerTables(
        median, tuple(sorted(found)),
        tuple(stage(a, f"peer_answers_{k}") for k, a in enumerate(answers)), groups,
        leaves.where(F.col("tier") != WHOLE),
    )


def peer_positions(requests: DataFrame, listings: DataFrame,
                   params: Params = DEFAULTS) -> DataFrame:
    """Place every request (its ``target_price``, else its ``price``) in a market."""
    asked = with_capacity(requests, params)
    if "target_price" not in asked.columns:
        asked = asked.withColumn("target_price", F.col("price"))
    return position_requests(asked, fit_peers(listings, params), params)
