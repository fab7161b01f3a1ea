"""Every tunable value of the engine, as one immutable argument."""

from __future__ import annotations

from dataclasses import dataclass

# Published parameters of the analysis. Results depend on each of them.

POINTS_OF_INTEREST = (  # name, latitude, longitude
    ("Flamengo", -22.9329, -43.1738),
    ("Botafogo", -22.9530, -43.1810),
    ("Praia Vermelha (Urca)", -22.9555, -43.1650),
    ("Leme", -22.9630, -43.1670),
    ("Copacabana", -22.9711, -43.1822),
    ("Arpoador", -22.9886, -43.1936),
    ("Ipanema", -22.9869, -43.2045),
    ("Leblon", -22.9874, -43.2230),
    ("São Conrado", -23.0106, -43.2680),
    ("Barra da Tijuca", -23.0100, -43.3650),
    ("Recreio dos Bandeirantes", -23.0250, -43.4650),
    ("Grumari", -23.0480, -43.5170),
)

EVENT_WINDOWS = (  # name, first (month, day), last (month, day)
    ("Réveillon", (12, 28), (1, 2)),
    ("Carnaval", (2, 6), (2, 12)),
)

PEER_TIERS = (  # finest first
    ("neighbourhood", "room_type", "cap_bucket"),
    ("neighbourhood", "room_type"),
    ("room_type", "cap_bucket"),
    ("room_type",),
)

CAPACITY_BUCKETS = (  # label, exclusive lower edge, inclusive upper edge
    ("1-2", 0, 2),
    ("3-4", 2, 4),
    ("5-6", 4, 6),
    ("7+", 6, 999),
)

ALWAYS_NULL_COLUMNS = (
    "instant_bookable",
    "host_response_time",
    "host_response_rate",
    "host_acceptance_rate",
)
LEAKAGE_COLUMNS = (
    "availability_365",
    "estimated_occupancy_l365d",
    "estimated_revenue_l365d",
)
COLLINEAR_COLUMNS = ("beds",)

HORIZON_BUCKETS = (  # label, inclusive lower edge, exclusive upper edge (days)
    ("0-30", 0, 30),
    ("30-90", 30, 90),
    ("90-180", 90, 180),
    ("180-270", 180, 270),
    ("270-365", 270, 366),
)

CAVEAT = (
    "Occupancy/RevPAN are reviews-driven estimates, not observed bookings; "
    "use this range as price positioning, not a guaranteed-revenue optimum."
)
NO_EVENTS_NOTE = "No strong dated demand peaks in the detrended calendar (lower-bound signal)."
EVENTS_NOTE_PREFIX = "Seasonal demand (lower bound): "


@dataclass(frozen=True)
class Params:
    winsor_lower: float = 0.01
    winsor_upper: float = 0.99

    review_rate: float = 0.5
    nights_per_stay: float = 4.0
    occupancy_ceiling: float = 0.70
    benchmark_ceiling: float = 0.699

    rolling_window: int = 29
    events: tuple = EVENT_WINDOWS
    points: tuple = POINTS_OF_INTEREST

    pooled_level: str = "Other"
    min_neighbourhood_rows: int = 30
    property_levels: int = 8
    fold_room_type: tuple = ("Hotel room", "Entire home/apt")
    capacity_buckets: tuple = CAPACITY_BUCKETS
    excluded_columns: tuple = ALWAYS_NULL_COLUMNS + LEAKAGE_COLUMNS + COLLINEAR_COLUMNS

    tiers: tuple = PEER_TIERS
    prior_strength: float = 30.0
    min_tier_rows: int = 30

    model_weight: float = 0.5
    band_share_of_iqr: float = 0.5
    floor_share_of_anchor: float = 0.5
    below_percentile: float = 0.33
    above_percentile: float = 0.66
    drivers_shown: int = 5



DEFAULTS = Params()
