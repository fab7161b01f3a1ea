"""The persona report: advice for a short fixed list of profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peerband.operators.advise import REQUEST_SCHEMA, Advisor, advise

# Location, room type and guests of the published profiles. The remaining fields
# are plain choices for such a home.
PERSONAS = (
    (1, "Copacabana", "Entire home/apt", "Entire rental unit", 2.0, 1.0, 1.0, 2.0, False, 20.0),
    (2, "Ipanema", "Entire home/apt", "Entire rental unit", 4.0, 2.0, 2.0, 2.0, False, 20.0),
    (3, "Copacabana", "Private room", "Private room in rental unit", 2.0, 1.0, 1.0, 2.0, False,
     20.0),
    (4, "Barra da Tijuca", "Entire home/apt", "Entire rental unit", 6.0, 3.0, 2.0, 2.0, False,
     20.0),
)


def personas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*p, None) for p in PERSONAS], REQUEST_SCHEMA)


def persona_report(advisor: Advisor, detrended: DataFrame,
                   requests: DataFrame | None = None) -> DataFrame:
    """Anchor, range, position and comparable count per profile."""
    spark = detrended.sparkSession
    advice = advise(advisor, personas(spark) if requests is None else requests, detrended)
    return advice.select(
        "request_id", "neighbourhood", "room_type", "accommodates",
        "anchor", "low", "high", "position_label", "n_effective",
        "neighbourhood_in_model", "has_peer_signal",
    ).orderBy("request_id")
