import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from peerband.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": 4,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


RAW_COLUMNS = (
    "id", "neighbourhood_cleansed", "room_type", "property_type", "accommodates", "bedrooms",
    "beds", "bathrooms_text", "price", "latitude", "longitude", "minimum_nights",
    "host_is_superhost", "instant_bookable", "host_response_time", "host_response_rate",
    "host_acceptance_rate", "number_of_reviews", "number_of_reviews_ltm", "reviews_per_month",
    "review_scores_rating", "availability_365", "last_review", "first_review",
)
# An invented harbour town. Each row is the base with what its place in the tests asks for.
BASE_ROW = {
    "id": "11", "neighbourhood_cleansed": "Old Port", "room_type": "Entire home/apt",
    "property_type": "Loft", "accommodates": "5", "bedrooms": "2.0", "beds": "3",
    "bathrooms_text": "2 baths", "price": "$310.50", "latitude": "-22.990", "longitude": "-43.200",
    "minimum_nights": "4", "host_is_superhost": "f", "instant_bookable": "t",
    "host_response_time": "within an hour", "host_response_rate": "85%",
    "host_acceptance_rate": "40%", "number_of_reviews": "18", "number_of_reviews_ltm": "7",
    "reviews_per_month": "0.75", "review_scores_rating": "4.25", "availability_365": "33",
    "last_review": "2025-11-20", "first_review": "2020-02-29",
}
RAW_ROWS = [
    tuple({**BASE_ROW, **changes}[c] for c in RAW_COLUMNS)
    for changes in (
        {},
        {"id": "12", "room_type": "Private room", "price": "$96.00", "instant_bookable": "f",
         "bathrooms_text": "1.5 shared baths", "host_is_superhost": "t", "accommodates": "1"},
        {"id": "13", "neighbourhood_cleansed": "Hill Side", "price": "$2,750.00",
         "bathrooms_text": "Half-bath", "host_response_rate": "N/A", "last_review": ""},
        {"id": "14", "price": "", "number_of_reviews": "0", "number_of_reviews_ltm": "0"},
    )
]


def raw_frame(spark, rows=None, columns=RAW_COLUMNS):
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.createDataFrame(RAW_ROWS if rows is None else rows, schema)


@pytest.fixture
def raw_listings(spark):
    return raw_frame(spark)


# Two listings over a week; letters are the days' availability.
CALENDAR_ROWS = [
    (listing, f"2025-03-{3 + day:02d}", state, price, "1", "90")
    for listing, states, price in (("11", "fffttft", "$310.00"), ("12", "ttttttf", "$90.00"))
    for day, state in enumerate(states)
]
CALENDAR_SCHEMA = (
    "listing_id string, date string, available string, price string,"
    " minimum_nights string, maximum_nights string"
)


@pytest.fixture
def raw_calendar(spark):
    return spark.createDataFrame(CALENDAR_ROWS, CALENDAR_SCHEMA)
