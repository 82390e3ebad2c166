"""Searched-CASE banding driven by tables of (upper bound, label)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ledgerscope.schemas import WEEKDAYS, DAYPARTS

# Report bands as (exclusive upper bound, label), ascending.
AGE_BANDS = [(25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64"), (math.inf, "65+")]
AMOUNT_BANDS = [
    (100, "Below 100"), (500, "100-499"), (1000, "500-999"), (5000, "1,000-4,999"),
    (10000, "5,000-9,999"), (50000, "10,000-49,999"), (math.inf, "50,000+"),
]
BALANCE_BANDS = [
    (1000, "Below 1,000"), (10000, "1,000-9,999"), (50000, "10,000-49,999"),
    (100000, "50,000-99,999"), (500000, "100,000-499,999"), (math.inf, "500,000+"),
]
RATIO_BANDS = [(0.5, "Below 0.5"), (1, "0.5-0.99"), (5, "1-4.99"), (10, "5-9.99"), (math.inf, "10+")]
# Whole days, so "at most 7" is "below 8".
SPAN_BANDS = [(2, "1 day"), (8, "2-7 days"), (31, "8-30 days"), (61, "31-60 days"), (math.inf, "61+ days")]
UNKNOWN = "Unknown"

# Preference labels in tie order.
DAYPART_LABELS = {part: part.replace("_", " ").capitalize() for part in DAYPARTS}


def band(c: Column, bands: list[tuple[float, str]], missing: str | None = UNKNOWN) -> Column:
    """Label of the first band whose upper bound exceeds the value."""
    out = F.when(c.isNull(), F.lit(missing))
    for upper, label in bands[:-1]:
        out = out.when(c < F.lit(upper), label)
    return out.otherwise(bands[-1][1])


def order_of(c: Column, labels: list[str]) -> Column:
    """Position of a label in its natural order; unlisted labels come last."""
    place = F
    for i, label in enumerate(labels, start=1):
        place = place.when(c == label, F.lit(i))
    return place.otherwise(F.lit(len(labels) + 1))


def band_order(c: Column, bands: list[tuple[float, str]]) -> Column:
    return order_of(c, [label for _, label in bands])


def weekday_order(c: Column) -> Column:
    return order_of(c, WEEKDAYS)


def daypart_order(c: Column) -> Column:
    return order_of(c, list(DAYPARTS))


def known_or(c: Column, label: str = UNKNOWN) -> Column:
    return F.coalesce(c, F.lit(label))


def customer_type(count: Column) -> Column:
    return F.when(count == 1, "Single transaction").otherwise("Repeat customer")


def weekend_profile(share: Column) -> Column:
    return (F.when(share == 0, "No weekend activity").when(share < 0.5, "Mostly weekdays")
            .when(share < 1, "Mostly weekends").otherwise("Weekend only"))


def value_quadrant(spend: Column, balance: Column, spend_ref: Column, balance_ref: Column) -> Column:
    side = lambda x, ref, low: F.when(x >= ref, "High").otherwise(low)
    return F.concat(side(spend, spend_ref, "Lower"), F.lit(" spend / "),
                    side(balance, balance_ref, "Lower"), F.lit(" balance"))


def preferred_daypart(shares: dict[str, Column]) -> Column:
    """Label of the largest share, ties to the earlier daypart.

    One missing share makes the whole maximum missing, and then the last label applies.
    """
    top = F.greatest(*shares.values())
    complete = F.lit(True)
    for share in shares.values():
        complete = complete & share.isNotNull()
    out = F.when(~complete, DAYPART_LABELS["late_evening"])
    for part, share in list(shares.items())[:-1]:
        out = out.when(share == top, DAYPART_LABELS[part])
    return out.otherwise(DAYPART_LABELS["late_evening"])


# Segment names and descriptions by cluster number.
SEGMENT_NAMES = {0: "Limited History", 1: "Repeat Activity"}
SEGMENT_DESCRIPTIONS = {
    0: "Low-observed-activity customers",
    1: "Repeat and higher-observed-activity customers",
}


def _segment_text(cluster: Column, known: dict[int, str]) -> Column:
    out = F
    for number, text in known.items():
        out = out.when(cluster == number, text)
    return out.otherwise(F.concat(F.lit("Segment "), cluster.cast("string")))


def segment_name(cluster: Column) -> Column:
    return _segment_text(cluster, SEGMENT_NAMES)


def segment_description(cluster: Column) -> Column:
    return _segment_text(cluster, SEGMENT_DESCRIPTIONS)
