"""Quality flags: non-null booleans added to a frame, rows never removed.

A flag is added only when the columns it reads exist.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blank, is_true, zip5

Box = tuple[float, float, float, float]  # lowest and highest latitude, lowest and highest longitude

# The area accepted by the flag, the narrower area of the region filter, the postal band.
FLAG_BOX: Box = (32.5, 42.1, -124.5, -114.1)
REGION_BOX: Box = (32.0, 42.0, -124.0, -114.0)
POSTAL_BAND = (90001, 96162)


def _has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def any_of(df: DataFrame, flags: Sequence[str]) -> Column:
    """True when any of the flags that exist is true; false when none exists."""
    return reduce(lambda a, b: a | b, [is_true(F.col(f)) for f in flags if f in df.columns], F.lit(False))


def order_violation_flag(df: DataFrame, name: str, later: str, earlier: str) -> DataFrame:
    """True when ``later``, which should not come after ``earlier``, does."""
    if not _has(df, later, earlier):
        return df
    return df.withColumn(name, is_true(F.col(later) > F.col(earlier)))


def any_flag(df: DataFrame, name: str, flags: Sequence[str]) -> DataFrame:
    if not any(f in df.columns for f in flags):
        return df
    return df.withColumn(name, any_of(df, flags))


def timeline_flags(
    df: DataFrame,
    listing: str = "ListingContractDate",
    purchase: str = "PurchaseContractDate",
    close: str = "CloseDate",
) -> DataFrame:
    df = order_violation_flag(df, "listing_after_close_flag", listing, close)
    df = order_violation_flag(df, "purchase_after_close_flag", purchase, close)
    return any_flag(df, "negative_timeline_flag", ["listing_after_close_flag", "purchase_after_close_flag"])


def inside(lat: Column, lng: Column, box: Box) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lng.between(west, east)


def coord_flags(df: DataFrame, lat: str = "Latitude", lng: str = "Longitude", box: Box = FLAG_BOX) -> DataFrame:
    if not _has(df, lat, lng):
        return df
    y, x = F.col(lat), F.col(lng)
    return df.withColumns(
        {
            "missing_coords_flag": y.isNull() | x.isNull(),
            "zero_coords_flag": is_true((y == 0) & (x == 0)),
            "positive_longitude_flag": is_true(x > 0),
            "out_of_state_flag": y.isNotNull() & x.isNotNull() & ~is_true(inside(y, x, box)),
        }
    )


def outside_codes(code: str, low: int, high: int) -> Column:
    """True when the first five digits form a code outside the band; other texts are not judged."""
    return is_true(~zip5(F.col(code)).between(low, high))


def code_range_flag(
    df: DataFrame,
    code: str = "PostalCode",
    low: int = POSTAL_BAND[0],
    high: int = POSTAL_BAND[1],
    name: str = "non_ca_postal_flag",
) -> DataFrame:
    if not _has(df, code):
        return df
    return df.withColumn(name, outside_codes(code, low, high))


def quality_flags(df: DataFrame) -> DataFrame:
    """All date, coordinate and postal flags."""
    return df.transform(timeline_flags).transform(coord_flags).transform(code_range_flag)


def region_condition(
    df: DataFrame,
    state: str = "StateOrProvince",
    lat: str = "Latitude",
    lng: str = "Longitude",
    value: str = "CA",
    box: Box = REGION_BOX,
) -> Column:
    """Exactly the state, or no state at all and coordinates inside the box. An absent column counts as null."""

    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    code = column(state, "string")
    located = inside(column(lat, "double"), column(lng, "double"), box)
    return is_true((code == value) | (blank(code) & located))


def in_region(df: DataFrame, **options) -> DataFrame:
    return df.where(region_condition(df, **options))


def drop_out_of_band_postal(
    df: DataFrame, code: str = "PostalCode", low: int = POSTAL_BAND[0], high: int = POSTAL_BAND[1]
) -> DataFrame:
    return df.where(~outside_codes(code, low, high)) if _has(df, code) else df


def drop_flagged(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows without any of the flags; the whole frame when none of them exists."""
    return df.where(~any_of(df, flags))
