"""Numeric cleaning rules shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Month abbreviations that spreadsheet software wrote in place of decimals.
MONTH_NUMBERS = {
    "jän": 1, "jan": 1, "feb": 2, "mär": 3, "mar": 3, "apr": 4, "mai": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "dez": 12,
}


def inf_to_null(value: Column) -> Column:
    """NaN and both infinities become NULL, so built-in aggregates skip them."""
    return F.when(~(F.isnan(value) | (F.abs(value) == F.lit(float("inf")))), value)


def to_number(text: Column) -> Column:
    """Strict text to double; anything that is not a plain number becomes NULL."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def try_ratio(top: Column, bottom: Column) -> Column:
    """NULL instead of an error where the denominator is zero or missing."""
    return F.when(bottom != 0, top / bottom)


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def logit(probability: Column, floor: float = 1e-6) -> Column:
    """Log odds of a probability kept away from 0 and 1."""
    top = clip(probability, floor, 1 - floor)
    return F.ln(top / clip(1 - probability, floor, 1.0))


def recover_spreadsheet_decimal(text: Column) -> Column:
    """``01.Sep`` is 1.09, ``Mär.92`` is 3.92, ``1,5`` is 1.5; NULL when unknown."""
    trimmed = F.trim(text)
    month = "|".join(MONTH_NUMBERS)
    months = F.create_map(*[F.lit(item) for pair in MONTH_NUMBERS.items() for item in pair])
    number_of = lambda token: F.try_element_at(months, F.lower(token))
    two = lambda digits: F.lpad(digits.cast("string"), 2, "0")

    day_month = rf"(?iu)^(\d{{1,2}})\.({month})$"
    month_part = rf"(?iu)^({month})\.(\d{{1,2}})$"
    from_day = F.concat(
        F.regexp_extract(trimmed, day_month, 1), F.lit("."), two(number_of(F.regexp_extract(trimmed, day_month, 2)))
    )
    from_month = F.concat(
        number_of(F.regexp_extract(trimmed, month_part, 1)).cast("string"),
        F.lit("."),
        two(F.regexp_extract(trimmed, month_part, 2)),
    )
    return F.coalesce(
        to_number(F.replace(trimmed, F.lit(","), F.lit("."))),
        F.when(trimmed.rlike(day_month), from_day.try_cast("double")),
        F.when(trimmed.rlike(month_part), from_month.try_cast("double")),
    )


def coerce_sensor(raw: Column) -> Column:
    """struct(value, recovered, unresolved) of one raw sensor cell."""
    number = to_number(raw)
    value = F.coalesce(number, recover_spreadsheet_decimal(raw))
    return F.struct(
        inf_to_null(value).alias("value"),
        (raw.isNotNull() & number.isNull() & value.isNotNull()).alias("recovered"),
        (raw.isNotNull() & value.isNull()).alias("unresolved"),
    )


def coordinate_columns(x: Column, y: Column) -> dict[str, Column]:
    """The eight map-position features of a measured point (coordinates in 1e-5 units)."""
    u, v = x.cast("double") / 100_000.0, y.cast("double") / 100_000.0
    radius2 = u * u + v * v
    angle = F.atan2(v, u)
    return {
        "coordinate__x": u,
        "coordinate__y": v,
        "coordinate__radius": F.sqrt(radius2),
        "coordinate__radius2": radius2,
        "coordinate__xy": u * v,
        "coordinate__x2_minus_y2": u * u - v * v,
        "coordinate__sin_angle": F.sin(angle),
        "coordinate__cos_angle": F.cos(angle),
    }


def class_from_response(response: Column, threshold: float = 0.75) -> Column:
    """1 when the response is strictly above the threshold, else 0."""
    return F.when(response > threshold, 1).otherwise(0)
