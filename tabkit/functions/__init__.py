from .scalars import (  # noqa: F401
    blank,
    clip,
    days_between,
    is_true,
    month_key,
    month_number,
    normalise_missing,
    null_if,
    num,
    percent_of,
    prefer,
    quotient,
    round_even,
    strict_day,
    strict_moment,
    to_day,
    to_moment,
    year_number,
    zip5,
)
