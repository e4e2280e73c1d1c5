"""Column expressions shared by all operators.

Each null, rounding and text-to-number rule is stated here once. Everything is a
built-in expression, so it stays inside generated code and can be pushed down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "missing" in an exported CSV file.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Plain decimal or scientific notation. Java also accepts "12d" and "12f"; those are not numbers here.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

MOMENT_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: Column | str) -> Column:
    """Text to double; anything that is not a number becomes null."""
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def to_day(c: Column | str) -> Column:
    """Text ``yyyy-MM-dd``, with or without a time part, to its date; any other text, also a bare year, becomes null.

    Casting texts of the right shape costs no exception per bad cell, as a format parser would.
    """
    text = F.trim(_col(c))
    return F.when(text.rlike(MOMENT_PATTERN), F.substring(text, 1, 10).try_cast("date"))


def strict_day(c: Column | str) -> Column:
    """Text to date; a bad text fails the job."""
    return _strict(c, to_day(c))


def strict_moment(c: Column | str) -> Column:
    """Text with an optional time part to timestamp; a bad text fails the job."""
    return _strict(c, to_moment(c))


def _strict(c: Column | str, parsed: Column) -> Column:
    c = _col(c)
    bad = F.raise_error(F.concat(F.lit("not a date: "), c))
    # Named once, the text is parsed once.
    return F.coalesce(parsed, F.when(c.isNotNull(), bad))


def to_moment(c: Column | str) -> Column:
    """Text with an optional time part to timestamp, bad text to null."""
    text = F.trim(_col(c))
    return F.when(text.rlike(MOMENT_PATTERN), text.try_cast("timestamp"))


def null_if(c: Column | str, sentinel: str) -> Column:
    c = _col(c)
    return F.when(c != sentinel, c)


def normalise_missing(c: Column | str) -> Column:
    """Null for every cell text that stands for a missing value."""
    c = _col(c)
    return F.when(~c.isin(MISSING_TOKENS), c)


def month_key(d: Column | str) -> Column:
    """``yyyy-MM``; a null date keeps a null key, never a text such as ``NaT``.

    The text of a date begins with its month; a formatter, which takes several times longer, writes the years of more or fewer than four digits.
    """
    day = _col(d).cast("date")
    return F.when(F.year(day).between(1, 9999), F.substring(day.cast("string"), 1, 7)).otherwise(F.date_format(_col(d), "yyyy-MM"))


def year_number(d: Column | str) -> Column:
    return F.year(_col(d))


def month_number(d: Column | str) -> Column:
    return F.month(_col(d))


def days_between(end: Column | str, start: Column | str) -> Column:
    """Whole days from start to end; negative when end comes first."""
    return F.datediff(_col(end), _col(start))


def round_even(c: Column | str, digits: int) -> Column:
    """Round the scaled double half-to-even. ``F.round`` rounds half up and differs on ties."""
    scale = float(10**digits)
    return F.rint(_col(c) * scale) / scale


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clip into [low, high], keeping nulls: ``greatest`` and ``least`` alone would skip them."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def prefer(first: Column | str, condition: Column, fallback: Column | str) -> Column:
    """``first`` where the condition is true, else ``fallback`` (also when it is null)."""
    return F.when(condition, _col(first)).otherwise(_col(fallback))


def quotient(a: Column | str, b: Column | str) -> Column:
    """Unguarded, unrounded a / b; null instead of infinity when b is zero."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def percent_of(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole; null for an empty whole."""
    return F.try_divide(_col(part).cast("double") * 100.0, _col(whole).cast("double"))


def zip5(c: Column | str) -> Column:
    """Leading five digits of a postal code as an integer, else null. Read codes as text."""
    return F.regexp_extract(_col(c).cast("string"), r"^([0-9]{5})", 1).try_cast("int")


def blank(c: Column | str) -> Column:
    """True for null and for text of blanks only; never null."""
    c = _col(c)
    return c.isNull() | (F.trim(c) == "")


def is_true(condition: Column) -> Column:
    """A non-null flag: an unknown comparison counts as false."""
    return F.coalesce(condition, F.lit(False))
