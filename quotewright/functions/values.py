"""Text, number and flag conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotewright.schemas import TRUE_WORDS

# A plain decimal number; a bare cast would also take forms such as '1d'.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities, any other double unchanged."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def to_number(c: Column) -> Column:
    """Text to double, NULL where the text is not a number."""
    return F.when(c.rlike(NUMBER_PATTERN), finite(c.try_cast("double")))


def number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double, whatever type it was read with."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return to_number(F.col(name))
    return finite(F.col(name).cast("double"))


def truthy(df: DataFrame, name: str) -> Column:
    """Boolean reading of a flag column; anything unknown, NULL included, is false."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.StringType):
        c = F.upper(c).isin(*TRUE_WORDS)
    elif not isinstance(kind, T.BooleanType):
        c = c == F.lit(1)
    return F.coalesce(c, F.lit(False))


def fill_null(c: Column, default: object) -> Column:
    return F.coalesce(c, F.lit(default))


def is_set(c: Column) -> Column:
    """A selector counts as set when it is neither NULL nor empty."""
    return F.coalesce(c != F.lit(""), F.lit(False))


def plain_number(c: Column, digits: int = 10) -> Column:
    """Shortest plain decimal text: 15.0 -> '15', 0.07 * 100 -> '7'.

    From 10^18 on there are no decimals to show: whole numbers, and beyond 38 digits the
    exponent form of a double.
    """
    text = F.round(c, digits).try_cast(f"decimal(28,{digits})").cast("string")
    short = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.coalesce(short, c.try_cast("decimal(38,0)").cast("string"), c.cast("string"))


def fixed_cents(c: Column, grouped: bool = False) -> Column:
    """Two decimals, rounded on the exact binary value like C's printf."""
    text = F.format_number(c, 2)
    return text if grouped else F.replace(text, F.lit(","), F.lit(""))


def total(c: Column) -> Column:
    """Sum of a double column; 0 when there is nothing to add, NaN counts as nothing.

    Amounts below 10^21 are added as decimals with six places, which does not depend on row
    order; those below 10^11, nearly all, in a form that is faster. Larger ones are added as
    doubles. No amount ends the job or is left out.
    """
    size = F.abs(c)
    small = F.sum(F.when(size < 1e11, c).cast("decimal(18,6)")).cast("double")
    wide = F.sum(F.when((size >= 1e11) & (size < 1e21), c).cast("decimal(28,6)")).cast("double")
    rest = F.sum(F.when((size >= 1e21) & ~F.isnan(c), c))
    zero = F.lit(0.0)
    return F.coalesce(small, zero) + F.coalesce(wide, zero) + F.coalesce(rest, zero)


def money(c: Column) -> Column:
    """As a decimal, so that sums do not depend on their order; NULL, NaN and what is 10^21 or more count as nothing."""
    return F.coalesce(F.when(F.abs(c) < 1e21, c).cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))
