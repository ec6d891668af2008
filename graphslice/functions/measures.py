"""Column expressions for review measures, ids and labels.

Everything here is a built-in expression, so it stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id prefixes, vertex labels and the number formats the raw
# review files use.
USER_PREFIX = "u_"
PRODUCT_PREFIX = "p_"
USER_LABEL = "User"
PRODUCT_LABEL = "Product"
ANONYMOUS_USER = "unknown"
FLOAT_PATTERN = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
INTEGER_PATTERN = r"^[+-]?\d+$"
BLANKS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def to_double(text: Column) -> Column:
    """The number in ``text``, or NULL when it is not one."""
    stripped = strip(text.cast("string"))
    return F.when(stripped.rlike(FLOAT_PATTERN), stripped.try_cast("double"))


def to_long(text: Column) -> Column:
    """The whole number in ``text``, or NULL when it is not one."""
    stripped = strip(text.cast("string"))
    return F.when(stripped.rlike(INTEGER_PATTERN), stripped.try_cast("bigint"))


def score(text: Column) -> Column:
    return F.coalesce(to_double(text), F.lit(0.0))


def epoch_seconds(text: Column) -> Column:
    return F.coalesce(to_long(text), F.lit(0).cast("bigint"))


def round_binary(x: Column, digits: int) -> Column:
    """Round the exact binary value of a non-negative double, ties to even.

    ``bround`` rounds the decimal text of the double, so 1/160 (stored a little
    above 0.00625) would become 0.0062. Here the double is cut into two halves
    whose products with the scale are exact, so the comparison with the tie
    point is exact too and 1/160 becomes 0.0063.
    """
    scale = float(10**digits)
    shifted = x * F.lit(134217729.0)  # 2^27 + 1
    high = shifted - (shifted - x)
    low = x - high
    below = F.floor(x * F.lit(scale)).cast("double")
    past_tie = (high * F.lit(2 * scale) - (below * 2 + 1)) + low * F.lit(2 * scale)
    up = (past_tie > 0) | ((past_tie == 0) & (F.pmod(below, F.lit(2.0)) == 1))
    exact = F.when(up, below + 1).otherwise(below) / F.lit(scale)
    # From 2^39 on neighbouring doubles are further apart than the last of four digits, so x is its own rounding.
    return F.when(F.abs(x) < F.lit(float(2**39)), exact).otherwise(x)


def helpfulness(text: Column) -> Column:
    """``"num/den"`` as a ratio with four digits; 0.0 for anything unusable."""
    parts = F.split(strip(text), "/")
    num = to_double(F.try_element_at(parts, F.lit(1)))
    den = to_double(F.try_element_at(parts, F.lit(2)))
    usable = (F.size(parts) == 2) & num.isNotNull() & (den > 0) & ~F.isnan(den)
    ratio = F.when(usable, F.try_divide(num, den)).otherwise(F.lit(0.0))
    return F.coalesce(
        F.when(ratio >= 0, round_binary(ratio, 4)).otherwise(-round_binary(-ratio, 4)),
        F.lit(0.0),
    )


def user_id(raw: Column) -> Column:
    return F.concat(F.lit(USER_PREFIX), raw)


def product_id(raw: Column) -> Column:
    return F.concat(F.lit(PRODUCT_PREFIX), raw)


def vertex_label(id_col: Column) -> Column:
    return F.when(id_col.startswith(USER_PREFIX), F.lit(USER_LABEL)).otherwise(F.lit(PRODUCT_LABEL))


def fixed_point_mean(x: Column) -> Column:
    """Mean of a measure through whole millionths.

    Adding doubles gives last-digit noise that depends on how Spark split the
    data, which shows when the mean is then rounded. Whole numbers do not, and
    the bigint sum has room for 9e12 rows of a ratio in one group.
    """
    millionths = F.rint(x * F.lit(1e6)).cast("bigint")
    return F.try_divide(F.sum(millionths).cast("double"), F.count(x) * F.lit(1e6))


#: The year of times that have none between 1 and 9999.
OTHER_YEAR = 0


def utc_year(seconds: Column) -> Column:
    """The year of epoch seconds whatever the session's zone; missing ones count as 0."""
    day = F.floor(F.coalesce(seconds, F.lit(0).cast("bigint")) / 86_400)
    first, last = -719_162, 2_932_896  # days of the first and last date with a year of one to four digits
    dated = F.year(F.date_from_unix_date(F.when(day.between(first, last), day.cast("int"))))
    return F.coalesce(dated, F.lit(OTHER_YEAR))
