"""Numbers, ratios and the many spellings of "this claim has an error"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_TEXT = r"^[0-9]+\.?[0-9]*$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: Column | str, type: str = "decimal(15,2)") -> Column:
    """Text to number: commas and outer blanks dropped, anything unreadable is null."""
    return F.trim(F.replace(_c(c), F.lit(","), F.lit(""))).try_cast(type)


def num0(c: Column | str, type: str = "decimal(15,2)") -> Column:
    return F.coalesce(num(c, type), F.lit(0).cast(type))


def whole0(c: Column | str) -> Column:
    """Text to integer through a float (``'12.9'`` gives 12), unreadable gives 0."""
    return F.coalesce(num(c, "double").try_cast("bigint"), F.lit(0).cast("bigint"))


def zero(c: Column | str) -> Column:
    return F.coalesce(_c(c), F.lit(0))


def is_numeric(c: Column | str) -> Column:
    return _c(c).rlike(NUMERIC_TEXT)


def ratio(a: Column, b: Column, dp: int = 2, scale: int = 100) -> Column:
    """``round(a / b * scale, dp)``, 0 when ``b`` is not positive.  Halves round up."""
    x, y = a.cast("double"), b.cast("double")
    return F.when(y > 0, F.round(x / y * scale, dp)).otherwise(F.lit(0.0))


def ratio_or_null(a: Column, b: Column, dp: int = 2, scale: int = 100) -> Column:
    """As :func:`ratio` but null for a zero denominator."""
    x, y = a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))
    return F.round(x / y * scale, dp)


def change(cur: Column, prev: Column, dp: int = 2) -> Column:
    """Percent change against ``prev``; 0 when there is nothing to compare with."""
    return ratio(cur.cast("double") - prev.cast("double"), prev, dp)


def total(c: Column | str) -> Column:
    """Sum that is 0, not null, over no rows."""
    return F.coalesce(F.sum(_c(c)), F.lit(0))


def mean(c: Column | str) -> Column:
    """Mean as exact decimal sum over count, so the result does not depend on row order."""
    return F.try_divide(F.sum(_c(c)).cast("double"), F.count(_c(c)).cast("double"))


def is_error(c: Column | str = "error_code", blank_counts: bool = False, exclude: tuple[str, ...] = ()) -> Column:
    """True when the code marks an error.

    Reports disagree about blanks, ``'-'`` and ``'0'``; name the spellings that do not count in
    ``exclude``.  Never null, so it can be negated safely.
    """
    code = _c(c)
    hit = code.isNotNull()
    if not blank_counts:
        hit = hit & (code != "")
    for word in exclude:
        hit = hit & (code != word)
    return F.coalesce(hit, F.lit(False))


def human_size(c: Column | str) -> Column:
    """Bytes as text in decimal units: ``999 Bytes``, ``1.2 kB``, ``3.4 MB``."""
    n = _c(c).cast("double")

    def unit(power: int, name: str) -> Column:
        return F.format_string("%.1f " + name, F.round(n / F.lit(10.0**power), 1))

    return (
        F.when(n < 1e3, F.concat(_c(c).cast("bigint").cast("string"), F.lit(" Bytes")))
        .when(n < 1e6, unit(3, "kB"))
        .when(n < 1e9, unit(6, "MB"))
        .when(n < 1e12, unit(9, "GB"))
        .otherwise(unit(12, "TB"))
    )
