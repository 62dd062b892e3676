"""Sums and rounding that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(28,10)"


def exact(column: Column | str) -> Column:
    """A double as a decimal, so that sums and means are the same in any order."""
    return (F.col(column) if isinstance(column, str) else column).cast(EXACT)


def rounded(column: Column | str, places: int) -> Column:
    """Rounds half up in decimal, then returns a double."""
    return F.round(exact(column), places).cast("double")


def ieee_rounded(column: Column | str, places: int) -> Column:
    """Rounds the exact binary value half to even, as IEEE decimal printing does."""
    column = F.col(column) if isinstance(column, str) else column
    return F.replace(F.format_number(column.cast("double"), places), F.lit(","), F.lit("")).cast("double")


#: What is read as a number; Spark's own cast also takes 1d, 1f and white space within signs.
NUMBER = r"^\s*[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?\s*$"


def strict_double(c: Column | str) -> Column:
    """Text as a finite double, null for anything else."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    value = F.when(c.rlike(NUMBER), F.replace(F.trim(c), F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def lenient_double(c: Column | str) -> Column:
    """Text as a double after dropping commas; nan and infinity are numbers here."""
    c = F.replace((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(","), F.lit(""))
    word = F.lower(F.trim(c))
    special = F.when(word.rlike(r"^[+-]?nan$"), F.lit(float("nan"))).when(word.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(word.rlike("^-inf(inity)?$"), F.lit(float("-inf")))
    return F.coalesce(special, F.when(c.rlike(NUMBER), F.replace(F.trim(c), F.lit("_"), F.lit("")).try_cast("double")))


def shown(c: Column | str, places: int, suffix: str = "") -> Column:
    """With thousands separators and so many decimals."""
    return F.concat(F.format_number((F.col(c) if isinstance(c, str) else c).cast("double"), places), F.lit(suffix))


def share(part: Column, whole: Column) -> Column:
    """part of whole; 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def step(c: Column | str, limits: list[float], labels: list[str], ascending: bool = True) -> Column:
    """The label of the first limit that the value is at most (ascending) or at least; the last label beyond all, null for null."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(labels[-1])
    for limit, label in reversed(list(zip(limits, labels, strict=False))):
        out = F.when(c <= limit if ascending else c >= limit, F.lit(label)).otherwise(out)
    return F.when(c.isNotNull(), out)
