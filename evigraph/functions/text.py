"""Small text helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that a padded identifier may carry.
BLANKS = " \t\n\r\x0b\x0c   　﻿"


def strip(c: Column) -> Column:
    """``c`` without leading and trailing white space of any kind."""
    return F.trim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def precedence(value: Column, order: Sequence[str]) -> Column:
    """Rank of ``value`` in ``order`` in any case, best highest; 0 for anything else."""
    ranked = F.array(*[F.lit(name) for name in reversed(order)])
    return F.coalesce(F.array_position(ranked, F.upper(strip(value))), F.lit(0)).cast("int")
