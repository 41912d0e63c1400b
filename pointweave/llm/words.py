"""Words and shingles as native column expressions.

Words are runs of characters other than space and the controls tab to carriage
return.  ``let`` binds an expression to a lambda variable, so that it is
evaluated once however often the body uses it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
_SPLIT = r"[ \t-\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text that isn't null."""
    return F.filter(F.split(text, _SPLIT), lambda w: w != "")


def shingle_hashes(own: Column, size: int) -> Column:
    """A 64-bit hash of each run of ``size`` words; fewer words give one for all of them, none none."""

    def of(w: Column) -> Column:
        long = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))
        return F.when(F.size(w) >= size, long).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(own, of)
