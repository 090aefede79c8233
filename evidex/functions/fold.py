"""Small helpers for folding over bounded arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, wherever the body repeats it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unique_values(values: Column) -> Column:
    """Distinct ignoring case and outer blanks, first spelling kept, blanks dropped."""
    from evidex.functions.text import strip

    keyed = F.filter(
        F.transform(values, lambda v: F.struct(F.lower(strip(v)).alias("k"), v.alias("v"))),
        lambda s: F.coalesce(s["k"], F.lit("")) != "",
    )
    return F.aggregate(
        keyed, F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))),
        lambda acc: F.transform(acc, lambda y: y["v"]),
    )
