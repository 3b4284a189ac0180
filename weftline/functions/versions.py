"""Dotted versions as arrays of numbers, which compare part by part (5.10 after 5.9, 5.3 before 5.3.0)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What an open end of a range stands for.
LOWEST, HIGHEST = "4.0", "99.9"


def version(s: Column, parts: int = 0) -> Column:
    """The numbers of a version, null if a part is none; with ``parts`` a version of one part less ends with a zero (5.3 as 5.3.0)."""
    numbers = F.transform(F.split(s, r"\."), lambda x: x.try_cast("int"))
    whole = F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)
    return F.when(F.size(whole) == parts - 1, F.concat(whole, F.array(F.lit(0)))).otherwise(whole) if parts else whole


def version_range(s: Column) -> Column:
    """low and high of ``a``, ``a-b``, ``-b`` or ``a-``; null for anything else."""
    one = s.rlike(r"^\d+(\.\d+)*$")
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(s, r"^(\d+(?:\.\d+)*)?-(\d+(?:\.\d+)*)?$", i), F.lit("")), F.lit(default))
    ok = s.rlike(r"^(\d+(\.\d+)*-(\d+(\.\d+)*)?|-\d+(\.\d+)*)$")
    return F.when(one, F.struct(version(s).alias("low"), version(s).alias("high"))).when(ok, F.struct(version(part(1, LOWEST)).alias("low"), version(part(2, HIGHEST)).alias("high")))
