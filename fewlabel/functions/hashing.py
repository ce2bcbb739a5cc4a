"""Stateless random order: the same row gets the same place on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    """md5 of the parts joined with colons, as 32 hex digits.

    The parts are seed, replication, budget, salt and row id, so a lost
    executor recomputes exactly the same draw.
    """
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def fingerprint(value: Column) -> Column:
    """60-bit integer from the md5 of a value; xor-able into a set digest."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 15), 16, 10).cast("long")
