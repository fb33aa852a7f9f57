"""Stable 63-bit ids of external names: blake2b-64, big-endian, shifted right one bit."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(value: str | int) -> int:
    """Integers pass through; booleans and other kinds are refused."""
    if isinstance(value, bool) or not isinstance(value, (str, int)):
        raise TypeError(f"an id is a text or an integer, not {type(value).__name__}")
    if isinstance(value, int):
        return value
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big") >> 1


def stable_ids(column: str | Column) -> Column:
    """The same over a text column, in Arrow batches; null stays null."""

    @F.pandas_udf("bigint")
    def run(names: pd.Series) -> pd.Series:
        return names.map(stable_id, na_action="ignore").astype("Int64")

    return run(F.col(column) if isinstance(column, str) else column)
