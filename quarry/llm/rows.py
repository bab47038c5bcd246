"""The caller's rows, kept whole in one struct column while an operator adds columns of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame, *needed: str, **more: Column) -> DataFrame:
    """row (the caller's columns), the needed ones again by themselves, and more columns; nothing the caller has can clash with them."""
    own = [docs[f"`{c}`"] for c in docs.columns]
    return docs.select(F.struct(*own).alias("row"), *needed, *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame, columns: list[str], *results: str) -> DataFrame:
    """The caller's columns unchanged, then the results; a column of the caller that bears the name of a result comes back as own_<name>."""
    own = [F.col("row").getField(c).alias(f"own_{c}" if c in results else c) for c in columns]
    return df.select(*own, *results)
