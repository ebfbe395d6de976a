"""Samples of about a fixed number of rows, whatever the size of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by_rank(rows: DataFrame, rank: Column, n: int) -> DataFrame:
    """The rows of the ``n`` smallest distinct values of ``rank`` (a hash of what tells rows apart);
    all rows if there are no more values.

    A first pass finds the largest of these values; only hashes are sorted, and one comes back.
    """
    (bound,) = rows.select(rank.alias("rank")).distinct().orderBy("rank").limit(n).agg(F.max("rank")).first()
    return rows.where(rank <= F.lit(bound).cast("bigint"))
