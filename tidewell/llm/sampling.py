"""Bounded training samples: the documented limit on what a model is fitted from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sizes of this many groups are broadcast.
BROADCAST_GROUPS = 10_000


def fold(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out of every training."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(fold(key) == 2, F.lit(False))


def lowest_hashes(rows: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """One row for each of at most ``limit`` ids, those that hash lowest: the same ones at every run, spread evenly over the ids.

    Rows that repeat an id are one row, with the least values.  The ids are
    counted first, and only those below the hash that some more than ``limit``
    of them are expected under are put in order: what meets in one task is
    bounded by ``limit``, not by the number of tasks.
    """
    one = rows.groupBy(key).agg(*(F.min(c).alias(c) for c in rows.columns if c != key))
    n, enough = one.count(), limit + 6 * int(limit**0.5) + 20
    spread = F.xxhash64(F.lit("sample"), key)
    if n > enough:
        one = one.where(spread < F.lit(-(2**63) + 2**64 * enough // n))
    return one.orderBy(spread, key).limit(limit)


def lowest_hashes_each(rows: DataFrame, limit: int, group: str, key: str = "doc_id") -> DataFrame:
    """As lowest_hashes, with ``limit`` ids for each value of ``group``: a rare value is sampled alike in a small and a large table."""
    one = rows.groupBy(key).agg(*(F.min(c).alias(c) for c in rows.columns if c != key))
    sizes = one.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    if sizes.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        sizes = F.broadcast(sizes)  # else a frequent value would meet its size in one task
    spread = F.xxhash64(F.lit("sample"), key)
    share = (spread.cast("double") + 2.0**63) / 2.0**64
    enough = limit + 6 * int(limit**0.5) + 20
    near = one.join(sizes, group).where((F.col("_n") <= enough) | (share < enough / F.col("_n")))
    place = F.row_number().over(Window.partitionBy(group).orderBy(spread, key))  # some more than ``limit`` rows of each value
    return near.withColumn("_place", place).where(F.col("_place") <= limit).select(*one.columns)


def rows_of(rows: DataFrame, chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of ``rows`` for each chosen id (a few thousand, broadcast), with the columns of both; of repeated ids the least row."""
    own = [c for c in rows.columns if c != key]
    met = rows.join(F.broadcast(chosen), key)
    least = met.groupBy(key, *(c for c in chosen.columns if c != key)).agg(F.min(F.struct(*own)).alias("least"))
    return least.select(key, *(c for c in chosen.columns if c != key), *(F.col(f"least.`{c}`").alias(c) for c in own))
