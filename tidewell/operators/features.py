"""A point-in-time feature table compiled from declarations.

A Source says how a day may use its rows: the row of exactly ``lag`` days before
(``daily``), or the latest row at least a day old (as-of).  A row with a day
``available_after`` is not used before it.  A Feature is a name, an expression
over the sources' columns (``source.column``), the source whose date it rests
on, and why it may be missing.

All features of a source come from one pass over it: a daily source is one equi
join on the shifted date, an as-of source one sorted pass, whatever the number
of its features.  Expressions stay in the JVM.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import finite
from tidewell.operators.joins import asof_join


class Source(NamedTuple):
    name: str
    daily: bool = True
    lag: int = 1
    #: A source without a usable row leaves its features out; otherwise each is told missing with its reason.
    silent: bool = False


class Feature(NamedTuple):
    name: str
    value: str
    source: str
    reason: str


def attached(spine: DataFrame, source: Source, rows: DataFrame) -> DataFrame:
    """The spine with a struct named after the source: the row that each (asset_id, date) may use, or null."""
    columns = [c for c in rows.columns if c not in ("asset_id", "available_after")]
    known = F.col("available_after") if "available_after" in rows.columns else None
    if source.daily:
        packed = rows.select("asset_id", F.date_add("date", source.lag).alias("_day"), *([known.alias("_known")] if known is not None else []), F.struct(*columns).alias(source.name))
        met = spine.join(packed.withColumnRenamed("_day", "date"), ["asset_id", "date"], "left")
        if known is None:
            return met
        usable = F.when(F.col("_known").cast("date") <= F.col("date"), F.col(source.name))
        return met.withColumn(source.name, usable).drop("_known")
    packed = rows.select("asset_id", "date", *([known] if known is not None else []), F.struct(*columns).alias(source.name))
    return asof_join(spine, packed, [source.name], known=known.cast("date") if known is not None else None, lag_days=source.lag, keys=["asset_id"]).drop("asof_date")


def feature_values(spine: DataFrame, sources: list[Source], rows: dict[str, DataFrame], features: list[Feature]) -> DataFrame:
    """asset_id, date, name, value, source_date, reason: a row for each feature that is there or told missing."""
    for source in sources:
        spine = attached(spine, source, rows[source.name])
    by_name = {s.name: s for s in sources}
    cells = []
    for f in features:
        there = F.col(f.source).isNotNull()
        value = finite(F.expr(f.value).cast("double"))
        told = F.lit(True) if not by_name[f.source].silent else there
        cells.append(
            F.when(told, F.struct(F.lit(f.name).alias("name"), value.alias("value"), F.when(value.isNotNull(), F.col(f"{f.source}.date")).alias("source_date"), F.when(value.isNull(), F.lit(f.reason)).alias("reason")))
        )
    return spine.select("asset_id", "date", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("asset_id", "date", "c.*")


def packed(values: DataFrame) -> DataFrame:
    """asset_id, date with maps features, source_dates and missing_reasons."""
    entry = lambda key, c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("name", c)))).alias(key)
    return values.groupBy("asset_id", "date").agg(entry("features", "value"), entry("source_dates", "source_date"), entry("missing_reasons", "reason"))


def look_ahead(values: DataFrame) -> DataFrame:
    """Rows whose source is not at least a day older than they are."""
    return values.where(F.col("source_date") > F.date_sub("date", 1))
