"""The point-in-time feature table: a day's features rest on rows of earlier days that were known by then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import finite
from tidewell.operators import windows as w
from tidewell.operators.joins import asof_join, lagged_join


def feature_rows(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """date with maps: features, source_dates, missing_reasons; computed wide, packed at the end."""
    own = bars.select(
        "asset_id", "date", F.col("date").alias("source_date"), w.log_return("close", 7).alias("momentum7"), (F.col("close") / w.sma("close", 20) - 1).alias("gap20")
    )
    rows = lagged_join(bars.select("asset_id", "date"), own, 1)
    rows = asof_join(rows, macro, ["n_lines"], known=F.col("available_after"), lag_days=1)
    columns = {"momentum7": ("source_date", "no bar of the day before"), "gap20": ("source_date", "window not full"), "n_lines": ("asof_date", "nothing known yet")}
    names = F.array(*map(F.lit, columns))
    values = F.map_from_arrays(names, F.array(*(finite(F.col(c).cast("double")) for c in columns)))
    dates = F.map_from_arrays(names, F.array(*(F.when(F.col(c).isNotNull(), F.col(d)) for c, (d, _) in columns.items())))
    reasons = F.map_from_arrays(names, F.array(*(F.when(F.col(c).isNull(), F.lit(why)) for c, (_, why) in columns.items())))
    known = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    return rows.select("asset_id", "date", known(values).alias("features"), known(dates).alias("source_dates"), known(reasons).alias("missing_reasons"))
