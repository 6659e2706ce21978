"""Join operators over dated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lagged_join(left: DataFrame, right: DataFrame, days: int = 1, how: str = "left") -> DataFrame:
    """Each left row with the right row of ``days`` days before: an equi join on the shifted date."""
    shifted = right.withColumn("date", F.date_add("date", days))
    return left.join(shifted, ["asset_id", "date"], how)


def asof_join(left: DataFrame, right: DataFrame, values: list[str], known: Column | None = None, lag_days: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Each left row with the right row of the latest date that it may use.

    A right row may be used from the later of its date plus ``lag_days`` and the
    day ``known`` from which it is available.  Both sides are put in one series
    in order of that day, and the latest date so far is carried on: one sort,
    no row meets more than its neighbours.  Adds ``values`` and ``asof_date``.
    """
    keys = keys or []
    usable = F.date_add("date", lag_days)
    if known is not None:
        usable = F.greatest(usable, known)
    own = left.columns
    rows = left.select(*keys, F.col("date").alias("_at"), F.lit(1).alias("_side"), F.struct(*own).alias("_row"), F.lit(None).alias("_found"))
    seen = right.select(*keys, usable.alias("_at"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct("date", *values).alias("_found"))
    along = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = seen.select(*keys, "_at", "_side", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_found").unionByName(
        rows.withColumn("_found", F.lit(None).cast(seen.schema["_found"].dataType))
    )
    carried = both.withColumn("_found", F.max("_found").over(along)).where("_side = 1")
    return carried.select("_row.*", F.col("_found.date").alias("asof_date"), *(F.col(f"_found.{v}").alias(v) for v in values))


def horizon_rows(bars: DataFrame, horizons: list[int], contiguous: bool = False) -> DataFrame:
    """Origins with their targets: horizon, target_date, actual, idx (row number from 0); contiguous asks for target = origin + horizon days."""
    along = Window.partitionBy("asset_id").orderBy("date")
    placed = bars.withColumn("idx", F.row_number().over(along) - 1)
    ahead = [F.struct(F.lit(h).alias("horizon"), F.lead("date", h).over(along).alias("target_date"), F.lead("close", h).over(along).alias("actual")) for h in horizons]
    rows = placed.withColumn("_ahead", F.array(*ahead)).withColumn("_t", F.explode("_ahead")).select(*placed.columns, "_t.*").where("target_date IS NOT NULL")
    return rows.where(F.datediff("target_date", "date") == F.col("horizon")) if contiguous else rows


def range_join(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with the span [start_date, end_date) that holds their date.  Spans are a fixed small dimension."""
    return rows.join(F.broadcast(spans), (F.col("date") >= F.col("start_date")) & (F.col("date") < F.col("end_date")), "left")


def purge_counts(evaluations: DataFrame, rows: DataFrame, embargo_days: int) -> DataFrame:
    """How many training rows each evaluation date has, and how many it may not use.

    Rows come with (origin_date, target_date).  First a row whose target is not
    before the evaluation date is unresolved; then one whose origin lies within
    the embargo is embargoed.  With a fixed horizon both are counts of sorted
    dates, so each is one as-of count instead of a comparison of all pairs.
    """
    resolved = _count_before(evaluations.select("eval_date"), rows.select(F.date_add("target_date", 1).alias("day")), "n_resolved")
    limit = F.greatest(F.date_add("target_date", 1), F.date_add("origin_date", embargo_days + 1))
    eligible = _count_before(evaluations.select("eval_date"), rows.select(limit.alias("day")), "n_eligible")
    total = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    return (
        resolved.join(eligible, "eval_date")
        .crossJoin(F.broadcast(total))
        .select("eval_date", "n_eligible", (F.col("n_resolved") - F.col("n_eligible")).alias("n_embargoed"), (F.col("n_rows") - F.col("n_resolved")).alias("n_unresolved"))
    )


def _count_before(evaluations: DataFrame, days: DataFrame, name: str) -> DataFrame:
    """How many days are at or before each evaluation date: daily counts first, then a running sum."""
    daily = days.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    both = daily.select("day", "n", F.lit(False).alias("asked")).unionByName(evaluations.select(F.col("eval_date").alias("day"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    running = F.sum("n").over(Window.orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, running).where("asked").select(F.col("day").alias("eval_date"), name)
