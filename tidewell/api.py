"""The forecast facade: validated arguments in, one row out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.scalars import clamp, normal_cdf, normal_quantile
from tidewell.operators.models import benchmark_models, model_inputs
from tidewell.sources.bars import order_bars

MOST_HORIZON = 3650
CONFIDENCES = (0.8, 0.9, 0.95)


def assets(spark: SparkSession, sf_dir: str) -> list[str]:
    return sorted(r[0] for r in order_bars(spark, sf_dir).select("asset_id").distinct().collect())


def forecast(spark: SparkSession, sf_dir: str, asset: str, horizon: int, confidence: float, model: str = "gbm-drift") -> DataFrame:
    """asset_id, date, horizon, median, lower, upper, p_up from the asset's latest full row."""
    if not isinstance(horizon, int) or not 1 <= horizon <= MOST_HORIZON:
        raise ValueError(f"horizon: a whole number from 1 to {MOST_HORIZON}")
    if confidence not in CONFIDENCES:
        raise ValueError(f"confidence: one of {CONFIDENCES}")
    if asset not in assets(spark, sf_dir):
        raise ValueError(f"no asset {asset!r}")
    rows = model_inputs(order_bars(spark, sf_dir).where(F.col("asset_id") == asset)).withColumn("horizon", F.lit(horizon))
    median, sigma = benchmark_models()[model]
    latest = rows.select("asset_id", "date", "horizon", "close", median.alias("median"), sigma.alias("sigma")).where("sigma > 0").orderBy(F.desc("date")).limit(1)
    z = normal_quantile(F.lit((1 + confidence) / 2))
    up = clamp(normal_cdf(F.ln(F.col("median") / F.col("close")) / F.col("sigma")), 0.01, 0.99)
    return latest.select(
        "asset_id", "date", "horizon", "median", (F.col("median") * F.exp(-z * F.col("sigma"))).alias("lower"), (F.col("median") * F.exp(z * F.col("sigma"))).alias("upper"), up.alias("p_up")
    )
