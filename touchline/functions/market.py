"""Market signals over a deltas table, price moves and resale prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.validation import require_columns

Z_95 = 1.959963985  # fixed value: two-sided 95% point of the standard normal


def ownership_acceleration(
    deltas: DataFrame, short: str = "1h", short_hours: float = 1.0, long: str = "24h", long_hours: float = 24.0
) -> DataFrame:
    near, far = f"selected_by_percent_delta_{short}", f"selected_by_percent_delta_{long}"
    require_columns(deltas, near, far)
    return deltas.select(
        "element_id",
        F.col(near).alias("ownership_delta_short"),
        F.col(far).alias("ownership_delta_long"),
        (F.col(near) / short_hours - F.col(far) / long_hours).alias("ownership_acceleration"),
    )


def _net(deltas: DataFrame, window: str, *extra: str) -> Column:
    bought, sold = f"transfers_in_event_delta_{window}", f"transfers_out_event_delta_{window}"
    require_columns(deltas, bought, sold, *extra)
    return F.col(bought) - F.col(sold)


def transfer_velocity(deltas: DataFrame, window: str = "1h", hours: float = 1.0) -> DataFrame:
    net = _net(deltas, window)
    return deltas.select("element_id", net.alias("net_transfers"), (net / hours).alias("transfer_velocity"))


def price_pressure(deltas: DataFrame, window: str = "1h") -> DataFrame:
    net = _net(deltas, window, "selected_by_percent")
    return deltas.select(
        "element_id",
        net.alias("net_transfers"),
        (net / (F.col("selected_by_percent") + 1.0)).alias("price_change_pressure"),
    )


def predict_direction(pressure: Column, rise: float = 0.5, fall: float = -0.5) -> Column:
    return F.when(pressure >= rise, "rise").when(pressure <= fall, "fall").otherwise("stable")


def actual_direction(before: Column, after: Column) -> Column:
    return F.when(after > before, "rise").when(after < before, "fall").otherwise("stable")


def resale_price(bought: Column, now: Column) -> Column:
    """A fall passes through; of a rise, half is kept, rounded down."""
    return F.when(now <= bought, now).otherwise(bought + F.floor((now - bought) / F.lit(2)))


def hit_points(hits: Column, cost: int = 4) -> Column:
    return hits * cost


def binomial_ci(hits: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Normal-approximation interval inside [0, 1]; (0, 1) when n is 0."""
    p = F.try_divide(hits, n)
    margin = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n))
    low = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), p - margin))
    high = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p + margin))
    return low, high
