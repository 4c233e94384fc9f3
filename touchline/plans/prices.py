"""The price-direction model, from snapshots to its hit rate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.market import actual_direction, predict_direction, price_pressure
from touchline.operators.metrics import hit_rate
from touchline.operators.snapshots import compute_deltas, reference_times, state_pair


def price_outcomes(
    snapshots: DataFrame,
    prediction_ts: datetime,
    evaluation_ts: datetime,
    window: str = "1h",
    rise: float = 0.5,
    fall: float = -0.5,
    order: tuple[str, ...] = ("snapshot_ts",),
) -> DataFrame:
    """Predicted and actual direction of every player known at both instants.

    `window` is one of the standard look-backs; another label is an error.
    """
    references = reference_times(prediction_ts)
    if window not in references:
        raise ValueError(f"unknown window {window!r}; one of {sorted(references)}")
    deltas = compute_deltas(
        snapshots, prediction_ts, {window: references[window]}, order=order,
        columns=["selected_by_percent", "transfers_in_event", "transfers_out_event"],
    )
    predicted = price_pressure(deltas, window).withColumn(
        "predicted_direction", predict_direction(F.col("price_change_pressure"), rise, fall)
    )
    pair = state_pair(snapshots, prediction_ts, evaluation_ts, ["now_cost"], order=order)
    actual = pair.select(
        "element_id", actual_direction(F.col("now_cost_before"), F.col("now_cost_after")).alias("actual_direction")
    )
    return predicted.drop("net_transfers").join(actual, "element_id")


def price_model(
    snapshots: DataFrame,
    prediction_ts: datetime,
    evaluation_ts: datetime,
    window: str = "1h",
    rise: float = 0.5,
    fall: float = -0.5,
    order: tuple[str, ...] = ("snapshot_ts",),
) -> DataFrame:
    """Hit rate of predicted moves with its 95% interval; one row."""
    return hit_rate(price_outcomes(snapshots, prediction_ts, evaluation_ts, window, rise, fall, order))
