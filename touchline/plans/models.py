"""The model registry and the built-in models.

A column model is a function `(rules) -> Column` over the shared walk frame of
`walkforward.walk_features`, which has each row's rules in a column; all column models of a run share one pass over
the data. A table model is a function `(train, roster) -> DataFrame(season, gw,
element_id, prediction)` for anything that needs its own plan. It gets no fact
table, only what is known before each target round (`walkforward.point_in_time`),
for all targets at once: `train` has the earlier rounds' rows once per target,
named in `target_gw`, and `roster` the rows to predict, without outcomes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.difficulty import DIFFICULTY_STEP, fixture_scale
from touchline.functions.scoring import expected_points

ColumnModel = Callable[[Mapping], Column]
TableModel = Callable[[DataFrame, DataFrame], DataFrame]

COLUMN_MODELS: dict[str, ColumnModel] = {}
TABLE_MODELS: dict[str, tuple[TableModel, int | None]] = {}
BASELINES = ("trailing_mean", "form", "fixture_adjusted")


def register_column_model(name: str, model: ColumnModel) -> None:
    COLUMN_MODELS[name] = model


def register_table_model(name: str, model: TableModel, lookback: int | None = None) -> None:
    """`lookback`: how many rounds before its target the model wants to see; all of them by default.

    A row is handed over once per target that may see it, so a lookback keeps `train` small.
    """
    TABLE_MODELS[name] = (model, lookback)


def trailing_mean_model(rules: Mapping) -> Column:
    """Mean points over the player's last rounds."""
    return F.col("total_points_trailing")


def form_model(rules: Mapping) -> Column:
    """Mean points over the 30 days before the last known kickoff."""
    return F.col("form_trailing")


def fixture_adjusted_model(rules: Mapping, step: float = DIFFICULTY_STEP) -> Column:
    return F.col("total_points_trailing") * fixture_scale(F.col("opponent_difficulty"), step)


def event_model(rules: Mapping) -> Column:
    """Expected points from projected event rates."""
    return expected_points()


register_column_model("trailing_mean", trailing_mean_model)
register_column_model("form", form_model)
register_column_model("fixture_adjusted", fixture_adjusted_model)
register_column_model("event_model", event_model)
