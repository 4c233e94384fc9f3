"""Walk-forward evaluation as one plan.

Every round g >= 2 of every season is predicted from rounds before g only.
There is no loop over rounds: window frames give all targets at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.scoring import component_points, expected_components, expected_points, with_rules
from touchline.operators import trailing as tr
from touchline.operators.merge import INTEGER_STATS, OPTIONAL_STATS
from touchline.operators.validation import leak_checked
from touchline.plans.models import BASELINES, COLUMN_MODELS, TABLE_MODELS
from touchline.sources.store import materialize

ACTUAL_COLUMNS = ["total_points", "minutes", "goals_scored", "assists", "clean_sheets", "bonus", "bps"]
DEFAULT_DIFFICULTY = 3.0


def attach_difficulty(df: DataFrame, difficulty: DataFrame | None, default: float = DEFAULT_DIFFICULTY) -> DataFrame:
    """Difficulty of the team's round, `default` where unknown."""
    if difficulty is None:
        return df.withColumn("custom_difficulty", F.lit(default))
    keys = [c for c in ("season", "team", "gw") if c in difficulty.columns]
    joined = df.join(difficulty.select(*keys, "custom_difficulty"), keys, "left")
    return joined.withColumn("custom_difficulty", F.coalesce("custom_difficulty", F.lit(default)))


def walk_features(
    fact: DataFrame,
    rules: Mapping | None = None,
    difficulty: DataFrame | None = None,
    window: int = tr.DEFAULT_WINDOW,
    minutes_window: int = tr.MINUTES_WINDOW,
    form: bool = True,
    events: bool = True,
) -> DataFrame:
    """Each fact row with everything known about it before its deadline, and, with `events`, its rules.

    All trailing columns are windows over (season, player), by which
    `store.materialize_by` deals the fact: then nothing exchanges it here. Priors
    and calendar come from one small aggregate, which is stored before the joins,
    as is the difficulty: Spark knows their size and broadcasts them where it may.
    """
    columns = ["total_points", *(tr.TRAILING_EVENTS if events else [])]
    cells = materialize(tr.cells_of(fact, columns))
    calendar = tr.calendar_of(cells)
    base = fact.join(calendar, ["season", "gw"]) if form else fact
    windows = tr.trailing_columns(columns, window)
    if events:
        windows |= tr.minutes_columns(minutes_window)
        windows["p_threshold"] = tr.threshold_rate(window)
        base = tr.with_threshold_hits(base, rules)
    if form:
        windows["form_trailing"] = tr.form_column()
    framed = base.withColumns(windows)
    if not form:
        framed = framed.join(calendar, ["season", "gw"])
    joined = framed.join(tr.pools_of(cells, columns), tr.CELL, "left")
    prior = {c: F.coalesce(F.col(f"{c}_prior"), F.lit(0.0)) for c in columns}
    filled = {f"{c}_trailing": F.coalesce(F.col(f"{c}_trailing"), prior[c]) for c in columns}
    if form:
        filled["form_trailing"] = F.coalesce(F.col("form_trailing"), prior["total_points"])
    if events:
        filled |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in tr.MINUTES_DEFAULT.items()}
    out = joined.withColumns(filled).drop(*[f"{c}_prior" for c in columns], "form_cutoff", "_hit")
    if not events:
        return out
    return with_rules(attach_difficulty(out, materialize(difficulty) if difficulty is not None else None), rules)


ROSTER_COLUMNS = ["season", "gw", "element_id", "position", "team", "is_promoted_club", "opponent_difficulty", "kickoff_time"]
# Columns of the fact that a walk reads: without the event model, and with it.
WALK_COLUMNS = [*ROSTER_COLUMNS, *ACTUAL_COLUMNS]
EVENT_COLUMNS = [*ROSTER_COLUMNS, *INTEGER_STATS, *OPTIONAL_STATS]


def point_in_time(fact: DataFrame, lookback: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, roster): what is known before each target round, for all targets.

    `train` has every fact row once for each later round of its season, in
    `target_gw`, at most `lookback` rounds later. No row of the target round or
    after it is there, so a model that reads `train` cannot see an outcome it
    predicts. `roster` has the rows of rounds from 2 on without their outcomes.
    """
    rounds = materialize(fact.groupBy("season").agg(F.array_sort(F.collect_set("gw")).alias("_rounds")))
    later = F.filter("_rounds", lambda g: (g > F.col("gw")) & (g >= 2))
    if lookback is not None:
        later = F.filter(later, lambda g: g - F.col("gw") <= lookback)
    train = fact.join(rounds, "season").withColumn("target_gw", F.explode(later)).drop("_rounds")
    roster = fact.filter(F.col("gw") >= 2).select(*[c for c in ROSTER_COLUMNS if c in fact.columns])
    return train, roster


def walk_forward(
    fact: DataFrame,
    models: Iterable[str] = BASELINES,
    rules: Mapping | None = None,
    difficulty: DataFrame | None = None,
    check_leakage: bool = True,
) -> DataFrame:
    """One row per season, round >= 2, model and player: prediction and actuals.

    Table models see what `point_in_time` gives them. With `check_leakage` (the
    default) the job fails if any history row is not strictly before the deadline
    of the round it predicts.
    """
    names = list(models)
    in_columns = [n for n in names if n in COLUMN_MODELS]
    in_tables = [n for n in names if n not in COLUMN_MODELS]
    actuals = [c for c in ACTUAL_COLUMNS if c in fact.columns]
    head = ["season", "gw", "element_id", "position", *actuals]
    parts = []
    if in_columns:
        frame = walk_features(
            fact, rules, difficulty, form="form" in in_columns, events="event_model" in in_columns
        ).filter(F.col("gw") >= 2)
        stack = F.explode(
            F.array(*[F.struct(F.lit(n).alias("baseline"), COLUMN_MODELS[n](rules).cast("double").alias("prediction")) for n in in_columns])
        )
        parts.append(frame.select(*head, "available_at", "deadline", stack.alias("_m")).select(
            *head, "available_at", "deadline", "_m.baseline", "_m.prediction"))
    calendar = materialize(tr.walk_calendar(fact).select("season", "gw", "available_at", "deadline")) if in_tables else None
    for name in in_tables:
        model, lookback = TABLE_MODELS[name]
        predicted = model(*point_in_time(fact, lookback)).select("season", "gw", "element_id", F.col("prediction").cast("double"))
        rows = fact.filter(F.col("gw") >= 2).select(*head).join(predicted, ["season", "gw", "element_id"])
        parts.append(rows.join(calendar, ["season", "gw"]).withColumn("baseline", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if check_leakage:
        checked = leak_checked(F.col("prediction"), F.col("available_at"), F.col("deadline"), "history")
        out = out.withColumn("prediction", checked)
    return out.select(
        "season", "gw", "baseline", "element_id", "position", "prediction", *actuals,
        (F.col("prediction") - F.col("total_points")).alias("error"),
    )


def compare_models(fact: DataFrame, rules: Mapping, difficulty: DataFrame | None) -> DataFrame:
    """The three baselines and the event model on the same targets."""
    return walk_forward(fact, [*BASELINES, "event_model"], rules, difficulty)


def decompose(fact: DataFrame, rules: Mapping, difficulty: DataFrame | None) -> DataFrame:
    """Predicted and realised points per component, on the same row."""
    frame = walk_features(fact, rules, difficulty, form=False).filter(F.col("gw") >= 2)
    columns = set(fact.columns)
    return frame.select(
        "season", "gw", "element_id", "position", "minutes", "p_blank", "p_short", "p_full",
        *[column.alias(f"predicted_{name}") for name, column in expected_components().items()],
        *[column.alias(f"actual_{name}") for name, column in component_points(columns).items()],
    )


def project_events(fact: DataFrame, roster: DataFrame, rules: Mapping, target_gw: int, **windows: int) -> DataFrame:
    """Projected rates for a roster that has not played `target_gw` yet.

    The roster joins the history as rows of the target round without events,
    so the same window frames serve it.
    """
    past = fact.filter(F.col("gw") < target_gw)
    future = roster.withColumn("gw", F.lit(target_gw).cast("bigint"))
    both = past.unionByName(future.select(*[c for c in future.columns if c in past.columns]), allowMissingColumns=True)
    shape = [c for c in ("season", "gw", "element_id", "team", "position", "is_promoted_club") if c in both.columns]
    columns = tr.TRAILING_EVENTS
    framed = tr.with_threshold_hits(both, rules).withColumns(
        {
            **tr.trailing_columns(columns, windows.get("window", tr.DEFAULT_WINDOW)),
            **tr.minutes_columns(windows.get("minutes_window", tr.MINUTES_WINDOW)),
            "p_threshold": tr.threshold_rate(windows.get("window", tr.DEFAULT_WINDOW)),
        }
    ).filter(F.col("gw") == target_gw)
    filled = tr.fill_with_pools(framed, tr.expanding_pools(both, columns).filter(F.col("gw") == target_gw), columns)
    return filled.select(
        *shape, *[f"{c}_trailing" for c in columns], "p_threshold",
        *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in tr.MINUTES_DEFAULT.items()],
    )


def project_points(fact: DataFrame, roster: DataFrame, rules: Mapping, difficulty: DataFrame | None, target_gw: int) -> DataFrame:
    return project_horizon(fact, roster, rules, difficulty, [target_gw])


def project_horizon(
    fact: DataFrame, roster: DataFrame, rules: Mapping, difficulty: DataFrame | None, horizon: list[int]
) -> DataFrame:
    """Points per player for each round of a horizon, from the history before it.

    Rates are the same for all rounds; only the fixtures differ.
    """
    rates = project_events(fact, roster, rules, horizon[0])
    rounds = F.explode(F.array(*[F.lit(g).cast("bigint") for g in horizon]))
    spread = attach_difficulty(rates.withColumn("gw", rounds), difficulty)
    return with_rules(spread, rules).select("season", "gw", "element_id", expected_points().alias("prediction"))
