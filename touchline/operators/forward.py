"""The running season: actuals, increments, and evaluation of frozen predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.parsing import fixture_is_played
from touchline.operators.metrics import calibration, error_metrics, spearman_within

# The counts of the actuals store.
STAT_COLUMNS = [
    "minutes", "goals_scored", "assists", "clean_sheets", "goals_conceded", "saves", "bonus", "yellow_cards", "red_cards",
    "own_goals", "penalties_missed", "penalties_saved", "defensive_contribution", "total_points",
]
LAUNCH_ROUNDS = 13


def missing_periods(events: DataFrame, actuals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Finished rounds that are not recorded yet; unknown counts as unfinished."""
    keys = keys or []
    done = events.filter(F.coalesce("finished", F.lit(False))).select(*keys, F.col("id").alias("gw"))
    return done.join(actuals.select(*keys, "gw").distinct(), [*keys, "gw"], "left_anti")


def totals_before(actuals: DataFrame, gw: int, keys: list[str], columns: list[str] = STAT_COLUMNS) -> DataFrame:
    """Recorded sums per player over all rounds before `gw`."""
    return actuals.filter(F.col("gw") < gw).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def build_train(
    actuals: DataFrame,
    cumulative: DataFrame,
    played: DataFrame,
    gw: int,
    season: tuple[str, ...] = ("season",),
    columns: list[str] = STAT_COLUMNS,
) -> DataFrame:
    """History up to `gw`, the last round recovered from season totals if needed.

    `cumulative` has the roster columns and season-to-date totals; `played`
    names the teams whose match of round `gw` is over. A season whose round
    `gw` is recorded is taken as it is. Otherwise the round is the totals minus
    all recorded rounds, never below zero — but only if no earlier round is
    missing: an incomplete history would fold two rounds into one.
    """
    s = list(season)
    shape = [*s, "gw", "element_id", "position", "team", "is_promoted_club"]
    history = actuals.filter(F.col("gw") <= gw).select(*shape, *columns)
    recorded = history.groupBy(*s).agg(
        F.max(F.col("gw") == gw).alias("_has_gw"), F.count_distinct(F.when(F.col("gw") < gw, F.col("gw"))).alias("_before")
    )
    known = F.coalesce("_has_gw", F.lit(False))
    complete = F.coalesce("_before", F.lit(0)) == gw - 1
    open_seasons = cumulative.join(recorded, s, "left").filter(~known & complete).drop("_has_gw", "_before")
    playing = open_seasons.join(played.select(*s, "team").distinct(), [*s, "team"], "left_semi")
    keys = [*s, "element_id"]
    before = totals_before(history, gw, keys, columns).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    last = playing.join(before, keys, "left").withColumn("gw", F.lit(gw).cast("bigint"))
    increments = {c: F.greatest(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0)), F.lit(0)) for c in columns}
    return history.unionByName(last.withColumns(increments).select(*shape, *columns))


def coverage(train: DataFrame, fixtures: DataFrame, gw: int, season: tuple[str, ...] = ("season",)) -> DataFrame:
    """Distinct rounds of history, and teams with a played match in round `gw`."""
    s = list(season)
    sides = fixtures.filter(F.col("event") == gw).select(
        *s, fixture_is_played(F.col("finished"), F.col("finished_provisional")).alias("_over"),
        F.explode(F.array("team_h", "team_a")).alias("_team"),
    )
    teams = sides.groupBy(*s).agg(
        F.count_distinct(F.when(F.col("_over"), F.col("_team"))).alias("teams_with_played_data"),
        F.count_distinct("_team").alias("teams_total"),
    )
    return train.groupBy(*s).agg(F.count_distinct("gw").alias("history_gws")).join(teams, s, "left")


# ----------------------------------------------------------------- calendars


def in_live_window(fixtures: DataFrame, now: Column, hours: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Rounds with a match that kicked off in the last hours and is not over."""
    keys = keys or []
    provisional = F.col("finished_provisional") if "finished_provisional" in fixtures.columns else F.lit(False)
    over = fixture_is_played(F.col("finished"), provisional)
    started = F.col("kickoff_time").between(now - F.expr(f"INTERVAL {hours} HOURS"), now)
    return fixtures.filter(~over & started & F.col("event").isNotNull()).select(*keys, "event").distinct()


def next_deadline(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The earliest deadline of an unfinished round."""
    keys = keys or []
    return events.filter(~F.col("finished")).groupBy(*keys).agg(F.min("deadline_time").alias("next_deadline"))


def resolve_event(events: DataFrame, flag: str, legacy: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """The flagged round; else the payload's own integer, where one is given."""
    keys = keys or []
    flagged = F.min(F.when(F.coalesce(F.col(flag), F.lit(False)), F.col("id")))
    fallback = F.max(F.col(legacy)) if legacy else F.lit(None).cast("bigint")
    return events.groupBy(*keys).agg(F.coalesce(flagged, fallback).alias("event"))


# ---------------------------------------------------------------- evaluation


def attach_actuals(frozen: DataFrame, actuals: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with a recorded result, and their error."""
    joined = frozen.select(*keys, "prediction").join(actuals, keys)
    return joined.withColumn("error", F.col("prediction") - F.col("total_points"))


class MissingActuals(ValueError):
    """A frozen round has no recorded results yet."""


def require_actuals(frozen: DataFrame, actuals: DataFrame, keys: list[str]) -> None:
    """Fail by name if a frozen round is not recorded at all: it would otherwise vanish from every figure."""
    missing = frozen.select(*keys).distinct().join(actuals.select(*keys).distinct(), keys, "left_anti")
    some = missing.orderBy(*keys).limit(5).collect()
    if some:
        raise MissingActuals(f"no actuals for {', '.join(str(row.asDict()) for row in some)}: record them before evaluating")


def evaluate_players(frozen: DataFrame, actuals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per frozen round: size, MAE and mean within-position rank correlation. A round without any actuals is an error."""
    keys = keys or ["gw"]
    require_actuals(frozen, actuals, keys)
    rows = attach_actuals(frozen, actuals, [*keys, "element_id"])
    ranks = spearman_within(rows, keys).filter(F.col("position") == "mean").select(*keys, F.col("spearman").alias("spearman_mean"))
    return error_metrics(rows, keys).drop("rmse").join(ranks, keys, "left")


def calibrate_players(
    frozen: DataFrame, actuals: DataFrame, keys: list[str] | None = None, by: list[str] | None = None
) -> DataFrame:
    """Calibration bins of the frozen predictions, per `by` (default: per round). A round without any actuals is an error."""
    keys = keys or ["gw"]
    require_actuals(frozen, actuals, keys)
    return calibration(attach_actuals(frozen, actuals, [*keys, "element_id"]), by or keys)


def cumulative_compare(real: DataFrame, shadow: DataFrame, keys: tuple[str, ...] = ("entry",)) -> DataFrame:
    """Real and shadow points per round, running totals and their gap.

    Only rounds on both sides count. Neither side subtracts hit costs. At most
    13 rounds of one squad are mostly noise: log them, do not judge by them.
    """
    k = list(keys)
    both = real.select(*k, "gw", F.col("points").alias("real_points")).join(
        shadow.select(*k, "gw", F.col("points").alias("shadow_points")), [*k, "gw"]
    )
    so_far = Window.partitionBy(*k).orderBy("gw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = both.withColumns(
        {
            "cumulative_real": F.sum("real_points").over(so_far),
            "cumulative_shadow": F.sum("shadow_points").over(so_far),
        }
    )
    return total.withColumn("shadow_minus_real", F.col("cumulative_shadow") - F.col("cumulative_real"))


# The states a criterion can have.
PASS, FAIL = "PASS", "FAIL"
NOT_ENOUGH, NOT_WIRED, NOT_TRACKED = "insufficient data", "not wired to live baselines yet", "not tracked"


def gate_status(player_eval: DataFrame, squad_eval: DataFrame, price_eval: DataFrame, rounds: int = LAUNCH_ROUNDS) -> DataFrame:
    """The five launch criteria, one row each: state, what it rests on, and whether all pass.

    `player_eval` and `squad_eval` have a row per evaluated round (and more keys),
    `price_eval` is the one row of `metrics.hit_rate`. Four criteria have no live measurement
    and never pass, whatever the data.
    """
    one = price_eval.withColumns(
        {"_players": player_eval.agg(F.count_distinct("gw")).scalar(), "_squads": squad_eval.agg(F.count_distinct("gw")).scalar()}
    )
    played = lambda column: F.concat(F.col(column).cast("string"), F.lit(f" of {rounds} rounds"))
    live = F.when(F.col("_players") >= rounds, NOT_WIRED).otherwise(NOT_ENOUGH)
    price = F.when(F.col("hit_rate").isNull(), NOT_ENOUGH).when(F.col("hit_rate") > 0.5, PASS).otherwise(FAIL)
    share = lambda c: F.format_string("%.2f", F.col(c))
    moves = F.concat(F.col("n_moves_predicted").cast("string"), F.lit(" moves predicted for "), F.col("n").cast("string"), F.lit(" players"))
    hits = F.concat(F.lit("hit rate "), share("hit_rate"), F.lit(" ("), share("ci_low"), F.lit(" to "), share("ci_high"), F.lit("), "), moves)
    # The criteria's names.
    entries = {
        "beats_fixture_adjusted_trailing_mean_mae": (live, F.concat(played("_players"), F.lit(", baselines do not run on live rounds")), "_players"),
        "beats_baselines_on_rank_correlation": (live, F.concat(played("_players"), F.lit(", baselines do not run on live rounds")), "_players"),
        "no_leakage_assertion_fired": (F.lit(NOT_TRACKED), F.lit("checked in walks over past seasons only"), "_players"),
        "squad_reconstruction_ran_13_consecutive_gws_without_manual_correction": (
            F.lit(NOT_TRACKED), F.concat(played("_squads"), F.lit(" have frozen squads and actuals, corrections are not logged")), "_squads",
        ),
        "price_change_model_reports_hit_rate_with_ci": (price, F.when(F.col("hit_rate").isNull(), moves).otherwise(hits), "_players"),
    }
    table = F.array(
        *[F.struct(F.lit(c).alias("criterion"), s.alias("status"), d.alias("detail"), F.col(k).alias("gameweeks")) for c, (s, d, k) in entries.items()]
    )
    rows = one.withColumn("_t", table)
    ready = F.forall("_t", lambda e: e["status"] == PASS)
    return rows.select(F.explode("_t").alias("_e"), ready.alias("ready_to_launch")).select("_e.*", "ready_to_launch")
