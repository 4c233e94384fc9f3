"""The registered queries: (session, table folder) -> DataFrame.

Every query reads whole tables. Computed doubles that come out of sums in no
fixed order are rounded to six digits, as in the checking SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import PROMOTED, RULES_BY_SEASON, Tables
from touchline.functions import market, parsing, scoring
from touchline.functions.difficulty import elo_expected
from touchline.operators import forward, merge, metrics, ranks, ratings, segments, snapshots, squad, swaps, trailing
from touchline.operators import validation as val
from touchline.plans import walkforward as wf
from touchline.sources import payloads, store
from touchline.sources.store import materialize
from touchline.plans.models import BASELINES, register_table_model
from touchline.session import ship_package, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FIXTURE_ORDER = ("kickoff_time", "fixture", "line", "part")


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register a function of the tables under its own name; the session is tuned and the package goes to the workers first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        ship_package(spark)
        return build(Tables(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Six digits; the offset keeps exact decimal ties away from the rounding edge."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in columns})


# ---------------------------------------------------------------- fact table


def fact(t: Tables, columns: list[str] = merge.FACT_COLUMNS) -> DataFrame:
    promoted = F.expr(PROMOTED.format("season", "team"))
    return merge.normalize_season(t.player_fixture, t.fixture_difficulty, t.teams, promoted, FIXTURE_ORDER, columns)


def stored_fact(t: Tables, columns: list[str] = wf.EVENT_COLUMNS) -> DataFrame:
    """The fact table as walk-forward reads it: written once, dealt by (season, player), with the columns a walk reads."""
    return store.materialize_by(fact(t, columns), merge.PLAYER_KEY)


@query
def normalize_season(t: Tables) -> DataFrame:
    return r6(fact(t), *merge.DECIMAL_STATS)


@query
def score_components(t: Tables) -> DataFrame:
    """Nine components and total per player and fixture, by season rules."""
    rows = scoring.score(merge.drop_non_players(t.player_fixture), RULES_BY_SEASON)
    return rows.select(
        "season", "element_id", "fixture", "line", "part", *[f"pts_{c}" for c in scoring.COMPONENTS], "points", "total_points"
    )


@query
def bonus_system_points(t: Tables) -> DataFrame:
    rows = t.player_fixture.filter(F.col("position") != "AM")
    return scoring.with_bps(rows, RULES_BY_SEASON).select("season", "element_id", "fixture", "line", "part", "bps_points")


@query
def replay_match_rate(t: Tables) -> DataFrame:
    """Recomputed against recorded points on merged rows, per season."""
    return scoring_replay(fact(t)).groupBy("season").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("points_match").alias("n_exact_match"),
        F.avg(F.col("points_match").cast("int")).alias("match_rate"),
    )


@query
def replay_discrepancies(t: Tables) -> DataFrame:
    return scoring_replay(fact(t)).filter(~F.col("points_match")).select(
        "season", "gw", "element_id", "name", "position", "n_fixtures", "total_points", "predicted_points"
    )


def scoring_replay(rows: DataFrame) -> DataFrame:
    return scoring.replay(rows, RULES_BY_SEASON)


# ------------------------------------------------------------- trailing rows


@query
def trailing_mean(t: Tables) -> DataFrame:
    columns = ["total_points", "minutes", "goals_scored"]
    rows = trailing.trailing_mean(fact(t), columns)
    return rows.select(*merge.FACT_KEY, *[f"{c}_trailing" for c in columns], "n_games")


@query
def minutes_distribution(t: Tables) -> DataFrame:
    return trailing.minutes_distribution(fact(t)).select(*merge.FACT_KEY, "p_blank", "p_short", "p_full")


@query
def expanding_pools(t: Tables) -> DataFrame:
    return trailing.expanding_pools(fact(t), ["total_points", "saves"])


@query
def trailing_feature(t: Tables) -> DataFrame:
    """Trailing mean with the (position, promoted) and position priors."""
    rows = trailing.trailing_feature(stored_fact(t, wf.WALK_COLUMNS), ["total_points"])
    return rows.select(*merge.FACT_KEY, "total_points_trailing")


@query
def threshold_rate(t: Tables) -> DataFrame:
    return trailing.with_threshold_hits(fact(t), RULES_BY_SEASON).select(*merge.FACT_KEY, trailing.threshold_rate().alias("p_threshold"))


@query
def trailing_state(t: Tables) -> DataFrame:
    """One target: every player's trailing means after round 20."""
    return trailing.trailing_state(fact(t), 20, ["total_points", "minutes"])


@query
def walk_calendar(t: Tables) -> DataFrame:
    return trailing.walk_calendar(fact(t))


# -------------------------------------------------------------- walk forward


def baselines(t: Tables) -> DataFrame:
    return wf.walk_forward(stored_fact(t, wf.WALK_COLUMNS), BASELINES)


def difficulty(t: Tables) -> DataFrame:
    rated = ratings.elo_ratings(ratings.match_results(t.matches), ("season", "competition"))
    return ratings.team_difficulty(rated, t.teams)


def all_models(t: Tables) -> DataFrame:
    return wf.compare_models(stored_fact(t), RULES_BY_SEASON, difficulty(t))


@query
def walk_forward_baselines(t: Tables) -> DataFrame:
    return baselines(t)


def position_form(train: DataFrame, roster: DataFrame) -> DataFrame:
    """A table model: mean points of the position over the five rounds before the target."""
    means = train.groupBy("season", F.col("target_gw").alias("gw"), "position").agg(F.avg("total_points").alias("prediction"))
    return roster.join(means, ["season", "gw", "position"])


@query
def point_in_time_model(t: Tables) -> DataFrame:
    register_table_model("position_form", position_form, lookback=5)
    rows = wf.walk_forward(stored_fact(t, wf.WALK_COLUMNS), ["position_form"])
    return r6(rows.select("season", "gw", "element_id", "baseline", "position", "prediction", "error"), "prediction", "error")


@query
def event_projection(t: Tables) -> DataFrame:
    """Projected rates of the event model for every target row."""
    frame = wf.walk_features(stored_fact(t), RULES_BY_SEASON, None, form=False).filter(F.col("gw") >= 2)
    return frame.select(
        *merge.FACT_KEY, *[f"{c}_trailing" for c in trailing.TRAILING_EVENTS], "p_blank", "p_short", "p_full", "p_threshold"
    )


@query
def event_model(t: Tables) -> DataFrame:
    rows = wf.walk_forward(stored_fact(t), ["event_model"], RULES_BY_SEASON, difficulty(t))
    return r6(rows.select("season", "gw", "element_id", "position", "prediction", "error"), "prediction", "error")


@query
def model_comparison(t: Tables) -> DataFrame:
    """MAE, RMSE and mean within-position Spearman per (season, model) and pooled."""
    return r6(metrics.summarize(all_models(t)), "mae", "rmse", "spearman_mean")


@query
def leakage_check(t: Tables) -> DataFrame:
    """Targets whose history is not complete strictly before the deadline.

    A gap of no time at all: a round's first kickoff is its deadline, so the
    round before it must have ended earlier.
    """
    return val.leakage_violations(trailing.walk_calendar(fact(t))).select("season", "gw", "deadline", "available_at")


@query
def component_decomposition(t: Tables) -> DataFrame:
    rows = materialize(wf.decompose(stored_fact(t), RULES_BY_SEASON, difficulty(t)))
    return r6(metrics.component_mae(rows, ["season"]), "mae")


@query
def minutes_scorecard(t: Tables) -> DataFrame:
    rows = wf.decompose(stored_fact(t), RULES_BY_SEASON, None)
    return r6(metrics.minutes_scorecard(rows, ["season"]), "brier_blank", "brier_short", "brier_full", "mae_expected_minutes")


# ------------------------------------------------------------------- metrics


@query
def error_metrics(t: Tables) -> DataFrame:
    return r6(metrics.error_metrics(baselines(t), ["season", "baseline"]), "mae", "rmse")


@query
def pearson(t: Tables) -> DataFrame:
    return r6(metrics.pearson(baselines(t), "prediction", "total_points", ["season", "baseline"]), "pearson")


@query
def spearman(t: Tables) -> DataFrame:
    return r6(metrics.spearman(baselines(t), "prediction", "total_points", ["baseline"]), "spearman")


@query
def spearman_within_position(t: Tables) -> DataFrame:
    return r6(metrics.spearman_within(baselines(t), ["season", "baseline"]), "spearman")


@query
def average_rank(t: Tables) -> DataFrame:
    rows = ranks.average_rank(t.events.select("event_id", "event_type", "value"), ["event_type"], "value")
    return rows


@query
def calibration(t: Tables) -> DataFrame:
    return r6(metrics.calibration(baselines(t), ["baseline"]), "mean_prediction", "mean_actual")


@query
def error_by_event(t: Tables) -> DataFrame:
    return r6(metrics.error_by_event(baselines(t), ["season", "baseline"]), "mae")


@query
def long_report(t: Tables) -> DataFrame:
    return r6(metrics.long_report(baselines(t)), "value")


# ------------------------------------------------------------------- ratings


@query
def elo_ratings(t: Tables) -> DataFrame:
    rated = ratings.elo_ratings(ratings.match_results(t.matches), ("season", "competition"))
    return r6(
        rated.select("season", "competition", "fixture", "event", "team_h", "team_a", "elo_home_pre", "elo_away_pre"),
        "elo_home_pre", "elo_away_pre",
    )


@query
def final_ratings(t: Tables) -> DataFrame:
    rated = ratings.elo_ratings(ratings.match_results(t.matches), ("season", "competition"))
    return r6(ratings.final_ratings(rated, ("season", "competition")), "elo")


@query
def team_difficulty(t: Tables) -> DataFrame:
    return r6(difficulty(t), "custom_difficulty")


@query
def compare_difficulty(t: Tables) -> DataFrame:
    rated = ratings.elo_ratings(ratings.match_results(t.matches), ("season", "competition"))
    rows = ratings.compare_difficulty(rated, t.fixture_difficulty)
    wanted = ["season", "fixture", "custom_difficulty_home", "custom_difficulty_away", "team_h_difficulty", "team_a_difficulty"]
    return r6(rows.select(*wanted), "custom_difficulty_home", "custom_difficulty_away")


@query
def upcoming_difficulty(t: Tables) -> DataFrame:
    """Next season's fixtures on last season's final ratings, moved by name.

    This season's ids differ from last season's: the club that was n is now
    (n + 7) mod 25, and three clubs are new to it under names of their own.
    """
    rated = ratings.elo_ratings(ratings.match_results(t.matches), ("season", "competition"))
    final = ratings.final_ratings(rated, ("season", "competition"))
    later = final.withColumn("season", (F.col("season").cast("int") + 1).cast("string"))
    name = F.when(F.col("id") % 9 == 0, F.concat(F.lit("NEW "), "name")).otherwise(F.col("name"))
    new_teams = t.teams.withColumns({"id": (F.col("id") + 7) % 25, "name": name})
    bridged = ratings.bridge_by_name(later, t.teams, new_teams, ("season", "competition"))
    fixtures = t.matches.select("season", "competition", "event", "team_h", "team_a")
    rows = ratings.upcoming_difficulty(bridged, fixtures, t.teams, ("season", "competition"), ("season",))
    return r6(rows, "custom_difficulty")


@query
def elo_expected_score(t: Tables) -> DataFrame:
    rated = ratings.elo_ratings(ratings.match_results(t.matches), ("season", "competition"))
    expected = elo_expected(F.col("elo_home_pre") + 60.0, F.col("elo_away_pre"))
    return r6(rated.select("season", "fixture", expected.alias("expected_home")), "expected_home")


@query
def teams_played(t: Tables) -> DataFrame:
    return ratings.teams_played(t.matches, ["season", "event"])


# ----------------------------------------------------------------- snapshots

AS_OF = datetime(2024, 1, 20, 12)
DEADLINE = datetime(2024, 1, 15)
STEP = ("snapshot_ts", "event_id")


@query
def latest_state(t: Tables) -> DataFrame:
    return snapshots.latest_state(t.snapshots, order=STEP)


@query
def latest_state_per_gw(t: Tables) -> DataFrame:
    return snapshots.latest_state(t.snapshots, ["gw", "element_id"], STEP).select("gw", "element_id", "event_id", "now_cost", "status")


@query
def state_as_of(t: Tables) -> DataFrame:
    return snapshots.state_as_of(t.snapshots, AS_OF, order=STEP)


@query
def changed_rows(t: Tables) -> DataFrame:
    """Change-only series over the coarse columns, re-based every round."""
    rows = snapshots.changed_rows(t.snapshots, ["now_cost", "status"], order=STEP)
    return rows.select("gw", "element_id", "event_id", "snapshot_ts", "now_cost", "status")


@query
def compare_state(t: Tables) -> DataFrame:
    """The states at one instant that differ from those three days earlier."""
    new, old = snapshots.state_as_of(t.snapshots, AS_OF, order=STEP), snapshots.state_as_of(t.snapshots, DEADLINE, order=STEP)
    return snapshots.compare_state(new, old, ["now_cost", "status"]).select("element_id", "now_cost", "status")


def deltas(t: Tables) -> DataFrame:
    return snapshots.compute_deltas(t.snapshots, AS_OF, snapshots.reference_times(AS_OF, DEADLINE), order=STEP)


@query
def compute_deltas(t: Tables) -> DataFrame:
    rows = deltas(t)
    return r6(rows, *[c for c, kind in rows.dtypes if kind == "double"])


@query
def state_pair(t: Tables) -> DataFrame:
    return snapshots.state_pair(t.snapshots, DEADLINE, AS_OF, ["now_cost", "status"], order=STEP)


@query
def as_of_join(t: Tables) -> DataFrame:
    """For each purchase the user's latest non-purchase snapshot before it."""
    bought = t.snapshots.filter(F.col("status") == "purchase").select("element_id", "snapshot_ts", "event_id", "ep_next")
    other = t.snapshots.filter(F.col("status") != "purchase").select("element_id", "snapshot_ts", "event_id", "now_cost")
    rows = segments.as_of_join(bought, other, ["element_id"], "snapshot_ts", "snapshot_ts", ["event_id", "now_cost"], ["event_id"], segment="day")
    return rows.select(
        "element_id", "event_id", "ep_next", F.col("matched.event_id").alias("seen_event_id"), F.col("matched.now_cost").alias("seen_cost")
    )


@query
def retention_filter(t: Tables) -> DataFrame:
    """Rows by news time, 10 days kept; rows without news stay."""
    return snapshots.retention_filter(t.snapshots, "news_added", 10, AS_OF).select("event_id", "news_added")


@query
def flatten_snapshots(t: Tables) -> DataFrame:
    """Snapshots packed into JSON payloads and parsed back to typed rows."""
    text = lambda c: F.when(F.col("event_id") % 10 == 0, F.lit("")).otherwise(F.col(c).cast("string"))
    element = F.struct(
        F.col("element_id").alias("id"), "now_cost", text("selected_by_percent").alias("selected_by_percent"),
        "transfers_in_event", "transfers_out_event", F.col("form").cast("string").alias("form"), "status",
        "chance_of_playing_next_round", text("ep_next").alias("ep_next"), F.lit("x").alias("unmodelled"),
    )
    raw = t.snapshots.select("event_id", F.to_json(F.struct(F.array(element).alias("elements"))).alias("payload"))
    return payloads.flatten_snapshots(raw, ("event_id",)).drop("news_added")


@query
def extra_fields(t: Tables) -> DataFrame:
    """Unknown field names of event properties and how often they occur."""
    raw = t.events.select(F.col("props").alias("payload"))
    return payloads.extra_fields(raw, payloads.ELEMENT_SUMMARY)


@query
def contract_report(t: Tables) -> DataFrame:
    from touchline.schemas import fields

    wanted = fields("element_id now_cost chance_of_playing_next_round news_added:timestamp")
    return payloads.contract_report(t.snapshots, wanted)


# -------------------------------------------------------------------- market


@query
def ownership_acceleration(t: Tables) -> DataFrame:
    return r6(market.ownership_acceleration(deltas(t)), "ownership_delta_short", "ownership_delta_long", "ownership_acceleration")


@query
def transfer_velocity(t: Tables) -> DataFrame:
    return r6(market.transfer_velocity(deltas(t), "24h", 24.0), "transfer_velocity")


@query
def price_pressure(t: Tables) -> DataFrame:
    return r6(market.price_pressure(deltas(t), "24h"), "price_change_pressure")


@query
def price_directions(t: Tables) -> DataFrame:
    from touchline.plans.prices import price_outcomes

    return r6(price_outcomes(t.snapshots, DEADLINE, AS_OF, "72h", order=STEP), "price_change_pressure")


@query
def price_model(t: Tables) -> DataFrame:
    from touchline.plans.prices import price_model as evaluate

    return r6(evaluate(t.snapshots, DEADLINE, AS_OF, "72h", order=STEP), "hit_rate", "ci_low", "ci_high")


# -------------------------------------------------------------------- squads

START, END_LOG = datetime(1990, 1, 1), datetime(2000, 6, 30)


@query
def activity_per_gw(t: Tables) -> DataFrame:
    return squad.activity_per_gw(t.transfers, t.chips)


@query
def free_transfers(t: Tables) -> DataFrame:
    activity = squad.activity_per_gw(t.transfers, t.chips)
    last_event = t.transfers.agg(F.max("event")).first()[0] or 2
    states = squad.free_transfers(t.banks, activity, last_event)
    return states.withColumn("hit_points", market.hit_points(F.col("hit_count")))


def state(t: Tables) -> DataFrame:
    return squad.squad_state(t.picks, t.transfers, F.lit(START), F.lit(END_LOG), t.pool.select("element_id", "now_cost"))


@query
def squad_state(t: Tables) -> DataFrame:
    return state(t)


@query
def bank_after(t: Tables) -> DataFrame:
    return squad.bank_after(t.banks, t.transfers, F.lit(START), F.lit(END_LOG))


@query
def validate_log(t: Tables) -> DataFrame:
    """Sales that do not fit the first picks when some moves record the bought player as sold."""
    sold = F.when(F.col("seq") % 37 == 0, F.col("element_in")).otherwise(F.col("element_out"))
    return squad.validate_log(t.picks, t.transfers.withColumn("element_out", sold)).select("entry", "seq", "element_id")


def squads(t: Tables) -> DataFrame:
    """Initial squads with prices, positions and clubs."""
    priced = squad.refresh_prices(t.picks, t.pool.select("element_id", "now_cost"))
    return priced.join(t.pool.select("element_id", "position", "club"), "element_id")


@query
def legality(t: Tables) -> DataFrame:
    return squad.legality(squads(t), t.banks)


@query
def best_lineup(t: Tables) -> DataFrame:
    rows = squad.best_lineup(squads(t), t.projections, [1, 2, 3])
    return rows.select("entry", "gw", "element_id", "in_xi", "is_captain", "is_vice_captain", "bench_order")


@query
def lineup_points(t: Tables) -> DataFrame:
    """Points of every squad in each of three rounds."""
    rounds = t.picks.withColumn("gw", F.explode(F.array(*[F.lit(g).cast("bigint") for g in (1, 2, 3)])))
    return squad.lineup_points(rounds, t.pool_actuals)


def entry_banks(t: Tables) -> DataFrame:
    return t.banks.withColumn("free_transfers", F.col("entry") % 3)


def swap(t: Tables) -> DataFrame:
    return swaps.best_single_swap(squads(t), entry_banks(t), t.pool, t.projections, [1, 2, 3])


@query
def best_single_swap(t: Tables) -> DataFrame:
    return swap(t)


@query
def apply_moves(t: Tables) -> DataFrame:
    return squad.apply_moves(squads(t), materialize(swap(t)), t.pool, t.projections, 1)


@query
def squad_diff(t: Tables) -> DataFrame:
    return squad.squad_diff(t.picks, state(t))


@query
def pair_by_position(t: Tables) -> DataFrame:
    changes = materialize(squad.squad_diff(t.picks, state(t))).join(t.pool.select("element_id", "position"), "element_id")
    return squad.pair_by_position(changes.filter("direction = 'out'"), changes.filter("direction = 'in'"))


@query
def template_risk(t: Tables) -> DataFrame:
    """Last sold players that many others own."""
    sales = t.transfers.select("entry", "seq", F.col("element_out").alias("element_id"))
    return squad.template_risk(sales, t.pool)


@query
def resale_prices(t: Tables) -> DataFrame:
    rows = t.transfers.select(
        "seq", market.resale_price(F.col("element_in_cost"), F.col("element_out_cost")).cast("bigint").alias("resale_price")
    )
    return rows


@query
def candidate_frontier(t: Tables) -> DataFrame:
    """Pool players that some legal squad may have to buy, with all competitions as one pool."""
    points = swaps.horizon_points(t.projections, [1, 2, 3])
    x = F.coalesce("x", F.array(*[F.lit(0.0)] * 3))
    pool = t.pool.join(points, "element_id", "left").select("position", "club", "element_id", "now_cost", x.alias("x"))
    return swaps.candidate_frontier(pool, ("position", "club")).select("position", "element_id", "now_cost")


# ------------------------------------------------------------------- forward


def recorded(t: Tables) -> DataFrame:
    """Actuals store: every round but those that the matches say were never recorded."""
    gaps = t.round_records.filter(~F.col("recorded")).select("season", "gw")
    return fact(t).join(gaps, ["season", "gw"], "left_anti")


def target_round(t: Tables) -> int:
    return t.target_round.first()["target"]


def season_totals(t: Tables, gw: int) -> DataFrame:
    """Season-to-date totals after the round, one in seven revised downwards."""
    upto = fact(t).filter(F.col("gw") <= gw).groupBy("season", "element_id").agg(
        *[F.max_by(c, "gw").alias(c) for c in ("position", "team", "is_promoted_club")],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in forward.STAT_COLUMNS],
    )
    return upto.withColumn("minutes", F.when(F.col("element_id") % 7 == 0, F.col("minutes") - 500).otherwise(F.col("minutes")))


def played_teams(t: Tables, gw: int) -> DataFrame:
    played = ratings.teams_played(t.matches, ["season", "event"]).filter(F.col("event") == gw)
    return played.join(t.teams.select(F.col("id").alias("team_id"), F.col("name").alias("team")), "team_id").select("season", "team")


@query
def build_train(t: Tables) -> DataFrame:
    gw = target_round(t)
    return forward.build_train(recorded(t), season_totals(t, gw), played_teams(t, gw), gw)


@query
def totals_before(t: Tables) -> DataFrame:
    return forward.totals_before(recorded(t), target_round(t), ["season", "element_id"], ["minutes", "total_points"])


@query
def coverage(t: Tables) -> DataFrame:
    return forward.coverage(recorded(t), t.matches, target_round(t))


@query
def missing_periods(t: Tables) -> DataFrame:
    return forward.missing_periods(t.events_calendar, recorded(t), ["season"])


@query
def in_live_window(t: Tables) -> DataFrame:
    """Rounds with a match in the last three days that is not over."""
    return forward.in_live_window(t.matches, F.lit(datetime(1998, 5, 20)).cast("timestamp_ntz"), 72, ["season"])


@query
def next_deadline(t: Tables) -> DataFrame:
    return forward.next_deadline(t.events_calendar, ["season"])


@query
def resolve_event(t: Tables) -> DataFrame:
    """The current round: flagged in even seasons, the payload's integer in others."""
    calendar = t.events_calendar.withColumn("current_event", F.lit(9).cast("bigint"))
    return forward.resolve_event(calendar, "is_current", "current_event", ["season"])


def frozen_and_actuals(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Frozen predictions and the results to hold them against, which are the rows of the one stored fact."""
    stored = stored_fact(t, wf.WALK_COLUMNS)
    rows = wf.walk_forward(stored, ["trailing_mean"])
    return materialize(rows.select("season", "gw", "element_id", "prediction")), stored


@query
def evaluate_players(t: Tables) -> DataFrame:
    rows = forward.evaluate_players(*frozen_and_actuals(t), ["season", "gw"])
    return r6(rows, "mae", "spearman_mean")


@query
def calibrate_players(t: Tables) -> DataFrame:
    rows = forward.calibrate_players(*frozen_and_actuals(t), ["season", "gw"], ["season"])
    return r6(rows, "mean_prediction", "mean_actual")


def squad_eval(t: Tables) -> DataFrame:
    rounds = t.picks.withColumn("gw", F.explode(F.array(*[F.lit(g).cast("bigint") for g in (1, 2, 3)])))
    shadow = squad.lineup_points(rounds, t.pool_actuals)
    real = t.orders.groupBy(F.col("o_custkey").alias("entry"), (1 + F.col("o_orderkey") % 3).alias("gw")).agg(
        F.sum(F.col("o_orderkey") % 50).alias("points")
    )
    return forward.cumulative_compare(real, shadow)


@query
def evaluate_squads(t: Tables) -> DataFrame:
    return squad_eval(t)


@query
def gate_status(t: Tables) -> DataFrame:
    from touchline.plans.prices import price_model as evaluate

    prices = evaluate(t.snapshots, DEADLINE, AS_OF, "72h", order=STEP)
    return forward.gate_status(forward.evaluate_players(*frozen_and_actuals(t), ["season", "gw"]), squad_eval(t), prices)


@query
def latest_frozen(t: Tables) -> DataFrame:
    return store.latest_period(t.write_log)


@query
def project_horizon(t: Tables) -> DataFrame:
    """Rounds 21-23 of every season from the history up to 20."""
    stored = stored_fact(t)
    roster = stored.filter(F.col("gw") <= 20).groupBy("season", "element_id").agg(
        *[F.max_by(c, "gw").alias(c) for c in ("team", "position", "is_promoted_club")]
    )
    rows = wf.project_horizon(stored, roster, RULES_BY_SEASON, difficulty(t), [21, 22, 23])
    return r6(rows, "prediction")


# ---------------------------------------------------------------- validation


@query
def freeze_window_status(t: Tables) -> DataFrame:
    return val.freeze_window_status(t.write_log, 240).select("write_id", "freeze_status")


@query
def immutability_audit(t: Tables) -> DataFrame:
    return val.immutability_audit(t.write_log, ["entry", "gw"])


@query
def sample_violations(t: Tables) -> DataFrame:
    """The first five late writes, and how many more there are."""
    late = val.leakage_violations(t.write_log, "written_at", "deadline").select("write_id", "written_at")
    return val.sample_violations(late, ["written_at", "write_id"])


@query
def duplicate_keys(t: Tables) -> DataFrame:
    return val.duplicate_keys(t.write_log, ["entry", "gw"])


@query
def target_roster(t: Tables) -> DataFrame:
    """Element type codes to positions, team ids to names, promoted flag."""
    players = t.pool.select(F.col("element_id").alias("id"), (F.col("element_id") % 25).alias("team"), (1 + F.col("element_id") % 4).alias("element_type"))
    return payloads.target_roster(players, t.teams, ("T3", "T7", "T11"))


@query
def candidate_pool(t: Tables) -> DataFrame:
    players = t.pool.select(
        F.col("element_id").alias("id"), (F.col("element_id") % 25).alias("team"), (1 + F.col("element_id") % 4).alias("element_type"), "now_cost"
    )
    return payloads.candidate_pool(players, t.teams)


@query
def flatten_live(t: Tables) -> DataFrame:
    """Per-fixture stats packed as live payloads and joined to the roster."""
    stats = F.struct(*forward.STAT_COLUMNS, "bps")
    live = t.player_fixture.select(
        "gw", "fixture", "line", "part",
        F.to_json(F.struct(F.array(F.struct(F.col("element_id").alias("id"), stats.alias("stats"))).alias("elements"))).alias("payload"),
    )
    roster = t.supplier.select(
        F.col("s_suppkey").alias("element_id"), F.lit("MID").alias("position"), F.col("s_name").alias("team"), F.lit(False).alias("is_promoted_club")
    )
    rows = payloads.flatten_live(live, roster, ("gw", "fixture", "line", "part"))
    return rows.select("gw", "fixture", "line", "part", "element_id", "team", "minutes", "total_points", "defensive_contribution")


@query
def explode_entity_batch(t: Tables) -> DataFrame:
    """One document per order, keyed by entity, with its lines as history."""
    row = F.struct(
        F.col("element_id").alias("element"), "fixture", F.col("gw").alias("round"), "minutes", "total_points"
    )
    docs = t.player_fixture.select(
        "fixture", "line", "part",
        F.to_json(F.create_map(F.col("element_id").cast("string"), F.struct(F.array(row).alias("history")))).alias("payload"),
    )
    rows = payloads.explode_entity_batch(docs.withColumnRenamed("fixture", "doc_fixture"), ("doc_fixture", "line", "part"))
    return rows.drop("fixture")


@query
def parse_times(t: Tables) -> DataFrame:
    """Compact time texts written and parsed back; broken texts are null."""
    text = F.when(F.col("event_id") % 13 == 0, F.lit("not a time")).otherwise(parsing.compact_ts(F.col("ts")))
    parsed = parsing.parse_ts(text, parsing.COMPACT_TS)
    return t.events.select("event_id", parsed.cast("timestamp_ntz").alias("parsed"))
