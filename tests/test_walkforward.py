import pytest
from conftest import as_dict, day, make_fact
from pyspark.sql import functions as F

from touchline.operators import merge
from touchline.operators import trailing as tr
from touchline.operators import validation as val
from touchline.plans import models, walkforward as wf
from touchline.rules import RULES_2024_25, RULES_2025_26
from touchline.sources import store


def series(values, **extra):
    return [dict(gw=i + 1, total_points=v, goals_scored=v, **extra) for i, v in enumerate(values)]


def at(df, gw, element=1):
    return df.filter((F.col("gw") == gw) & (F.col("element_id") == element)).first()


def test_trailing_mean_uses_the_last_rows_before_the_round(spark):
    fact = make_fact(spark, [*series([0, 1, 2, 1, 0, 99])])
    row = at(tr.trailing_mean(fact, ["goals_scored"]), 6)
    assert row["goals_scored_trailing"] == pytest.approx(0.8) and row["n_games"] == 5
    assert at(tr.trailing_mean(fact, ["goals_scored"], 2), 6)["goals_scored_trailing"] == pytest.approx(0.5)


def test_single_target_matches_the_frame(spark):
    fact = make_fact(spark, series([2, 4, 6, 8, 10, 0]))
    state = tr.trailing_state(fact, 5, ["total_points"], 3).first()
    assert state["total_points_trailing"] == 8.0 == at(tr.trailing_mean(fact, ["total_points"], 3), 6)["total_points_trailing"]


def test_minutes_distribution(spark):
    fact = make_fact(spark, [dict(gw=i + 1, minutes=m) for i, m in enumerate([0, 90, 45, 90, 0, 7])])
    row = at(tr.minutes_distribution(fact, 5), 6)
    assert (row["p_blank"], row["p_short"], row["p_full"]) == pytest.approx((0.4, 0.2, 0.4))


def test_pools_prefer_promoted_peers_then_position_then_zero(spark):
    fact = make_fact(
        spark,
        [
            dict(gw=1, element_id=1, is_promoted_club=True, total_points=8),
            dict(gw=1, element_id=2, is_promoted_club=True, total_points=4),
            dict(gw=1, element_id=3, total_points=1),
            dict(gw=2, element_id=4, is_promoted_club=True),
            dict(gw=2, element_id=5, position="FWD"),
        ],
    )
    got = as_dict(tr.trailing_feature(fact, ["total_points"]).filter("gw = 2"), "element_id", "total_points_trailing")
    assert got == {4: 6.0, 5: 0.0}
    fact = make_fact(spark, [dict(gw=1, element_id=1, total_points=3), dict(gw=2, element_id=2, is_promoted_club=True)])
    got = as_dict(tr.trailing_feature(fact, ["total_points"]).filter("gw = 2"), "element_id", "total_points_trailing")
    assert got == {2: 3.0}


def test_threshold_rate_skips_unknown_counts_before_taking_the_last_five(spark):
    counts = [12, None, 12, 1, None, 1, 12, None, 0]
    fact = make_fact(spark, [dict(gw=i + 1, defensive_contribution=c) for i, c in enumerate(counts)])
    rate = lambda rules: at(tr.with_threshold_hits(fact, rules).withColumn("p", tr.threshold_rate()), 9)["p"]
    assert rate(RULES_2025_26) == pytest.approx(3 / 5) and rate(RULES_2024_25) == 0.0


def test_form_drops_what_is_older_than_thirty_days(spark):
    fact = make_fact(
        spark,
        [dict(gw=1, total_points=10, kickoff_time=day(0)), dict(gw=2, total_points=4, kickoff_time=day(40)), dict(gw=3, kickoff_time=day(47))],
    )
    got = wf.walk_forward(fact, ["form"])
    assert at(got, 3)["prediction"] == 4.0


def test_baselines_and_difficulty(spark):
    rows = series([2, 4, 6, 8, 10, 0])
    rows[5]["opponent_difficulty"] = 5.0
    got = wf.walk_forward(make_fact(spark, rows), models.BASELINES).filter("gw = 6")
    by = as_dict(got, "baseline", "prediction")
    assert by["trailing_mean"] == 6.0
    assert by["fixture_adjusted"] == pytest.approx(6.0 * (1 - 2 * 0.075))


def test_certain_starter_with_a_goal_a_game(spark):
    fact = make_fact(spark, [dict(gw=g, position="FWD", goals_scored=1, minutes=90, total_points=6) for g in range(1, 7)])
    got = at(wf.walk_forward(fact, ["event_model"], RULES_2024_25), 6)
    assert got["prediction"] == pytest.approx(6.0)


def test_horizon_differs_only_by_difficulty(spark):
    fact = make_fact(spark, [dict(gw=g, position="FWD", goals_scored=1) for g in range(1, 4)])
    roster = spark.createDataFrame([("s", 1, "A", "FWD", False)], "season string, element_id bigint, team string, position string, is_promoted_club boolean")
    difficulty = spark.createDataFrame([("s", "A", 5, 5.0)], "season string, team string, gw bigint, custom_difficulty double")
    got = as_dict(wf.project_horizon(fact, roster, RULES_2024_25, difficulty, [4, 5]), "gw", "prediction")
    assert got[4] == pytest.approx(6.0) and got[5] == pytest.approx(2 + 4 * 0.85)


def test_every_target_round_but_the_first(spark):
    fact = make_fact(spark, [dict(gw=g, element_id=e, total_points=(e * g) % 12) for g in range(1, 7) for e in range(1, 5)])
    got = wf.walk_forward(fact, models.BASELINES)
    assert got.count() == 5 * 4 * 3 and got.filter("gw = 1 OR prediction IS NULL").count() == 0


def test_relabelled_row_fails_the_walk(spark):
    rows = [dict(gw=g, element_id=e) for g in range(1, 7) for e in range(1, 5)]
    rows.append(dict(gw=2, element_id=9, kickoff_time=day(7 * 6)))
    fact = make_fact(spark, rows)
    with pytest.raises(Exception, match="not before deadline"):
        wf.walk_forward(fact, models.BASELINES).collect()
    assert val.leakage_violations(tr.walk_calendar(fact)).filter("gw > 1").count() > 0


def test_leakage_is_strict_and_reports_offenders(spark):
    rows = [(i, day(1) if i < 7 else day(0), day(1)) for i in range(9)] + [(9, None, day(1))]
    df = spark.createDataFrame(rows, "element_id bigint, available_at timestamp, deadline timestamp")
    assert val.leakage_violations(df).count() == 8
    with pytest.raises(val.LeakageError, match=r"8 feature\(s\).*\+3 more"):
        val.assert_no_leakage(df)
    shown = val.sample_violations(val.leakage_violations(df), ["element_id"]).collect()
    assert len(shown) == 5 and shown[0]["n_more"] == 3
    val.assert_no_leakage(df.filter("element_id in (7, 8)"))


@pytest.fixture
def table_model():
    yield models.register_table_model
    models.TABLE_MODELS.clear()


def test_table_models_join_the_same_walk(spark, table_model):
    fact = make_fact(spark, series([1, 2, 3]))
    table_model("constant", lambda train, roster: roster.select("season", "gw", "element_id", F.lit(5).alias("prediction")))
    got = wf.walk_forward(fact, ["constant", "trailing_mean"])
    assert as_dict(got.filter("gw = 3"), "baseline", "error") == {"constant": 2.0, "trailing_mean": -1.5}


def test_table_models_see_only_rounds_before_their_target(spark, table_model):
    rows = [dict(season=s, gw=g, element_id=e, total_points=100 * g + e) for s in "ab" for g in (1, 2, 3, 5, 6) for e in (1, 2)]
    fact = make_fact(spark, rows)
    train, roster = wf.point_in_time(fact)
    seen = {(r["season"], r["target_gw"], r["gw"]) for r in train.collect()}
    rounds = (1, 2, 3, 5, 6)
    assert seen == {(s, target, g) for s in "ab" for target in rounds for g in rounds if g < target}
    assert {(r["target_gw"], r["gw"]) for r in wf.point_in_time(fact, 2)[0].collect()} == {(2, 1), (3, 1), (3, 2), (5, 3), (6, 5)}
    assert roster.filter("gw = 1").count() == 0 and not set(wf.ACTUAL_COLUMNS) & set(roster.columns)
    # a model by hand, target by target, gives the same
    table_model("total", lambda train, roster: roster.join(
        train.groupBy("season", F.col("target_gw").alias("gw"), "element_id").agg(F.sum("total_points").alias("prediction")), ["season", "gw", "element_id"]))
    got = {(r["season"], r["gw"], r["element_id"]): r["prediction"] for r in wf.walk_forward(fact, ["total"]).collect()}
    assert got == {(s, g, e): float(sum(100 * h + e for h in rounds if h < g)) for s in "ab" for g in rounds[1:] for e in (1, 2)}


def test_a_peeking_table_model_is_stopped(spark, table_model):
    fact = make_fact(spark, series([1, 2, 3]))
    table_model("peek", lambda train, roster: roster.withColumn("prediction", F.col("total_points")))
    with pytest.raises(Exception, match="total_points"):
        wf.walk_forward(fact, ["peek"]).collect()
    # the outcome of the target round is not in train either: nothing joins
    table_model("peek", lambda train, roster: train.filter("gw = target_gw").withColumn("prediction", F.col("total_points")))
    assert wf.walk_forward(fact, ["peek"]).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_walk_exchanges_no_fact_rows(spark):
    """The merge deals rows by (season, player) once; windows, merge and storage share that, and the walk has no exchange of its own."""
    fixtures = make_fact(spark, [dict(gw=g, element_id=e) for g in range(1, 7) for e in range(1, 30)]).withColumn("fixture", F.col("gw"))
    columns = [c for c in merge.FACT_COLUMNS if c not in fixtures.columns]
    full = fixtures.withColumns({c: F.lit(None).cast("string" if c in ("was_home", "opponent_team") else "bigint") for c in columns})
    merged = merge.merge_fixtures(full.withColumn("was_home", F.lit(True)))
    windowed = tr.trailing_mean(merged, ["total_points"])
    assert plan_of(windowed).count("Exchange") == 1 and "hashpartitioning(season" in plan_of(windowed)
    fact = store.materialize_by(merged, merge.PLAYER_KEY)
    difficulty = spark.createDataFrame([("s", "A", 5, 5.0)], "season string, team string, gw bigint, custom_difficulty double")
    plan = plan_of(wf.walk_forward(fact, [*models.BASELINES, "event_model"], {"s": RULES_2025_26}, difficulty))
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    # what is left deals the cells of the rounds
    assert all("season" in line and "element_id" not in line for line in exchanges) and "Bucketed: true" in plan
    assert "SortMergeJoin" not in plan and fact.count() == 6 * 29


def test_frozen_rounds_are_held_against_the_fact_they_were_walked_on(spark, monkeypatch):
    """The fact is merged and stored once, with the columns that a walk reads."""
    from catalog import queries

    rows = make_fact(spark, [dict(gw=g, element_id=e, total_points=e + g) for g in range(1, 5) for e in range(1, 6)])
    built = []

    def fact(t, columns=merge.FACT_COLUMNS):
        built.append(columns)
        return rows.select(*[c for c in columns if c in rows.columns])

    monkeypatch.setattr(queries, "fact", fact)
    for name in ("evaluate_players", "calibrate_players"):
        built.clear()
        assert getattr(queries, name)(None).count() > 0
        assert built == [wf.WALK_COLUMNS]
