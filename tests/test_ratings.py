from conftest import as_dict, day
import pytest

from touchline.operators import merge, ratings

MATCH = (
    "season string, fixture bigint, event bigint, team_h bigint, team_a bigint, team_h_score bigint, team_a_score bigint, kickoff_time timestamp"
)


def matches(spark, *rows):
    return spark.createDataFrame([("s", f, e, h, a, hs, as_, day(d)) for f, e, h, a, hs, as_, d in rows], MATCH)


def teams(spark):
    return spark.createDataFrame([(i, f"T{i}") for i in (10, 20, 30)], "id bigint, name string")


def test_home_win_is_zero_sum(spark):
    final = as_dict(ratings.final_ratings(ratings.elo_ratings(matches(spark, (1, 1, 10, 20, 3, 0, 0)))), "team_id", "elo")
    assert final[10] > 1500 > final[20] and final[10] - 1500 == pytest.approx(1500 - final[20])


def test_draw_of_equals_without_home_bonus(spark):
    rated = ratings.elo_ratings(matches(spark, (1, 1, 10, 20, 1, 1, 0)), home_advantage=0.0)
    assert as_dict(ratings.final_ratings(rated), "team_id", "elo") == pytest.approx({10: 1500.0, 20: 1500.0})


def test_pre_match_rating_ignores_its_own_result_and_input_order(spark):
    rows = [(1, 1, 10, 20, 3, 0, 0), (2, 2, 10, 30, 0, 0, 7), (3, 3, 20, 10, 1, 0, 14)]
    first = ratings.elo_ratings(matches(spark, *rows)).orderBy("fixture").collect()
    again = ratings.elo_ratings(matches(spark, *rows[::-1])).orderBy("fixture").collect()
    assert first == again
    assert first[0]["elo_home_pre"] == 1500.0 and first[1]["elo_home_pre"] == first[0]["elo_home_post"] and first[1]["elo_away_pre"] == 1500.0


def test_batches_carry_the_state(spark):
    rows = [(i, i, 10 if i % 2 else 20, 30, i % 3, i % 2, i) for i in range(300)]
    whole = as_dict(ratings.final_ratings(ratings.elo_ratings(matches(spark, *rows))), "team_id", "elo")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = as_dict(ratings.final_ratings(ratings.elo_ratings(matches(spark, *rows))), "team_id", "elo")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole == small


def test_difficulty_is_clamped_neutral_and_null_safe(spark):
    from pyspark.sql import functions as F

    from touchline.functions.difficulty import rating_difficulty

    df = spark.createDataFrame([(1500.0, 1560.0), (1000.0, 3000.0), (3000.0, 1000.0), (None, 1500.0)], "own double, opp double")
    got = [r[0] for r in df.select(rating_difficulty(F.col("own"), F.col("opp"), True)).collect()]
    assert got == [3.0, 5.0, 1.0, None]


def test_double_round_is_one_row_and_unseen_team_is_average(spark):
    rated = ratings.elo_ratings(matches(spark, (1, 1, 10, 20, 1, 0, 0), (2, 1, 30, 10, 1, 0, 2)))
    got = ratings.team_difficulty(rated, teams(spark)).filter("team = 'T10'").collect()
    assert len(got) == 1
    final = spark.createDataFrame([(10, 1700.0)], "team_id bigint, elo double")
    fixtures = spark.createDataFrame([(4, 10, 20)], "event bigint, team_h bigint, team_a bigint")
    up = as_dict(ratings.upcoming_difficulty(final, fixtures, teams(spark)), "team", "custom_difficulty")
    assert up["T10"] == pytest.approx(3 + (1500 - 1760) / 200) and up["T20"] == pytest.approx(3 + (1700 - 1440) / 200)


def test_bridge_by_name_drops_teams_without_a_counterpart(spark):
    final = spark.createDataFrame([(1, 1600.0), (2, 1400.0)], "team_id bigint, elo double")
    old = spark.createDataFrame([(1, "A"), (2, "B")], "id bigint, name string")
    new = spark.createDataFrame([(9, "A"), (1, "C")], "id bigint, name string")
    assert as_dict(ratings.bridge_by_name(final, old, new), "team_id", "elo") == {9: 1600.0}


def test_ids_used_again_in_another_season_stay_apart(spark):
    seasons = ("2023", "2024")
    raw = spark.createDataFrame([(s, 5, 1) for s in seasons], "season string, fixture bigint, opponent_team bigint")
    fixtures = spark.createDataFrame([(s, 5, i) for i, s in enumerate(seasons)], "season string, fixture bigint, team_h_difficulty bigint")
    teams = spark.createDataFrame([(s, 1, f"club {s}") for s in seasons], "season string, id bigint, name string")
    rows = merge.attach_dims(raw, fixtures, teams).collect()
    assert sorted((r["season"], r["team_h_difficulty"], r["opponent_team_name"]) for r in rows) == [
        ("2023", 0, "club 2023"), ("2024", 1, "club 2024")]
    per_match = spark.createDataFrame([(s, 5, 1500.0, 1500.0) for s in seasons], "season string, fixture bigint, elo_home_pre double, elo_away_pre double")
    assert ratings.compare_difficulty(per_match, fixtures).count() == 2
    rows = spark.createDataFrame([(s, 1, 1, 3.0) for s in seasons], "season string, team_id bigint, gw bigint, difficulty double")
    assert sorted(r["team"] for r in ratings.team_round_mean(rows, ["season"], teams).collect()) == ["club 2023", "club 2024"]
