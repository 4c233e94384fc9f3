import pytest
from conftest import make_fact
from pyspark.sql import functions as F

from touchline.functions import scoring
from touchline.rules import RULES_2024_25, RULES_2025_26, RULES_2026_27, Eras


def points(spark, rules, **event):
    row = {"minutes": 0, **event}
    extra = {k: row.pop(k) for k in list(row) if k in ("close_range_saves", "big_chance_saves", "tackles", "clearances_blocks_interceptions", "times_tackled")}
    df = make_fact(spark, [row]).withColumns({k: F.lit(v) for k, v in extra.items()})
    return scoring.with_bps(scoring.score(df, rules), rules).selectExpr("points AS p", "bps_points AS b").first()


@pytest.mark.parametrize(
    "rules, event, expected",
    [
        (RULES_2024_25, dict(minutes=0), 0),
        (RULES_2024_25, dict(minutes=59), 1),
        (RULES_2024_25, dict(minutes=60), 2),
        (RULES_2024_25, dict(minutes=90, position="FWD", goals_scored=2), 10),
        (RULES_2024_25, dict(minutes=90, position="GK", goals_scored=1, assists=1), 11),
        (RULES_2024_25, dict(minutes=59, position="DEF", clean_sheets=1), 1),
        (RULES_2024_25, dict(minutes=90, position="DEF", goals_conceded=3), 1),
        (RULES_2024_25, dict(minutes=90, position="MID", goals_conceded=4), 2),
        (RULES_2024_25, dict(minutes=90, position="GK", saves=7), 4),
        (RULES_2024_25, dict(minutes=90, yellow_cards=1, own_goals=1, penalties_missed=1), -3),
        (RULES_2024_25, dict(minutes=90, position="DEF", defensive_contribution=15), 2),
        (RULES_2025_26, dict(minutes=90, position="DEF", defensive_contribution=10), 4),
        (RULES_2025_26, dict(minutes=90, position="MID", defensive_contribution=11), 2),
        (RULES_2025_26, dict(minutes=90, position="GK", defensive_contribution=30), 2),
        (RULES_2026_27, dict(minutes=90, position="GK", saves=4, close_range_saves=2, big_chance_saves=1), 9),
    ],
)
def test_points(spark, rules, event, expected):
    assert points(spark, rules, **event)["p"] == expected


def test_bps_rate_and_tackled_penalty_follow_the_rules(spark):
    event = dict(minutes=90, position="DEF", clearances_blocks_interceptions=6, times_tackled=2)
    assert points(spark, RULES_2025_26, **event)["b"] == 6 + 6 - 2
    assert points(spark, RULES_2026_27, **event)["b"] == 6 + 4


def test_unknown_saves_mode_is_an_error(spark):
    with pytest.raises(ValueError, match="no known way"):
        points(spark, {**RULES_2024_25, "saves": {"mode": "x"}})


def test_components_add_up_and_seasons_pick_their_rules(spark):
    rows = [dict(season="a", position="DEF", defensive_contribution=12), dict(season="b", position="DEF", defensive_contribution=12)]
    df = scoring.score(make_fact(spark, rows), {"a": RULES_2024_25, "b": RULES_2025_26})
    got = {r["season"]: r for r in df.collect()}
    assert (got["a"]["points"], got["b"]["points"]) == (2, 4)
    assert got["b"]["points"] == sum(got["b"][f"pts_{c}"] for c in scoring.COMPONENTS)


def test_unknown_seasons_fail_by_name_and_eras_go_on(spark):
    rows = [dict(season=s, position="DEF", defensive_contribution=12) for s in ("1990", "1998", "1999", "2030")]
    eras = Eras({"": RULES_2024_25, "1998": RULES_2025_26})
    got = {r["season"]: r["points"] for r in scoring.score(make_fact(spark, rows), eras).collect()}
    assert got == {"1990": 2, "1998": 4, "1999": 4, "2030": 4}
    for season in ("2031", None):
        df = make_fact(spark, [dict(season=season)])
        with pytest.raises(Exception, match=f"no rules for season {season or 'null'}"):
            scoring.score(df, {"2030": RULES_2024_25}).collect()


def test_unknown_positions_have_no_rates(spark):
    row = scoring.score(make_fact(spark, [dict(position="XX", goals_scored=1, goals_conceded=4, minutes=90)]), RULES_2024_25).first()
    assert row["pts_goals"] is None and row["pts_goals_conceded"] == 0 and row["pts_minutes"] == 2 and row["points"] is None


def test_replay_counts_one_right_and_one_wrong(spark):
    rows = [dict(element_id=1, total_points=2), dict(element_id=2, total_points=9)]
    df = scoring.replay(make_fact(spark, rows), RULES_2024_25)
    assert df.agg(F.avg(F.col("points_match").cast("int"))).first()[0] == 0.5
    assert [r["element_id"] for r in df.filter("NOT points_match").collect()] == [2]
