import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from touchline.session import local_session  # noqa: E402

DAY0 = datetime(2025, 8, 1)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, memory="4g")
    yield session
    session.stop()


def day(n):
    return DAY0 + timedelta(days=n)


FACT_DEFAULTS = dict(
    season="s", gw=1, element_id=1, name="n", team="A", position="MID", is_promoted_club=False, opponent_difficulty=3.0,
    kickoff_time=DAY0, n_fixtures=1, minutes=90, total_points=0, goals_scored=0, assists=0, clean_sheets=0, goals_conceded=0,
    own_goals=0, penalties_saved=0, penalties_missed=0, yellow_cards=0, red_cards=0, saves=0, bonus=0, bps=0,
    defensive_contribution=None,
)
FACT_TYPES = (
    "season string, gw bigint, element_id bigint, name string, team string, position string, is_promoted_club boolean, "
    "opponent_difficulty double, kickoff_time timestamp, n_fixtures bigint, minutes bigint, total_points bigint, goals_scored bigint, "
    "assists bigint, clean_sheets bigint, goals_conceded bigint, own_goals bigint, penalties_saved bigint, penalties_missed bigint, "
    "yellow_cards bigint, red_cards bigint, saves bigint, bonus bigint, bps bigint, defensive_contribution bigint"
)


def make_fact(spark, rows):
    """Fact rows from partial dicts; kickoffs default to one week per round."""
    full = []
    for row in rows:
        merged = {**FACT_DEFAULTS, "kickoff_time": day(7 * row.get("gw", 1)), **row}
        full.append(tuple(merged[c] for c in FACT_DEFAULTS))
    return spark.createDataFrame(full, FACT_TYPES)


def as_dict(df, key, value):
    return {row[key]: row[value] for row in df.collect()}
