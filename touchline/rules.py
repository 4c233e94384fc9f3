"""Season rule sets as plain dicts.

A rule set becomes a row of numbers when a plan is built, so changing a rule
never touches the operators.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

Rules = Mapping[str, Any]

class Eras(dict[str, Rules]):
    """Rule sets by the first season they hold for, in the order of the seasons' names; a season has the latest that began before or with it."""


POSITIONS = ("GK", "DEF", "MID", "FWD")
POSITION_BY_CODE = {1: "GK", 2: "DEF", 3: "MID", 4: "FWD"}

# Points per event, equal to the published rules of each season.
_COMMON: dict[str, Any] = {
    "minutes": {"none": 0, "short": 1, "full": 2, "short_threshold": 60},
    "goals_scored": {"GK": 6, "DEF": 6, "MID": 5, "FWD": 4},
    "assists": {"GK": 3, "DEF": 3, "MID": 3, "FWD": 3},
    "clean_sheets": {"GK": 4, "DEF": 4, "MID": 1, "FWD": 0},
    "goals_conceded": {"per": 2, "points": -1, "positions": ["GK", "DEF"]},
    "own_goals": -2,
    "penalties_missed": -2,
    "penalties_saved": 5,
    "yellow_cards": -1,
    "red_cards": -3,
    "free_transfers": {"max_banked": 5},
}
_SAVES_PER_THREE = {"mode": "per_n", "n": 3, "points": 1}
_SAVES_FLAT = {"mode": "flat_plus_bonus", "flat_rate": 1, "close_range_bonus": 1, "big_chance_bonus": 1}
_DEFENSIVE = {"points": 2, "thresholds": {"GK": None, "DEF": 10, "MID": 12, "FWD": 12}}

RULES_2024_25: Rules = {
    **_COMMON,
    "saves": _SAVES_PER_THREE,
    "defensive_contribution": None,
    "bps_clearances_blocks_interceptions_per": 2,
    "bps_tackled_penalty": -1,
    "chips": {"sets": 1, "per_half": False, "expiry_deadline": None},
}
RULES_2025_26: Rules = {
    **_COMMON,
    "saves": _SAVES_PER_THREE,
    "defensive_contribution": _DEFENSIVE,
    "bps_clearances_blocks_interceptions_per": 2,
    "bps_tackled_penalty": -1,
    "chips": {"sets": 1, "per_half": False, "expiry_deadline": None},
}
RULES_2026_27: Rules = {
    **_COMMON,
    "saves": _SAVES_FLAT,
    "defensive_contribution": _DEFENSIVE,
    "bps_clearances_blocks_interceptions_per": 3,
    "bps_tackled_penalty": 0,
    "chips": {"sets": 2, "per_half": True, "expiry_deadline": "2027-01-02T13:30:00Z"},
}
RULES_BY_SEASON: dict[str, Rules] = {
    "2023-24": RULES_2024_25,  # same rules as the season after
    "2024-25": RULES_2024_25,
    "2025-26": RULES_2025_26,
    "2026-27": RULES_2026_27,
}

# Clubs promoted into each season.
PROMOTED_CLUBS: dict[str, list[str]] = {
    "2023-24": ["Burnley", "Sheffield Utd", "Luton"],
    "2024-25": ["Leicester", "Ipswich", "Southampton"],
    "2025-26": ["Leeds", "Burnley", "Sunderland"],
    "2026-27": ["Coventry", "Hull", "Ipswich"],
}
PROMOTED_SHORT_NAMES = ("COV", "HUL", "IPS")

# Illustrative bonus-system weight of a goal.
BPS_GOAL_WEIGHTS = {"GK": 12, "DEF": 12, "MID": 18, "FWD": 24}
UNLIMITED_CHIPS = ("wildcard", "freehit")

SQUAD_SHAPE = {"GK": 2, "DEF": 5, "MID": 5, "FWD": 3}
MAX_PER_CLUB = 3
XI_SIZE = 11
XI_MINIMUM = {"GK": 1, "DEF": 3, "FWD": 1}
