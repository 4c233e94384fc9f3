"""Payload contracts. A field that is not nullable is required."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def fields(required: str = "", optional: str = "", **nested: T.DataType) -> T.StructType:
    """`"name:type ..."` lists to a struct; nested fields are required."""
    out = []
    for text, nullable in ((required, False), (optional, True)):
        for item in text.split():
            name, _, kind = item.partition(":")
            out.append(T.StructField(name, _TYPES[kind or "long"], nullable))
    out.extend(T.StructField(name, kind, False) for name, kind in nested.items())
    return T.StructType(out)


TEAM = fields("id name:string short_name:string", "strength")
EVENT = fields(
    "id name:string deadline_time:timestamp finished:boolean", "is_current:boolean is_next:boolean is_previous:boolean"
)
ELEMENT = fields(
    "id web_name:string team element_type now_cost selected_by_percent:string transfers_in_event transfers_out_event "
    "form:string status:string",
    "chance_of_playing_next_round news_added:timestamp ep_next:string",
)
BOOTSTRAP = T.StructType(
    [
        T.StructField("events", T.ArrayType(EVENT), False),
        T.StructField("teams", T.ArrayType(TEAM), False),
        T.StructField("elements", T.ArrayType(ELEMENT), False),
        T.StructField("current_event", T.LongType(), True),
        T.StructField("next_event", T.LongType(), True),
    ]
)
FIXTURE = fields(
    "id team_h team_a finished:boolean finished_provisional:boolean",
    "event kickoff_time:timestamp started:boolean team_h_score team_a_score",
)
HISTORY_ROW = fields("element fixture round minutes total_points")
ELEMENT_SUMMARY = T.StructType([T.StructField("history", T.ArrayType(HISTORY_ROW), True)])
LIVE_STATS = fields(
    "minutes total_points bps",
    "goals_scored assists clean_sheets goals_conceded saves bonus yellow_cards red_cards own_goals penalties_missed "
    "penalties_saved defensive_contribution",
)
LIVE = T.StructType([T.StructField("elements", T.ArrayType(fields("id", stats=LIVE_STATS)), False)])
ENTRY = fields("id started_event summary_overall_points", "current_event")
ENTRY_HISTORY = T.StructType(
    [
        T.StructField("current", T.ArrayType(fields("event points total_points bank value event_transfers event_transfers_cost")), False),
        T.StructField("past", T.ArrayType(fields("season_name:string total_points")), False),
        T.StructField("chips", T.ArrayType(fields("name:string event")), False),
    ]
)
TRANSFER = fields("element_in element_in_cost element_out element_out_cost entry event time:timestamp")
PICK = fields("element position multiplier is_captain:boolean is_vice_captain:boolean", "purchase_price selling_price")
PICKS = T.StructType(
    [
        T.StructField("picks", T.ArrayType(PICK), False),
        T.StructField("entry_history", fields("bank"), False),
        T.StructField("active_chip", T.StringType(), True),
    ]
)
SNAPSHOT = fields(
    "", "element_id snapshot_ts:timestamp now_cost selected_by_percent:double transfers_in_event transfers_out_event form:double "
    "status:string chance_of_playing_next_round news_added:timestamp ep_next:double",
)
ACTUALS = fields(
    "", "gw element_id position:string team:string is_promoted_club:boolean minutes goals_scored assists clean_sheets "
    "goals_conceded saves bonus yellow_cards red_cards own_goals penalties_missed penalties_saved defensive_contribution total_points",
)
PLAYER_FIXTURE_CSV = fields(
    "", "element name:string team:string position:string opponent_team was_home:boolean kickoff_time:string round fixture minutes "
    "starts total_points goals_scored assists clean_sheets goals_conceded own_goals penalties_saved penalties_missed yellow_cards "
    "red_cards saves bonus bps influence:double creativity:double threat:double ict_index:double value selected transfers_in "
    "transfers_out clearances_blocks_interceptions defensive_contribution recoveries tackles",
)
FIXTURES_CSV = fields(
    "", "id event team_h team_a team_h_score team_a_score kickoff_time:string finished:boolean team_h_difficulty team_a_difficulty"
)
TEAMS_CSV = fields("", "id name:string")
