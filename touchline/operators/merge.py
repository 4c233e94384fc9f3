"""From per-fixture rows to one row per (season, gw, element)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.parsing import join_distinct

# The columns of the per-fixture files.
INTEGER_STATS = [
    "minutes", "starts", "total_points", "goals_scored", "assists", "clean_sheets", "goals_conceded", "own_goals",
    "penalties_saved", "penalties_missed", "yellow_cards", "red_cards", "saves", "bonus", "bps",
]
OPTIONAL_STATS = ["clearances_blocks_interceptions", "defensive_contribution", "recoveries", "tackles"]
DECIMAL_STATS = ["influence", "creativity", "threat", "ict_index"]
ADDITIVE = [*INTEGER_STATS, *OPTIONAL_STATS, *DECIMAL_STATS]
CARRIED = ["name", "team", "position", "is_promoted_club", "value", "selected", "transfers_in", "transfers_out"]
FACT_KEY = ["season", "gw", "element_id"]
PLAYER_KEY = ["season", "element_id"]
FACT_COLUMNS = [
    *FACT_KEY, "name", "team", "position", "opponent_team", "opponent_difficulty", "was_home", "kickoff_time", "n_fixtures",
    "is_promoted_club", *INTEGER_STATS, *OPTIONAL_STATS, *DECIMAL_STATS, "value", "selected", "transfers_in", "transfers_out",
]


def drop_non_players(df: DataFrame, marker: str = "AM") -> DataFrame:
    """Rows of the non-player pick type go; so do rows without a position."""
    return df.filter(F.col("position") != marker)


def pick_by_side(was_home: str, home: str, away: str) -> Column:
    return F.when(F.col(was_home), F.col(home)).otherwise(F.col(away))


def flag_members(column: str, members: Mapping[str, list[str]] | list[str] | Column, season: str = "season") -> Column:
    """True where the value is in the list, in its season's list, or where the condition given holds."""
    if isinstance(members, Column):
        return F.coalesce(members, F.lit(False))
    if isinstance(members, Mapping):
        pairs = [F.lit(x) for name, clubs in sorted(members.items()) for x in (name, list(clubs))]
        listed = F.try_element_at(F.create_map(*pairs), F.col(season))  # folds into one literal
    else:
        listed = F.lit(list(members))
    return F.coalesce(F.array_contains(listed, F.col(column)), F.lit(False))


def with_optional_columns(df: DataFrame, columns: list[str] = OPTIONAL_STATS, data_type: str = "bigint") -> DataFrame:
    """Add absent columns as typed nulls: not applicable is not zero."""
    return df.withColumns({c: F.lit(None).cast(data_type) for c in columns if c not in df.columns})


def require_unique(dim: DataFrame, keys: list[str], name: str) -> None:
    """Fail if two rows of a dimension have the same key."""
    twice = dim.groupBy(*keys).count().filter("count > 1").orderBy(*keys).limit(3).collect()
    if twice:
        raise ValueError(f"{name}: more than one row for {', '.join(str({k: row[k] for k in keys}) for row in twice)}")


def attach_dims(raw: DataFrame, fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """Left joins to fixture difficulty and to the opponent's name.

    Fixture and team ids start again each season, so a dimension that has the
    season is joined on it too. No broadcast hint: Spark broadcasts either side
    when its size allows. A dimension with two rows of one key would count
    fixtures twice: it is an error by name, found in the dimension alone.
    """
    require_unique(fixtures, [*shared(fixtures, raw), "fixture"], "fixtures")
    require_unique(teams, [*shared(teams, raw), "id"], "teams")
    opponents = teams.select(*shared(teams, raw), F.col("id").alias("opponent_team"), F.col("name").alias("opponent_team_name"))
    with_fixtures = raw.join(fixtures, [*shared(fixtures, raw), "fixture"], "left")
    return with_fixtures.join(opponents, [*shared(teams, raw), "opponent_team"], "left")


def shared(one: DataFrame, other: DataFrame, identity: tuple[str, ...] = ("season", "competition")) -> list[str]:
    """The identity columns that both sides have; ids are unique within them."""
    return [c for c in identity if c in one.columns and c in other.columns]


def merge_fixtures(
    per_fixture: DataFrame,
    order: tuple[str, ...] = ("kickoff_time", "fixture"),
    opponents: DataFrame | None = None,
    columns: list[str] = FACT_COLUMNS,
) -> DataFrame:
    """Merge a player's fixtures of one round.

    Counts add up, descriptive columns come from the round's first fixture, and
    what becomes ambiguous is joined (opponent) or null (home flag). Rows are dealt
    by (season, player) once: the merge needs no finer exchange, hardly any two rows
    would combine before it, and windows over a player's season use the same one. A
    player's season is bounded by its fixtures, so no key is hot.

    `opponents` has the opponent columns of the same fixtures as rows of their own,
    if `per_fixture` lacks them. Only `columns` of the fact are merged and dealt.
    """
    rows = per_fixture.withColumn("_fixture", F.lit(True))
    if opponents is not None:
        rows = rows.unionByName(opponents, allowMissingColumns=True)
    flag, counted = F.col("was_home"), F.col("_fixture")
    one_side = (F.count(flag) == F.count(counted)) & (F.min(flag) == F.max(flag))
    carried = F.struct(*[c for c in CARRIED if c in columns] or CARRIED)
    merged = rows.repartition(*PLAYER_KEY).groupBy(*FACT_KEY).agg(
        *[F.sum(c).alias(c) for c in ADDITIVE if c in per_fixture.columns],
        F.min_by(carried, F.when(counted, F.struct(*order))).alias("_first"),
        F.count(counted).alias("n_fixtures"),
        F.min("kickoff_time").alias("kickoff_time"),
        F.avg("opponent_difficulty").alias("opponent_difficulty"),
        join_distinct(F.col("opponent_team")).alias("opponent_team"),
        F.when(one_side, F.min(flag)).alias("was_home"),
    )
    return merged.select("*", "_first.*").select(*[c for c in FACT_COLUMNS if c in columns and c in [*merged.columns, *CARRIED]])


def fixture_opponents(players: DataFrame, fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """Opponent and difficulty of each player's fixtures, with the fact's key and nothing else of the row."""
    wanted = dict.fromkeys([*FACT_KEY, *shared(fixtures, players), *shared(teams, players), "fixture", "opponent_team", "was_home"])
    return attach_dims(players.select(*wanted), fixtures, teams).select(
        *FACT_KEY, pick_by_side("was_home", "team_h_difficulty", "team_a_difficulty").alias("opponent_difficulty"),
        F.col("opponent_team_name").alias("opponent_team"),
    )


def normalize_season(
    raw: DataFrame,
    fixtures: DataFrame,
    teams: DataFrame,
    promoted: Mapping[str, list[str]] | list[str] | Column,
    order: tuple[str, ...] = ("kickoff_time", "fixture"),
    columns: list[str] = FACT_COLUMNS,
) -> DataFrame:
    """Raw per-fixture rows to the fact table: one row per season, gw, player, with the `columns` asked for.

    Fixtures may be too many to broadcast. The join to them needs the fact's key
    and three columns, so these alone are exchanged by fixture; the wide rows are
    exchanged once, by player.
    """
    players = with_optional_columns(drop_non_players(raw))
    per_fixture = players.withColumn("is_promoted_club", flag_members("team", promoted)).drop("opponent_team", "opponent_difficulty")
    return merge_fixtures(per_fixture, order, fixture_opponents(players, fixtures, teams), columns)
