"""Team ratings from match results, and fixture difficulty from ratings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.difficulty import HOME_ADVANTAGE, INITIAL_RATING, K_FACTOR, rating_difficulty
from touchline.functions.parsing import fixture_is_played
from touchline.operators.merge import shared


def order_matches(matches: DataFrame, competition: list[str], order: tuple[str, ...] = ("kickoff_time", "fixture")) -> DataFrame:
    """One competition's matches together and in time order."""
    return matches.repartition(*competition).sortWithinPartitions(*competition, *order)


def elo_ratings(
    matches: DataFrame,
    competition: tuple[str, ...] = ("season",),
    k: float = K_FACTOR,
    home_advantage: float = HOME_ADVANTAGE,
    initial: float = INITIAL_RATING,
) -> DataFrame:
    """Per match the ratings both teams carried into it and out of it.

    A rating depends on all earlier results of its competition, so a
    competition is one ordered pass. The pass reads sorted batches and keeps
    one number per team: memory does not grow with the number of matches, and
    competitions run in parallel. Pass every column that separates independent
    tables of teams (season, league) as `competition`.
    """
    keys = list(competition)
    numbers = ["fixture", "event", "team_h", "team_a"]
    typed = matches.select(
        *keys, *[F.col(c).cast("bigint") for c in numbers], "team_h_score", "team_a_score", "kickoff_time"
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        ratings: dict[int, float] = {}
        for batch in batches:
            rows = []
            groups = list(zip(*[batch[c] for c in keys]))
            games = zip(batch["team_h"], batch["team_a"], batch["team_h_score"], batch["team_a_score"])
            for group, (home, away, home_score, away_score) in zip(groups, games):
                if group != current:
                    current, ratings = group, {}
                pre_h, pre_a = ratings.get(home, initial), ratings.get(away, initial)
                expected = 1.0 / (1.0 + 10.0 ** ((pre_a - (pre_h + home_advantage)) / 400.0))
                result = 0.5 if home_score == away_score else float(home_score > away_score)
                ratings[home] = pre_h + k * (result - expected)
                ratings[away] = pre_a + k * ((1 - result) - (1 - expected))
                rows.append((pre_h, pre_a, ratings[home], ratings[away]))
            out = batch[[*keys, *numbers, "kickoff_time"]].copy()
            out[["elo_home_pre", "elo_away_pre", "elo_home_post", "elo_away_post"]] = pd.DataFrame(
                rows, columns=range(4), index=batch.index, dtype="float64"
            )
            yield out

    ordered = order_matches(typed, keys)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.select(*keys, *numbers, "kickoff_time").schema)
    ratings = "elo_home_pre double, elo_away_pre double, elo_home_post double, elo_away_post double"
    return ordered.mapInPandas(fold, f"{head}, {ratings}")


def final_ratings(per_match: DataFrame, competition: tuple[str, ...] = ("season",)) -> DataFrame:
    """Each team's rating after its last match."""
    sides = F.explode(
        F.array(
            F.struct(F.col("team_h").alias("team_id"), F.col("elo_home_post").alias("elo")),
            F.struct(F.col("team_a").alias("team_id"), F.col("elo_away_post").alias("elo")),
        )
    )
    rows = per_match.select(*competition, "kickoff_time", "fixture", sides.alias("s")).select("*", "s.*")
    return rows.groupBy(*competition, "team_id").agg(F.max_by("elo", F.struct("kickoff_time", "fixture")).alias("elo"))


def _both_sides(fixtures: DataFrame, keys: list[str], home: Column, away: Column) -> DataFrame:
    """Home and away rows of each fixture, from one read of the fixtures."""
    sides = F.explode(
        F.array(
            F.struct(F.col("team_h").alias("team_id"), home.alias("difficulty")),
            F.struct(F.col("team_a").alias("team_id"), away.alias("difficulty")),
        )
    )
    return fixtures.select(*keys, F.col("event").alias("gw"), sides.alias("s")).select(*keys, "gw", "s.*")


def team_round_mean(rows: DataFrame, keys: list[str], teams: DataFrame) -> DataFrame:
    """Mean difficulty per team and round, with the team's name."""
    mean = rows.groupBy(*keys, "team_id", "gw").agg(F.avg("difficulty").alias("custom_difficulty"))
    same = shared(mean, teams)
    named = mean.join(teams.select(*same, F.col("id").alias("team_id"), F.col("name").alias("team")), [*same, "team_id"], "left")
    return named.select(*keys, "team", "gw", "custom_difficulty")


def team_difficulty(
    per_match: DataFrame, teams: DataFrame, keys: tuple[str, ...] = ("season",), advantage: float = HOME_ADVANTAGE
) -> DataFrame:
    """Difficulty of each team's played rounds, from pre-match ratings.

    A team's round may hold several fixtures, in one competition or more: the
    round's difficulty is their mean.
    """
    home, away = F.col("elo_home_pre"), F.col("elo_away_pre")
    rows = _both_sides(
        per_match, list(keys), rating_difficulty(home, away, True, advantage), rating_difficulty(away, home, False, advantage)
    )
    return team_round_mean(rows, list(keys), teams)


def upcoming_difficulty(
    final: DataFrame,
    fixtures: DataFrame,
    teams: DataFrame,
    competition: tuple[str, ...] = (),
    keys: tuple[str, ...] = (),
    advantage: float = HOME_ADVANTAGE,
    initial: float = INITIAL_RATING,
) -> DataFrame:
    """Difficulty of fixtures without a result, from the latest ratings."""
    side = lambda team, name: final.select(*competition, F.col("team_id").alias(team), F.col("elo").alias(name))
    rated = fixtures.join(side("team_h", "_h"), [*competition, "team_h"], "left").join(
        side("team_a", "_a"), [*competition, "team_a"], "left"
    )
    home, away = F.coalesce("_h", F.lit(initial)), F.coalesce("_a", F.lit(initial))
    rows = _both_sides(
        rated, list(keys), rating_difficulty(home, away, True, advantage), rating_difficulty(away, home, False, advantage)
    )
    return team_round_mean(rows, list(keys), teams)


def compare_difficulty(per_match: DataFrame, published: DataFrame, advantage: float = HOME_ADVANTAGE) -> DataFrame:
    """Rating-based and published difficulty of the same fixtures."""
    home, away = F.col("elo_home_pre"), F.col("elo_away_pre")
    own = per_match.withColumns(
        {
            "custom_difficulty_home": rating_difficulty(home, away, True, advantage),
            "custom_difficulty_away": rating_difficulty(away, home, False, advantage),
        }
    )
    return own.join(published, [*shared(own, published), "fixture"], "left")


def bridge_by_name(final: DataFrame, old_teams: DataFrame, new_teams: DataFrame, competition: tuple[str, ...] = ()) -> DataFrame:
    """Ratings moved from last season's team ids to this season's, by name.

    Teams missing on either side drop out.
    """
    old = old_teams.select(F.col("id").alias("team_id"), "name")
    new = new_teams.select(F.col("id").alias("new_id"), "name")
    moved = final.join(old, "team_id").join(new, "name")
    return moved.select(*competition, F.col("new_id").alias("team_id"), "elo")


def match_results(fixtures: DataFrame) -> DataFrame:
    """Finished matches with both scores."""
    known = F.col("team_h_score").isNotNull() & F.col("team_a_score").isNotNull()
    return fixtures.filter(F.coalesce("finished", F.lit(False)) & known)


def teams_played(fixtures: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Teams that have played in each round (confirmed or provisional)."""
    keys = keys or ["event"]
    over = fixtures.filter(fixture_is_played(F.col("finished"), F.col("finished_provisional")))
    team = F.explode(F.array("team_h", "team_a")).alias("team_id")
    return over.select(*keys, team).distinct()
