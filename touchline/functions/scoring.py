"""Points from events (realised) and from projected rates (expected).

Both sides break a row into the same nine components, so they can be compared
component by component. `rules` is one rule set, a mapping season -> rule set, or
`Eras`. Rules are data: `with_rules` gives each row one struct of numbers for its
season and position, looked up once, and every formula reads that. Formulas have
the same size however many seasons there are, and a scan and a projection score a
table.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.difficulty import adverse, favourable
from touchline.rules import BPS_GOAL_WEIGHTS, POSITIONS, Eras, Rules

COMPONENTS = (
    "minutes", "goals", "assists", "clean_sheets", "goals_conceded", "saves",
    "cards_and_other", "defensive_contribution", "bonus",
)
CONCEDED_SHRINKAGE = 0.7
_LINEAR = ("own_goals", "penalties_missed", "penalties_saved", "yellow_cards", "red_cards")


RULE = "_rule"


def numbers(rules: Rules, position: str | None) -> dict[str, int | None]:
    """A rule set for one position as numbers; null means that there is no such rule, or no such position."""
    m, gc, saves, dc = rules["minutes"], rules["goals_conceded"], rules["saves"], rules.get("defensive_contribution")
    if saves["mode"] not in ("per_n", "flat_plus_bonus"):
        raise ValueError(f"saves are scored in no known way: {saves['mode']!r}")
    return {
        "minutes_none": m["none"], "minutes_short": m["short"], "minutes_full": m["full"], "short_threshold": m["short_threshold"],
        **{name: rules[event].get(position) for name, event in (("goals", "goals_scored"), ("assists", "assists"), ("clean_sheets", "clean_sheets"))},
        "conceded_per": gc["per"], "conceded": gc["points"] if position in gc["positions"] else 0,
        "saves_per": saves.get("n"), "saves_points": saves.get("points"), "saves_flat": saves.get("flat_rate"),
        "saves_close": saves.get("close_range_bonus"), "saves_chance": saves.get("big_chance_bonus"),
        **{name: rules[name] for name in _LINEAR},
        "dc_points": dc["points"] if dc else None, "dc_bar": dc["thresholds"].get(position) if dc else None,
        "bps_goal": BPS_GOAL_WEIGHTS.get(position), "bps_cbi_per": rules["bps_clearances_blocks_interceptions_per"],
        "bps_tackled": rules["bps_tackled_penalty"],
    }


def rule_table(spark: SparkSession, rules: Mapping) -> DataFrame:
    """One row per set of rules and position: _set, _position, and the numbers as a struct; position '' is any other.

    From Arrow, so that Spark holds it as a local table and knows how small it is.
    """
    sets = [rules] if "minutes" in rules else [rules[name] for name in sorted(rules)]
    rows = [(i, p or "", numbers(r, p)) for i, r in enumerate(sets) for p in (*POSITIONS, None)]
    kind = pa.struct([(name, pa.int32()) for name in rows[0][2]])
    columns = [pa.array([i for i, _, _ in rows], pa.int32()), pa.array([p for _, p, _ in rows]), pa.array([n for _, _, n in rows], kind)]
    return spark.createDataFrame(pa.table(columns, ["_set", "_position", RULE]))


def set_of(rules: Mapping, season: str) -> Column:
    """The number of the season's rule set in `rule_table`. A season without rules fails the job by name."""
    at = F.col(season)
    if "minutes" in rules:
        return F.lit(0)
    names = sorted(rules)
    unknown = F.raise_error(F.concat(F.lit("no rules for season "), F.coalesce(at.cast("string"), F.lit("null"))))
    places = reversed(list(enumerate(names)))
    hits = [(at >= name if isinstance(rules, Eras) else at == name, i) for i, name in places]
    chain = reduce(lambda c, hit: c.when(*hit), hits[1:], F.when(*hits[0]))
    return chain.otherwise(unknown.cast("int"))


def with_rules(df: DataFrame, rules: Mapping, season: str = "season", position: str = "position") -> DataFrame:
    """`df` with its rules in one column, which the formulas below read.

    A join with a table of a few rows: as a constant expression the optimizer
    would write the rules out in every formula, and the result is too large to be
    compiled.
    """
    known = F.when(F.col(position).isin(*POSITIONS), F.col(position)).otherwise("")
    keyed = df.withColumns({"_set": set_of(rules, season), "_position": known})
    return keyed.join(rule_table(df.sparkSession, rules), ["_set", "_position"], "left").drop("_set", "_position")


def rule(name: str) -> Column:
    return F.col(f"{RULE}.{name}")


def count_of(name: str, columns: Collection[str]) -> Column:
    """A count column, with a missing column or value read as zero."""
    return F.coalesce(F.col(name), F.lit(0)) if name in columns else F.lit(0)


def played_long() -> Column:
    return F.col("minutes") >= rule("short_threshold")


def threshold_met() -> Column:
    """True where the defensive count reaches the position's threshold."""
    return F.coalesce(F.col("defensive_contribution") >= rule("dc_bar"), F.lit(False))


def component_points(columns: Collection[str]) -> dict[str, Column]:
    """The nine realised components of rows `with_rules`."""
    n = lambda name: count_of(name, columns)
    minutes = F.when(F.col("minutes") == 0, rule("minutes_none")).when(~played_long(), rule("minutes_short")).otherwise(rule("minutes_full"))
    conceded = F.floor(n("goals_conceded") / rule("conceded_per")) * rule("conceded")
    flat_saves = n("saves") * rule("saves_flat") + n("close_range_saves") * rule("saves_close") + n("big_chance_saves") * rule("saves_chance")
    saves = F.when(rule("saves_per").isNotNull(), F.floor(n("saves") / rule("saves_per")) * rule("saves_points")).otherwise(flat_saves)
    defensive = F.when(threshold_met(), F.coalesce(rule("dc_points"), F.lit(0))).otherwise(0) if "defensive_contribution" in columns else F.lit(0)
    parts = {
        "minutes": minutes,
        "goals": n("goals_scored") * rule("goals"),
        "assists": n("assists") * rule("assists"),
        "clean_sheets": F.when(played_long(), n("clean_sheets") * rule("clean_sheets")).otherwise(0),
        "goals_conceded": F.when(played_long(), conceded).otherwise(0),
        "saves": saves,
        "cards_and_other": reduce(lambda a, b: a + b, [n(name) * rule(name) for name in _LINEAR]),
        "defensive_contribution": defensive,
        "bonus": n("bonus"),
    }
    return {name: column.cast("bigint") for name, column in parts.items()}


def total_of(parts: Mapping[str, Column]) -> Column:
    total = F.lit(0)
    for column in parts.values():
        total = total + column
    return total


def score(df: DataFrame, rules: Mapping, prefix: str = "pts_", total: str = "points") -> DataFrame:
    """`df` plus one column per component and their total."""
    parts = {f"{prefix}{name}": column for name, column in component_points(set(df.columns)).items()}
    return with_rules(df, rules).withColumns(parts).drop(RULE).withColumn(total, total_of({name: F.col(name) for name in parts}))


def replay(df: DataFrame, rules: Mapping, recorded: str = "total_points") -> DataFrame:
    """Recomputed points beside the recorded ones.

    Thresholds apply to merged counts here, while official points are given per
    fixture, so rows with several fixtures may differ.
    """
    total = total_of(component_points(set(df.columns))).cast("bigint")
    scored = with_rules(df, rules).withColumn("predicted_points", total).drop(RULE)
    return scored.withColumn("points_match", F.col("predicted_points") == F.col(recorded))


def with_bps(df: DataFrame, rules: Mapping, name: str = "bps_points") -> DataFrame:
    """`df` plus illustrative bonus-system points."""
    columns = set(df.columns)
    n = lambda name: count_of(name, columns)
    back = F.col("position").isin("GK", "DEF")
    total = (
        F.when(F.col("minutes") > 0, F.when(played_long(), 6).otherwise(3)).otherwise(0)
        + n("goals_scored") * rule("bps_goal")
        + n("assists") * 9
        + F.when((n("clean_sheets") > 0) & played_long() & back, 12).otherwise(0)
        + n("saves") * 2
        + n("penalties_saved") * 15
        - n("penalties_missed") * 6
        - n("own_goals") * 6
        - n("yellow_cards") * 3
        - n("red_cards") * 9
        - F.when(back, F.floor(n("goals_conceded") / F.lit(2)) * 4).otherwise(0)
        + F.floor(n("clearances_blocks_interceptions") / rule("bps_cbi_per")) * 2
        + n("tackles") * 2
        + n("times_tackled") * rule("bps_tackled")
    )
    return with_rules(df, rules).withColumn(name, total.cast("bigint")).drop(RULE)


def expected_components(difficulty: str = "custom_difficulty") -> dict[str, Column]:
    """The nine expected components of rows `with_rules`, from `<event>_trailing` rates.

    Unlike the realised side, clean sheets are not gated on minutes and only
    goalkeepers earn saves.
    """
    raw = F.col(difficulty)
    d = F.when(raw.isNull() | (raw == 0), F.lit(3.0)).otherwise(raw)
    good, bad = favourable(d), adverse(d)
    rate = lambda name: F.col(f"{name}_trailing")
    keeper_saves = rate("saves") * bad
    saves = F.when(rule("saves_per").isNotNull(), (keeper_saves / rule("saves_per")) * rule("saves_points")).otherwise(keeper_saves * rule("saves_flat"))
    conceded = F.lit(CONCEDED_SHRINKAGE) * (rate("goals_conceded") * bad / rule("conceded_per")) * rule("conceded")
    parts = {
        "minutes": F.col("p_blank") * rule("minutes_none") + F.col("p_short") * rule("minutes_short") + F.col("p_full") * rule("minutes_full"),
        "goals": rate("goals_scored") * good * rule("goals"),
        "assists": rate("assists") * good * rule("assists"),
        "clean_sheets": rate("clean_sheets") * good * rule("clean_sheets"),
        "goals_conceded": F.when(rule("conceded") == 0, 0.0).otherwise(conceded),
        "saves": F.when(F.col("position") == "GK", saves).otherwise(0.0),
        "cards_and_other": reduce(lambda a, b: a + b, [rate(name) * rule(name) for name in _LINEAR], F.lit(0.0)),
        "defensive_contribution": F.coalesce(F.col("p_threshold") * rule("dc_points"), F.lit(0.0)),
        "bonus": rate("bonus"),
    }
    return {name: column.cast("double") for name, column in parts.items()}


def expected_points() -> Column:
    """Expected points of rows `with_rules`."""
    return total_of(expected_components())
