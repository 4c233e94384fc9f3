"""Checking SQL, independent of the package: one statement per query."""

from __future__ import annotations

from catalog.tables import PROMOTED, oracle_with

SQL: dict[str, str] = {}
SHARED: dict[str, str] = {}


def add(name: str, text: str) -> None:
    SQL[name] = text


def r6(expr: str) -> str:
    """Rounded to six digits off exact decimal ties, without a negative zero."""
    rounded = f"round({expr} + 1e-9, 6)"
    return f"CASE WHEN {rounded} = 0 THEN 0.0 ELSE {rounded} END"


# ---------------------------------------------------------------- fact table

_SUMS = (
    "minutes starts total_points goals_scored assists clean_sheets goals_conceded own_goals penalties_saved penalties_missed "
    "yellow_cards red_cards saves bonus bps clearances_blocks_interceptions defensive_contribution recoveries tackles"
).split()
_DECIMALS = "influence creativity threat ict_index".split()
_FIRST = "name team position is_promoted_club value selected transfers_in transfers_out".split()
_PROMOTED_SQL = PROMOTED.format("p.season", "p.team")

SHARED["per_fixture"] = f"""
SELECT p.* EXCLUDE (opponent_team), t.name AS opponent_team, ({_PROMOTED_SQL}) AS is_promoted_club,
  CASE WHEN p.was_home THEN d.team_h_difficulty ELSE d.team_a_difficulty END AS opponent_difficulty
FROM {{player_fixture}} p LEFT JOIN {{fixture_difficulty}} d ON p.fixture = d.fixture LEFT JOIN {{teams}} t ON p.opponent_team = t.id
WHERE p.position <> 'AM'"""

_ORDER = "ROW(kickoff_time, fixture, line, part)"
SHARED["fact"] = f"""
SELECT season, gw, element_id,
  {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS)}, {', '.join(f'sum({c}) AS {c}' for c in _DECIMALS)},
  {', '.join(f'arg_min({c}, {_ORDER}) AS {c}' for c in _FIRST)},
  count(*) AS n_fixtures, min(kickoff_time) AS kickoff_time, avg(opponent_difficulty) AS opponent_difficulty,
  string_agg(DISTINCT opponent_team, ' & ' ORDER BY opponent_team) AS opponent_team,
  CASE WHEN count(DISTINCT was_home) = 1 AND count(was_home) = count(*) THEN bool_or(was_home) END AS was_home
FROM {{per_fixture}} GROUP BY season, gw, element_id"""

add("normalize_season", f"""
SELECT * EXCLUDE ({', '.join(_DECIMALS)}), {', '.join(f'{r6(c)} AS {c}' for c in _DECIMALS)} FROM {{fact}}""")


# ------------------------------------------------------------------- scoring

_ERA = "CAST(season AS BIGINT)"
_LONG = "minutes >= 60"
COMPONENT_SQL = {
    "minutes": "CASE WHEN minutes = 0 THEN 0 WHEN minutes < 60 THEN 1 ELSE 2 END",
    "goals": "goals_scored * CASE position WHEN 'GK' THEN 6 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 WHEN 'FWD' THEN 4 END",
    "assists": "assists * 3",
    "clean_sheets": f"CASE WHEN {_LONG} THEN clean_sheets * CASE position WHEN 'GK' THEN 4 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 1 ELSE 0 END ELSE 0 END",
    "goals_conceded": f"CASE WHEN {_LONG} AND position IN ('GK', 'DEF') THEN -(goals_conceded // 2) ELSE 0 END",
    "saves": f"CASE WHEN {_ERA} < 2000 THEN saves // 3 ELSE saves END",
    "cards_and_other": "-2 * own_goals - 2 * penalties_missed + 5 * penalties_saved - yellow_cards - 3 * red_cards",
    "defensive_contribution": f"CASE WHEN {_ERA} < 1998 THEN 0 WHEN position = 'DEF' AND defensive_contribution >= 10 THEN 2 "
    "WHEN position IN ('MID', 'FWD') AND defensive_contribution >= 12 THEN 2 ELSE 0 END",
    "bonus": "bonus",
}
POINTS_SQL = " + ".join(f"({c})" for c in COMPONENT_SQL.values())
_BPS = f"""CASE WHEN minutes > 0 THEN CASE WHEN {_LONG} THEN 6 ELSE 3 END ELSE 0 END
  + goals_scored * CASE position WHEN 'GK' THEN 12 WHEN 'DEF' THEN 12 WHEN 'MID' THEN 18 ELSE 24 END + assists * 9
  + CASE WHEN clean_sheets > 0 AND {_LONG} AND position IN ('GK', 'DEF') THEN 12 ELSE 0 END
  + saves * 2 + penalties_saved * 15 - penalties_missed * 6 - own_goals * 6 - yellow_cards * 3 - red_cards * 9
  - CASE WHEN position IN ('GK', 'DEF') THEN (goals_conceded // 2) * 4 ELSE 0 END
  + (coalesce(clearances_blocks_interceptions, 0) // CASE WHEN {_ERA} < 2000 THEN 2 ELSE 3 END) * 2 + coalesce(tackles, 0) * 2"""

add("score_components", f"""
SELECT season, element_id, fixture, line, part, {', '.join(f'CAST({c} AS BIGINT) AS pts_{n}' for n, c in COMPONENT_SQL.items())},
  CAST({POINTS_SQL} AS BIGINT) AS points, total_points
FROM {{player_fixture}} WHERE position <> 'AM'""")
add("bonus_system_points", f"""
SELECT season, element_id, fixture, line, part, CAST({_BPS} AS BIGINT) AS bps_points FROM {{player_fixture}} WHERE position <> 'AM'""")

SHARED["replayed"] = f"SELECT *, CAST({POINTS_SQL} AS BIGINT) AS predicted_points FROM {{fact}}"
add("replay_match_rate", """
SELECT season, count(*) AS n_rows, count(*) FILTER (WHERE predicted_points = total_points) AS n_exact_match,
  avg(CASE WHEN predicted_points = total_points THEN 1 ELSE 0 END) AS match_rate FROM {replayed} GROUP BY season""")
add("replay_discrepancies", """
SELECT season, gw, element_id, name, position, n_fixtures, total_points, predicted_points FROM {replayed}
WHERE predicted_points <> total_points""")

# ------------------------------------------------------------- trailing rows

_W = "OVER (PARTITION BY season, element_id ORDER BY gw ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
_W5, _W3 = _W.format(n=5), _W.format(n=3)
add("trailing_mean", f"""
SELECT season, gw, element_id, avg(total_points) {_W5} AS total_points_trailing, avg(minutes) {_W5} AS minutes_trailing,
  avg(goals_scored) {_W5} AS goals_scored_trailing, count(*) {_W5} AS n_games FROM {{fact}}""")

_MINUTES = {"p_blank": "minutes = 0", "p_short": "minutes > 0 AND minutes < 60", "p_full": "minutes >= 60"}
_MINUTES_SQL = {p: f"avg(CASE WHEN {c} THEN 1 ELSE 0 END) {_W3}" for p, c in _MINUTES.items()}
add("minutes_distribution", f"""
SELECT season, gw, element_id, {', '.join(f'{e} AS {p}' for p, e in _MINUTES_SQL.items())} FROM {{fact}}""")

EVENTS = (
    "goals_scored assists clean_sheets goals_conceded saves bonus yellow_cards red_cards own_goals penalties_missed penalties_saved"
).split()
_POOLED = ["total_points", *EVENTS]
SHARED["cells"] = f"""
SELECT season, gw, position, is_promoted_club, {', '.join(f'sum({c}) AS s_{c}, count({c}) AS n_{c}' for c in _POOLED)}
FROM {{fact}} GROUP BY ALL"""


def _mean(alias: str, c: str) -> str:
    return f"CAST({alias}.s_{c} AS DOUBLE) / nullif({alias}.n_{c}, 0)"


# Straight from the definition: the history of a target round is every earlier
# round, joined and added up.
SHARED["peer_pool"] = f"""
SELECT k.season, k.gw, k.position, k.is_promoted_club, {', '.join(f'sum(c.s_{c}) AS s_{c}, sum(c.n_{c}) AS n_{c}' for c in _POOLED)}
FROM {{cells}} k JOIN {{cells}} c ON c.season = k.season AND c.position = k.position AND c.is_promoted_club = k.is_promoted_club AND c.gw < k.gw
GROUP BY ALL"""
SHARED["position_pool"] = f"""
SELECT k.season, k.gw, k.position, {', '.join(f'sum(c.s_{c}) AS s_{c}, sum(c.n_{c}) AS n_{c}' for c in _POOLED)}
FROM (SELECT DISTINCT season, gw, position FROM {{cells}}) k JOIN {{cells}} c ON c.season = k.season AND c.position = k.position AND c.gw < k.gw
GROUP BY ALL"""
SHARED["priors"] = f"""
SELECT k.season, k.gw, k.position, k.is_promoted_club,
  {', '.join(f"coalesce({_mean('a', c)}, {_mean('b', c)}, 0.0) AS {c}_prior" for c in _POOLED)}
FROM {{cells}} k LEFT JOIN {{peer_pool}} a USING (season, gw, position, is_promoted_club) LEFT JOIN {{position_pool}} b USING (season, gw, position)"""
add("expanding_pools", "SELECT season, gw, position, is_promoted_club, total_points_prior, saves_prior FROM {priors}")
add("trailing_feature", f"""
SELECT season, gw, element_id, coalesce(t, total_points_prior) AS total_points_trailing
FROM (SELECT *, avg(total_points) {_W5} AS t FROM {{fact}}) f JOIN {{priors}} USING (season, gw, position, is_promoted_club)""")

SHARED["hits"] = """
SELECT season, element_id, gw, CASE WHEN position = 'DEF' AND defensive_contribution >= 10 THEN 1
  WHEN position IN ('MID', 'FWD') AND defensive_contribution >= 12 THEN 1 ELSE 0 END AS hit
FROM {fact} WHERE defensive_contribution IS NOT NULL AND CAST(season AS BIGINT) >= 1998"""
SHARED["recent_hits"] = """
SELECT season, gw, element_id, avg(hit) AS rate FROM (
  SELECT f.season, f.gw, f.element_id, h.hit FROM {fact} f JOIN {hits} h ON h.season = f.season AND h.element_id = f.element_id AND h.gw < f.gw
  QUALIFY row_number() OVER (PARTITION BY f.season, f.gw, f.element_id ORDER BY h.gw DESC) <= 5) GROUP BY ALL"""
add("threshold_rate", """
SELECT season, gw, element_id, coalesce(rate, 0.0) AS p_threshold FROM {fact} LEFT JOIN {recent_hits} USING (season, gw, element_id)""")
add("trailing_state", """
SELECT season, element_id, avg(total_points) AS total_points_trailing, avg(minutes) AS minutes_trailing, count(*) AS n_games
FROM (SELECT * FROM {fact} WHERE gw <= 20 QUALIFY row_number() OVER (PARTITION BY season, element_id ORDER BY gw DESC) <= 5)
GROUP BY season, element_id""")

SHARED["rounds"] = "SELECT season, gw, min(kickoff_time) AS deadline, max(kickoff_time) AS last_kickoff FROM {fact} GROUP BY season, gw"
SHARED["calendar"] = """
SELECT r.season, r.gw, r.deadline, max(h.last_kickoff) AS available_at, max(h.last_kickoff) - INTERVAL 30 DAY AS form_cutoff
FROM {rounds} r LEFT JOIN {rounds} h ON h.season = r.season AND h.gw < r.gw GROUP BY r.season, r.gw, r.deadline"""
add("walk_calendar", "SELECT * FROM {calendar}")
add("leakage_check", """
SELECT season, gw, deadline, available_at FROM {calendar} WHERE NOT coalesce(available_at < deadline, false)""")

# -------------------------------------------------------------- walk forward

SHARED["form_means"] = """
SELECT c.season, c.gw, f.element_id, avg(f.total_points) AS form
FROM {calendar} c JOIN {fact} f ON f.season = c.season AND f.gw < c.gw AND f.kickoff_time > c.form_cutoff GROUP BY ALL"""
_EVENT_TRAILING = ", ".join(f"avg({c}) {_W5} AS {c}_t" for c in _POOLED)
SHARED["walk"] = f"""
SELECT f.*, {', '.join(f'coalesce({c}_t, {c}_prior) AS {c}_trailing' for c in _POOLED)},
  coalesce(form, total_points_prior) AS form_trailing, coalesce(rate, 0.0) AS p_threshold
FROM (SELECT *, {_EVENT_TRAILING}, coalesce({_MINUTES_SQL['p_blank']}, 0.5) AS p_blank,
        coalesce({_MINUTES_SQL['p_short']}, 0.2) AS p_short, coalesce({_MINUTES_SQL['p_full']}, 0.3) AS p_full FROM {{fact}}) f
JOIN {{priors}} USING (season, gw, position, is_promoted_club)
LEFT JOIN {{form_means}} USING (season, gw, element_id) LEFT JOIN {{recent_hits}} USING (season, gw, element_id)
WHERE f.gw >= 2"""
_ACTUALS = "total_points, minutes, goals_scored, assists, clean_sheets, bonus, bps"
_ADJUSTED = "total_points_trailing * (1 + (3 - coalesce(opponent_difficulty, 3)) * CAST(0.075 AS DOUBLE))"
SHARED["results"] = f"""
SELECT *, prediction - total_points AS error FROM (
  SELECT season, gw, 'trailing_mean' AS baseline, element_id, position, total_points_trailing AS prediction, {_ACTUALS} FROM {{walk}}
  UNION ALL SELECT season, gw, 'form', element_id, position, form_trailing, {_ACTUALS} FROM {{walk}}
  UNION ALL SELECT season, gw, 'fixture_adjusted', element_id, position, {_ADJUSTED}, {_ACTUALS} FROM {{walk}})"""
add("walk_forward_baselines", "SELECT * FROM {results}")
add("event_projection", f"""
SELECT season, gw, element_id, {', '.join(f'{c}_trailing' for c in EVENTS)}, p_blank, p_short, p_full, p_threshold FROM {{walk}}""")

# ------------------------------------------------------------------- ratings

SHARED["numbered"] = """
SELECT season, competition, fixture, event, team_h, team_a, team_h_score, team_a_score, kickoff_time,
  row_number() OVER (PARTITION BY season, competition ORDER BY kickoff_time, fixture) AS i
FROM {matches} WHERE finished"""
SHARED["elo"] = """/*WITH_RECURSIVE*/
SELECT DISTINCT season, competition, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS fixture, CAST(NULL AS DOUBLE) AS pre_h, CAST(NULL AS DOUBLE) AS pre_a,
  list_transform(range(25), lambda x: CAST(1500 AS DOUBLE)) AS r FROM {numbered}
UNION ALL
SELECT season, competition, i, fixture, pre_h, pre_a,
  list_transform(range(25), lambda x: CASE WHEN x = team_h THEN pre_h + 20 * (res - ex)
                                        WHEN x = team_a THEN pre_a + 20 * ((1 - res) - (1 - ex)) ELSE r[x + 1] END)
FROM (SELECT *, 1 / (1 + pow(CAST(10 AS DOUBLE), (pre_a - (pre_h + 60)) / 400)) AS ex FROM (
  SELECT e.season, e.competition, m.i, m.fixture, m.team_h, m.team_a, e.r, e.r[m.team_h + 1] AS pre_h, e.r[m.team_a + 1] AS pre_a,
    CAST(CASE WHEN m.team_h_score > m.team_a_score THEN 1 WHEN m.team_h_score < m.team_a_score THEN 0 ELSE 0.5 END AS DOUBLE) AS res
  FROM elo e JOIN {numbered} m ON m.season = e.season AND m.competition = e.competition AND m.i = e.i + 1))"""
SHARED["rated"] = """
SELECT m.*, e.pre_h, e.pre_a, e.r FROM {elo} e JOIN {numbered} m ON m.season = e.season AND m.competition = e.competition AND m.i = e.i"""
add("elo_ratings", f"""
SELECT season, competition, fixture, event, team_h, team_a, {r6('pre_h')} AS elo_home_pre, {r6('pre_a')} AS elo_away_pre FROM {{rated}}""")
SHARED["final_elo"] = """
SELECT season, competition, team AS team_id, r[team + 1] AS elo FROM (
  SELECT season, competition, arg_max(r, i) AS r FROM {rated} GROUP BY season, competition)
JOIN (SELECT season, competition, team_h AS team FROM {rated} UNION SELECT season, competition, team_a FROM {rated}) USING (season, competition)"""
add("final_ratings", f"SELECT season, competition, team_id, {r6('elo')} AS elo FROM {{final_elo}}")


def _difficulty(own: str, other: str, home: bool) -> str:
    return f"greatest(1.0, least(5.0, 3.0 + ({other} - ({own} {'+' if home else '-'} 60)) / 200))"


SHARED["team_difficulty"] = f"""
SELECT season, name AS team, gw, avg(d) AS custom_difficulty FROM (
  SELECT season, team_h AS team_id, event AS gw, {_difficulty('pre_h', 'pre_a', True)} AS d FROM {{rated}}
  UNION ALL SELECT season, team_a, event, {_difficulty('pre_a', 'pre_h', False)} FROM {{rated}})
LEFT JOIN {{teams}} ON team_id = id GROUP BY season, name, gw"""
add("team_difficulty", f"SELECT season, team, gw, {r6('custom_difficulty')} AS custom_difficulty FROM {{team_difficulty}}")
add("compare_difficulty", f"""
SELECT season, r.fixture, {r6(_difficulty('pre_h', 'pre_a', True))} AS custom_difficulty_home,
  {r6(_difficulty('pre_a', 'pre_h', False))} AS custom_difficulty_away, team_h_difficulty, team_a_difficulty
FROM {{rated}} r LEFT JOIN {{fixture_difficulty}} d ON r.fixture = d.fixture""")
add("elo_expected_score", f"""
SELECT season, fixture, {r6('1 / (1 + pow(CAST(10 AS DOUBLE), (pre_a - (pre_h + 60)) / 400))')} AS expected_home FROM {{rated}}""")
SHARED["moved"] = """
SELECT CAST(CAST(f.season AS BIGINT) + 1 AS STRING) AS season, competition, (n.id + 7) % 25 AS team_id, elo
FROM {final_elo} f JOIN {teams} o ON f.team_id = o.id JOIN {teams} n ON n.name = o.name AND n.id % 9 <> 0"""
SHARED["upcoming"] = """
SELECT m.season, m.event AS gw, m.team_h, m.team_a, coalesce(h.elo, 1500) AS eh, coalesce(a.elo, 1500) AS ea FROM {matches} m
LEFT JOIN {moved} h ON h.season = m.season AND h.competition = m.competition AND h.team_id = m.team_h
LEFT JOIN {moved} a ON a.season = m.season AND a.competition = m.competition AND a.team_id = m.team_a"""
add("upcoming_difficulty", f"""
SELECT season, name AS team, gw, {r6('avg(d)')} AS custom_difficulty FROM (
  SELECT season, team_h AS team_id, gw, {_difficulty('eh', 'ea', True)} AS d FROM {{upcoming}}
  UNION ALL SELECT season, team_a, gw, {_difficulty('ea', 'eh', False)} FROM {{upcoming}})
LEFT JOIN {{teams}} ON team_id = id GROUP BY season, name, gw""")
add("teams_played", """
SELECT DISTINCT season, event, unnest([team_h, team_a]) AS team_id FROM {matches}
WHERE coalesce(finished, false) OR coalesce(finished_provisional, false)""")

# --------------------------------------------------------------- event model

_FAV = "(1 + (3 - d) * CAST(0.075 AS DOUBLE))"
_ADV = "(1 + (d - 3) * CAST(0.075 AS DOUBLE))"
EXPECTED_SQL = {
    "minutes": "p_short + p_full * 2",
    "goals": f"goals_scored_trailing * {_FAV} * CASE position WHEN 'GK' THEN 6 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END",
    "assists": f"assists_trailing * {_FAV} * 3",
    "clean_sheets": f"clean_sheets_trailing * {_FAV} * CASE position WHEN 'GK' THEN 4 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 1 ELSE 0 END",
    "goals_conceded": f"CASE WHEN position IN ('GK', 'DEF') THEN -CAST(0.7 AS DOUBLE) * (goals_conceded_trailing * {_ADV} / 2) ELSE 0 END",
    "saves": f"CASE WHEN position = 'GK' THEN saves_trailing * {_ADV} / CASE WHEN {_ERA} < 2000 THEN 3 ELSE 1 END ELSE 0 END",
    "cards_and_other": "-2 * own_goals_trailing - 2 * penalties_missed_trailing + 5 * penalties_saved_trailing - yellow_cards_trailing - 3 * red_cards_trailing",
    "defensive_contribution": f"CASE WHEN {_ERA} < 1998 THEN 0 ELSE p_threshold * 2 END",
    "bonus": "bonus_trailing",
}
SHARED["walk_d"] = """
SELECT w.*, coalesce(custom_difficulty, 3.0) AS d FROM {walk} w LEFT JOIN {team_difficulty} t ON t.season = w.season AND t.team = w.team AND t.gw = w.gw"""
SHARED["event_results"] = f"""
SELECT season, gw, 'event_model' AS baseline, element_id, position, {' + '.join(f'({c})' for c in EXPECTED_SQL.values())} AS prediction, {_ACTUALS}
FROM {{walk_d}}"""
add("event_model", f"""
SELECT season, gw, element_id, position, {r6('prediction')} AS prediction, {r6('prediction - total_points')} AS error FROM {{event_results}}""")
SHARED["parts"] = f"""
SELECT season, {', '.join(f'abs(({EXPECTED_SQL[c]}) - ({COMPONENT_SQL[c]})) AS {c}' for c in COMPONENT_SQL)} FROM {{walk_d}}"""
add("component_decomposition", " UNION ALL ".join(
    f"SELECT season, '{c}' AS component, {r6(f'avg({c})')} AS mae FROM {{parts}} GROUP BY season" for c in COMPONENT_SQL))
_HIT = {p: f"CASE WHEN {c} THEN 1 ELSE 0 END" for p, c in _MINUTES.items()}
add("minutes_scorecard", f"""
SELECT season, {', '.join(f"{r6(f'avg(({p} - {h}) * ({p} - {h}))')} AS {p.replace('p_', 'brier_')}" for p, h in _HIT.items())},
  {r6('avg(abs(p_short * 30 + p_full * 90 - minutes))')} AS mae_expected_minutes, count(*) AS n FROM {{walk}} GROUP BY season""")

# ------------------------------------------------------------------- metrics

add("error_metrics", f"""
SELECT season, baseline, count(*) AS n, {r6('avg(abs(error))')} AS mae, {r6('sqrt(avg(error * error))')} AS rmse
FROM {{results}} GROUP BY season, baseline""")
_CORR = "CASE WHEN count(*) >= 2 AND min({x}) < max({x}) AND min({y}) < max({y}) THEN corr({x}, {y}) END"
add("pearson", f"""
SELECT season, baseline, {r6(_CORR.format(x='prediction', y='total_points'))} AS pearson FROM {{results}} GROUP BY season, baseline""")


def _ranked(keys: str, source: str) -> str:
    rank = "rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2"
    return (
        f"SELECT {keys}, {rank.format(k=keys, v='prediction')} AS rx, {rank.format(k=keys, v='total_points')} AS ry FROM {source}"
    )


_RANK_CORR = _CORR.format(x="rx", y="ry")
add("spearman", f"SELECT baseline, {r6(_RANK_CORR)} AS spearman FROM ({_ranked('baseline', '{results}')}) GROUP BY baseline")
SHARED["by_position"] = f"""
SELECT season, baseline, position, {_RANK_CORR} AS spearman FROM ({_ranked('season, baseline, position', '{results}')}) GROUP BY ALL"""
add("spearman_within_position", f"""
SELECT season, baseline, position, {r6('spearman')} AS spearman FROM {{by_position}}
UNION ALL SELECT season, baseline, 'mean', {r6('avg(spearman)')} FROM {{by_position}} GROUP BY season, baseline""")
add("average_rank", """
SELECT event_id, event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value)
  + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS avg_rank FROM {events}""")

_PROBS = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"
SHARED["bins"] = f"""
SELECT r.baseline, len(list_filter(b, lambda x: x < prediction)) AS bin, prediction, total_points
FROM {{results}} r JOIN (SELECT baseline, quantile_cont(prediction, {_PROBS}) AS b FROM {{results}} GROUP BY baseline) q ON q.baseline = r.baseline"""
add("calibration", f"""
SELECT baseline, CAST(bin AS INTEGER) AS bin, {r6('avg(prediction)')} AS mean_prediction, {r6('avg(total_points)')} AS mean_actual, count(*) AS n
FROM {{bins}} GROUP BY baseline, bin""")
_BUCKETS = {
    "blank_(0_minutes)": "minutes = 0", "played_no_goal_involvement": "minutes > 0 AND goals_scored = 0 AND assists = 0",
    "goal_involvement": "goals_scored > 0 OR assists > 0", "clean_sheet": "clean_sheets > 0", "bonus_earned": "bonus > 0",
}


def _by_event(season: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {season} AS season, baseline, '{b}' AS bucket, avg(abs(error)) FILTER (WHERE {c}) AS mae, count(*) FILTER (WHERE {c}) AS n "
        f"FROM {{results}} GROUP BY ALL" for b, c in _BUCKETS.items())


SHARED["by_event"] = _by_event("season")
SHARED["by_event_pooled"] = _by_event("'pooled'")
add("error_by_event", f"SELECT season, baseline, bucket, {r6('mae')} AS mae, n FROM {{by_event}}")


def _summary(source: str) -> str:
    body = []
    for season in ("season", "'pooled'"):
        level = f"(SELECT * REPLACE ({season} AS season) FROM {source})"
        ranked = _ranked("season, baseline, position", level)
        body.append(f"""
SELECT e.season, e.baseline, e.n, e.mae, e.rmse, s.spearman_mean FROM (
  SELECT season, baseline, count(*) AS n, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse FROM {level} GROUP BY ALL) e
JOIN (SELECT season, baseline, avg(spearman) AS spearman_mean FROM (
  SELECT season, baseline, position, {_RANK_CORR} AS spearman FROM ({ranked}) GROUP BY ALL) GROUP BY ALL) s
ON s.season = e.season AND s.baseline = e.baseline""")
    return " UNION ALL ".join(body)


SHARED["all_results"] = "SELECT * FROM {results} UNION ALL BY NAME SELECT *, prediction - total_points AS error FROM {event_results}"
add("model_comparison", f"""
SELECT season, baseline, n, {r6('mae')} AS mae, {r6('rmse')} AS rmse, {r6('spearman_mean')} AS spearman_mean FROM ({_summary('{all_results}')})""")
SHARED["summary"] = _summary("{results}")
_LONG_ROWS = [
    *[f"SELECT season, baseline, 'errors' AS section, 'all' AS label, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {{summary}}"
      for m in ("n", "mae", "rmse", "spearman_mean")],
    *[f"SELECT season, baseline, 'error_by_event', bucket, '{m}', CAST({m} AS DOUBLE) FROM {{{src}}}"
      for m in ("mae", "n") for src in ("by_event", "by_event_pooled")],
    *[f"SELECT 'pooled', baseline, 'calibration', CAST(bin AS STRING), '{m}', CAST({e} AS DOUBLE) FROM {{bins}} GROUP BY baseline, bin"
      for m, e in {"mean_prediction": "avg(prediction)", "mean_actual": "avg(total_points)", "n": "count(*)"}.items()],
]
add("long_report", f"SELECT season, baseline, section, label, metric, {r6('value')} AS value FROM ({' UNION ALL '.join(_LONG_ROWS)})")


SHARED["position_rounds"] = "SELECT season, position, gw, sum(total_points) AS points, count(total_points) AS n FROM {fact} GROUP BY season, position, gw"
SHARED["position_form"] = """
SELECT f.season, f.gw, f.element_id, f.position, f.total_points, sum(r.points) / sum(r.n) AS prediction
FROM {fact} f JOIN {position_rounds} r ON r.season = f.season AND r.position = f.position AND r.gw < f.gw AND r.gw >= f.gw - 5
WHERE f.gw >= 2 GROUP BY f.season, f.gw, f.element_id, f.position, f.total_points"""
add("point_in_time_model", f"""
SELECT season, gw, element_id, 'position_form' AS baseline, position, {r6('prediction')} AS prediction, {r6('prediction - total_points')} AS error
FROM {{position_form}}""")

# ----------------------------------------------------------------- snapshots

_AS_OF, _DEADLINE = "TIMESTAMP '2024-01-20 12:00:00'", "TIMESTAMP '2024-01-15 00:00:00'"


def _state(limit: str | None, keys: str = "element_id") -> str:
    where = f"WHERE snapshot_ts <= {limit}" if limit else ""
    return f"SELECT * FROM {{snapshots}} {where} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY snapshot_ts DESC, event_id DESC) = 1"


add("latest_state", _state(None))
add("latest_state_per_gw", f"SELECT gw, element_id, event_id, now_cost, status FROM ({_state(None, 'gw, element_id')})")
add("state_as_of", _state(_AS_OF))
add("changed_rows", """
SELECT gw, element_id, event_id, snapshot_ts, now_cost, status FROM (
  SELECT *, lag(now_cost) OVER w AS c, lag(status) OVER w AS s, row_number() OVER w AS rn FROM {snapshots}
  WINDOW w AS (PARTITION BY gw, element_id ORDER BY snapshot_ts, event_id))
WHERE rn = 1 OR now_cost IS DISTINCT FROM c OR status IS DISTINCT FROM s""")
add("compare_state", f"""
SELECT n.element_id, n.now_cost, n.status FROM ({_state(_AS_OF)}) n LEFT JOIN ({_state(_DEADLINE)}) p USING (element_id)
WHERE p.element_id IS NULL OR n.now_cost IS DISTINCT FROM p.now_cost OR n.status IS DISTINCT FROM p.status""")
_NUMERIC = {
    "now_cost": 0, "selected_by_percent": 1, "transfers_in_event": 0, "transfers_out_event": 0, "form": 1,
    "chance_of_playing_next_round": 0, "ep_next": 1,
}
_REFS = {"1h": f"{_AS_OF} - INTERVAL 1 HOUR", "24h": f"{_AS_OF} - INTERVAL 24 HOUR", "72h": f"{_AS_OF} - INTERVAL 72 HOUR", "since_gw": _DEADLINE}
for _label, _limit in _REFS.items():
    SHARED[f"at_{_label}"] = _state(_limit)
SHARED["deltas"] = f"""
SELECT n.element_id, {', '.join(f'n.{c}' for c in _NUMERIC)}, n.status, n.news_added,
  {', '.join(f'n.{c} - p_{l}.{c} AS {c}_delta_{l}' for l in _REFS for c in _NUMERIC)}
FROM ({_state(_AS_OF)}) n {' '.join(f'LEFT JOIN {{at_{l}}} p_{l} ON p_{l}.element_id = n.element_id' for l in _REFS)}"""
_DELTA_COLUMNS = [(c, d) for c, d in _NUMERIC.items()] + [(f"{c}_delta_{l}", d) for l in _REFS for c, d in _NUMERIC.items()]
add("compute_deltas", f"""
SELECT element_id, status, news_added, {', '.join(f'{r6(c)} AS {c}' if d else c for c, d in _DELTA_COLUMNS)} FROM {{deltas}}""")
add("state_pair", f"""
SELECT element_id, b.now_cost AS now_cost_before, b.status AS status_before, a.now_cost AS now_cost_after, a.status AS status_after
FROM ({_state(_DEADLINE)}) b JOIN ({_state(_AS_OF)}) a USING (element_id)""")
add("as_of_join", """
SELECT l.element_id, l.event_id, l.ep_next, r.event_id AS seen_event_id, r.now_cost AS seen_cost
FROM {snapshots} l LEFT JOIN {snapshots} r ON r.element_id = l.element_id AND r.status <> 'purchase' AND r.snapshot_ts <= l.snapshot_ts
WHERE l.status = 'purchase' QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY r.snapshot_ts DESC NULLS LAST, r.event_id DESC) = 1""")
add("retention_filter", f"""
SELECT event_id, news_added FROM {{snapshots}} WHERE news_added IS NULL OR news_added >= {_AS_OF} - INTERVAL 10 DAY""")
add("flatten_snapshots", """
SELECT event_id, element_id, now_cost, CASE WHEN event_id % 10 = 0 THEN NULL ELSE selected_by_percent END AS selected_by_percent,
  transfers_in_event, transfers_out_event, form, status, chance_of_playing_next_round,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE ep_next END AS ep_next FROM {snapshots}""")
add("extra_fields", "SELECT field, count(*) AS n FROM (SELECT unnest(regexp_extract_all(props, '\"([a-z_]+)\":', 1)) AS field FROM {events}) GROUP BY field")
add("contract_report", " UNION ALL ".join(
    f"SELECT count(*) AS n_rows, '{c}' AS field, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM {{snapshots}}"
    for c in ("element_id", "now_cost", "chance_of_playing_next_round", "news_added")))

# -------------------------------------------------------------------- market

_OWN = "selected_by_percent_delta_"
add("ownership_acceleration", f"""
SELECT element_id, {r6(_OWN + '1h')} AS ownership_delta_short, {r6(_OWN + '24h')} AS ownership_delta_long,
  {r6(f'({_OWN}1h / 1.0 - {_OWN}24h / 24.0)')} AS ownership_acceleration FROM {{deltas}}""")
_NET = "(transfers_in_event_delta_{w} - transfers_out_event_delta_{w})"
add("transfer_velocity", f"""
SELECT element_id, {_NET.format(w='24h')} AS net_transfers, {r6(_NET.format(w='24h') + ' / 24.0')} AS transfer_velocity FROM {{deltas}}""")
add("price_pressure", f"""
SELECT element_id, {_NET.format(w='24h')} AS net_transfers,
  {r6(_NET.format(w='24h') + ' / (selected_by_percent + 1.0)')} AS price_change_pressure FROM {{deltas}}""")
SHARED["price_rows"] = f"""
SELECT element_id, p AS price_change_pressure, CASE WHEN p >= 0.5 THEN 'rise' WHEN p <= -0.5 THEN 'fall' ELSE 'stable' END AS predicted_direction,
  CASE WHEN after > before THEN 'rise' WHEN after < before THEN 'fall' ELSE 'stable' END AS actual_direction
FROM (SELECT b.element_id, b.now_cost AS before, a.now_cost AS after,
    ((b.transfers_in_event - p.transfers_in_event) - (b.transfers_out_event - p.transfers_out_event)) / (b.selected_by_percent + 1.0) AS p
  FROM ({_state(_DEADLINE)}) b JOIN ({_state(_AS_OF)}) a USING (element_id)
  LEFT JOIN ({_state(_DEADLINE + ' - INTERVAL 72 HOUR')}) p ON p.element_id = b.element_id)"""
add("price_directions", f"""
SELECT element_id, {r6('price_change_pressure')} AS price_change_pressure, predicted_direction, actual_direction FROM {{price_rows}}""")
SHARED["price_eval"] = """
SELECT n, m AS n_moves_predicted, h / nullif(m, 0) AS hit_rate,
  greatest(0.0, h / nullif(m, 0) - 1.959963985 * sqrt((h / nullif(m, 0)) * (1 - h / nullif(m, 0)) / nullif(m, 0))) AS ci_low,
  least(1.0, h / nullif(m, 0) + 1.959963985 * sqrt((h / nullif(m, 0)) * (1 - h / nullif(m, 0)) / nullif(m, 0))) AS ci_high
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE predicted_direction <> 'stable') AS m,
  count(*) FILTER (WHERE predicted_direction <> 'stable' AND predicted_direction = actual_direction) AS h FROM {price_rows})"""
add("price_model", f"""
SELECT n, n_moves_predicted, {r6('hit_rate')} AS hit_rate, CASE WHEN hit_rate IS NOT NULL THEN {r6('ci_low')} END AS ci_low,
  CASE WHEN hit_rate IS NOT NULL THEN {r6('ci_high')} END AS ci_high FROM {{price_eval}}""")

# -------------------------------------------------------------------- squads

SHARED["activity"] = """
SELECT entry, event, CAST(sum(m) AS BIGINT) AS made, bool_or(c) AS is_chip_week FROM (
  SELECT entry, event, 1 AS m, false AS c FROM {transfers} UNION ALL
  SELECT entry, event, 0, true FROM {chips} WHERE name IN ('wildcard', 'freehit')) GROUP BY entry, event"""
add("activity_per_gw", "SELECT * FROM {activity}")
SHARED["ft"] = """/*WITH_RECURSIVE*/
SELECT entry, CAST(1 AS BIGINT) AS event, CAST(1 AS BIGINT) AS next, CAST(0 AS BIGINT) AS before, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS hits FROM {banks}
UNION ALL
SELECT f.entry, f.event + 1,
  least(5, CASE WHEN coalesce(a.is_chip_week, false) THEN f.next ELSE greatest(0, f.next - coalesce(a.made, 0)) END + 1), f.next,
  CASE WHEN coalesce(a.is_chip_week, false) THEN 0 ELSE coalesce(a.made, 0) END,
  CASE WHEN coalesce(a.is_chip_week, false) THEN 0 ELSE greatest(0, coalesce(a.made, 0) - f.next) END
FROM ft f LEFT JOIN {activity} a ON a.entry = f.entry AND a.event = f.event + 1 WHERE f.event < (SELECT max(event) FROM {transfers})"""
add("free_transfers", """
SELECT entry, event, before AS available_before, used, hits AS hit_count, hits * 4 AS hit_points FROM {ft} WHERE event >= 2""")

_RESALE = "CASE WHEN now_cost <= {b} THEN now_cost ELSE {b} + (now_cost - {b}) // 2 END"
SHARED["last_moves"] = """
SELECT entry, slot, element_in, element_in_cost FROM {transfers} WHERE transfer_time > TIMESTAMP '1990-01-01' AND transfer_time <= TIMESTAMP '2000-06-30'
QUALIFY row_number() OVER (PARTITION BY entry, slot ORDER BY transfer_time DESC, seq DESC) = 1"""
# The log moves each squad place on its own, so the last move of a place decides.
SHARED["state"] = f"""
SELECT entry, s.element_id, slot, multiplier, is_captain, is_vice_captain, bought AS purchase_price, {_RESALE.format(b='bought')} AS selling_price
FROM (SELECT p.entry, coalesce(m.element_in, p.element_id) AS element_id, p.slot, p.multiplier, p.is_captain, p.is_vice_captain,
        CASE WHEN m.element_in IS NOT NULL THEN m.element_in_cost ELSE coalesce(p.purchase_price, q0.now_cost) END AS bought
      FROM {{picks}} p LEFT JOIN {{last_moves}} m ON m.entry = p.entry AND m.slot = p.slot LEFT JOIN {{pool}} q0 ON q0.element_id = p.element_id) s
JOIN {{pool}} q ON q.element_id = s.element_id"""
add("squad_state", "SELECT * FROM {state}")
add("bank_after", """
SELECT b.entry, b.competition, CAST(b.bank + coalesce(f.flow, 0) AS BIGINT) AS bank FROM {banks} b LEFT JOIN (
  SELECT entry, sum(element_out_cost - element_in_cost) AS flow FROM {transfers}
  WHERE transfer_time > TIMESTAMP '1990-01-01' AND transfer_time <= TIMESTAMP '2000-06-30' GROUP BY entry) f ON f.entry = b.entry""")
SHARED["actions"] = """
SELECT entry, transfer_time, seq, 0 AS step, 'out' AS action, CASE WHEN seq % 37 = 0 THEN element_in ELSE element_out END AS element_id FROM {transfers}
UNION ALL SELECT entry, transfer_time, seq, 1, 'in', element_in FROM {transfers}"""
add("validate_log", """
SELECT a.entry, a.seq, a.element_id FROM (
  SELECT *, lag(action) OVER (PARTITION BY entry, element_id ORDER BY transfer_time, seq, step) AS prev FROM {actions}) a
LEFT JOIN {picks} p ON p.entry = a.entry AND p.element_id = a.element_id
WHERE a.action = 'out' AND NOT (CASE WHEN prev IS NULL THEN p.entry IS NOT NULL ELSE prev = 'in' END)""")
SHARED["squads"] = f"""
SELECT p.entry, p.element_id, p.slot, p.multiplier, q.position, q.club, q.now_cost, coalesce(p.purchase_price, q.now_cost) AS purchase_price,
  {_RESALE.format(b='coalesce(p.purchase_price, q.now_cost)')} AS selling_price
FROM {{picks}} p JOIN {{pool}} q ON q.element_id = p.element_id"""
add("legality", """
SELECT s.entry, n_players, n_distinct, n_gk, n_def, n_mid, n_fwd, squad_value, max_per_club, b.bank,
  n_players = 15 AND n_distinct = 15 AND n_gk = 2 AND n_def = 5 AND n_mid = 5 AND n_fwd = 3 AND max_per_club <= 3 AND b.bank >= 0 AS is_legal
FROM (SELECT entry, count(*) AS n_players, count(DISTINCT element_id) AS n_distinct, count(*) FILTER (WHERE position = 'GK') AS n_gk,
        count(*) FILTER (WHERE position = 'DEF') AS n_def, count(*) FILTER (WHERE position = 'MID') AS n_mid,
        count(*) FILTER (WHERE position = 'FWD') AS n_fwd, CAST(sum(selling_price) AS BIGINT) AS squad_value FROM {squads} GROUP BY entry) s
JOIN (SELECT entry, max(n) AS max_per_club FROM (SELECT entry, club, count(*) AS n FROM {squads} GROUP BY entry, club) GROUP BY entry) c ON c.entry = s.entry
JOIN {banks} b ON b.entry = s.entry""")


def _rounds(source: str, rounds: str = "1, 2, 3") -> str:
    return f"""
SELECT s.*, g.gw, coalesce(p.points, 0.0) AS points FROM {source} s CROSS JOIN (SELECT unnest([{rounds}]) AS gw) g
LEFT JOIN {{projections}} p ON p.element_id = s.element_id AND p.gw = g.gw"""


def _lineup(source: str, rounds: str = "1, 2, 3") -> str:
    return f"""
SELECT *, element_id = cap AS is_captain, coalesce(element_id = arg_min(CASE WHEN in_xi AND element_id <> cap THEN element_id END,
    CASE WHEN in_xi AND element_id <> cap THEN ROW(position <> 'GK', element_id) END) OVER (PARTITION BY entry, gw), false) AS is_vice_captain,
  CASE WHEN NOT in_xi THEN row_number() OVER (PARTITION BY entry, gw, in_xi ORDER BY points DESC, element_id) END AS bench_order
FROM (SELECT *, must OR (position <> 'GK' AND row_number() OVER (PARTITION BY entry, gw, NOT must AND position <> 'GK' ORDER BY points DESC, element_id) <= 6 AND NOT must) AS in_xi,
    first_value(element_id) OVER (PARTITION BY entry, gw ORDER BY points DESC, element_id) AS cap
  FROM (SELECT *, (position = 'GK' AND r <= 1) OR (position = 'DEF' AND r <= 3) OR (position = 'FWD' AND r <= 1) AS must
    FROM (SELECT *, row_number() OVER (PARTITION BY entry, gw, position ORDER BY points DESC, element_id) AS r FROM ({_rounds(source, rounds)}))))"""


add("best_lineup", f"SELECT entry, CAST(gw AS BIGINT) AS gw, element_id, in_xi, is_captain, is_vice_captain, bench_order FROM ({_lineup('{squads}')})")
SHARED["lineup_points"] = """
SELECT s.entry, CAST(g.gw AS BIGINT) AS gw, CAST(sum(coalesce(a.total_points, 0) * s.multiplier) AS BIGINT) AS points
FROM {picks} s CROSS JOIN (SELECT unnest([1, 2, 3]) AS gw) g LEFT JOIN {pool_actuals} a ON a.element_id = s.element_id AND a.gw = g.gw
WHERE s.multiplier > 0 GROUP BY s.entry, g.gw"""
add("lineup_points", "SELECT * FROM {lineup_points}")

# Best swap: with the sold player gone, points of the best ten others (b), the
# best of them (m), and of the best eleven without the bought player (a).
SHARED["hold_points"] = f"""
SELECT entry, sum(v) AS hold FROM (SELECT entry, gw, sum(points) FILTER (WHERE in_xi) + max(points) FILTER (WHERE in_xi) AS v FROM ({_lineup('{squads}')})
GROUP BY entry, gw) GROUP BY entry"""
SHARED["rest"] = f"""
SELECT o.entry, o.element_id AS out, o.position AS op, s.gw, s.element_id, s.position, s.points,
  row_number() OVER (PARTITION BY o.entry, o.element_id, s.gw, s.position ORDER BY s.points DESC, s.element_id) AS r
FROM {{squads}} o JOIN ({_rounds('{squads}')}) s ON s.entry = o.entry AND s.element_id <> o.element_id"""


def _best_of_rest(name: str, minus: bool, total: int) -> str:
    need = lambda p, n: f"{n} - CAST(op = '{p}' AS INTEGER)" if minus else str(n)
    must = f"(position = 'GK' AND r <= {need('GK', 1)}) OR (position = 'DEF' AND r <= {need('DEF', 3)}) OR (position = 'FWD' AND r <= {need('FWD', 1)})"
    forced = f"(5 - CAST(op <> 'MID' AS INTEGER))" if minus else "5"
    return f"""
SELECT entry, out, gw, sum(points) AS s_{name}, max(points) AS m_{name} FROM (
  SELECT *, row_number() OVER (PARTITION BY entry, out, gw, must, position = 'GK' ORDER BY points DESC, element_id) AS k FROM (
    SELECT *, {must} AS must FROM {{rest}}))
WHERE must OR (position <> 'GK' AND k <= {total} - {forced}) GROUP BY entry, out, gw"""


SHARED["stay"] = _best_of_rest("a", False, 11)
SHARED["ten"] = _best_of_rest("b", True, 10)
SHARED["outs"] = """
SELECT o.entry, o.element_id AS out, o.position, o.selling_price + b.bank AS budget, b.competition, b.entry % 3 AS free,
  list(s.element_id) AS ids, list(s.club) AS clubs FROM {squads} o JOIN {banks} b ON b.entry = o.entry
JOIN {squads} s ON s.entry = o.entry AND s.element_id <> o.element_id GROUP BY ALL"""
SHARED["swaps"] = """
SELECT o.entry, o.out, c.element_id AS element_in, o.budget - c.now_cost AS left_over, o.free,
  sum(greatest(a.s_a + a.m_a, t.s_b + coalesce(p.points, 0.0) + greatest(t.m_b, coalesce(p.points, 0.0)))) AS v
FROM {outs} o JOIN {pool} c ON c.competition = o.competition AND c.position = o.position AND c.now_cost <= o.budget
  AND NOT list_contains(o.ids, c.element_id) AND c.element_id <> o.out AND len(list_filter(o.clubs, lambda x: x = c.club)) < 3
  AND len(list_filter(o.clubs, lambda y: len(list_filter(o.clubs, lambda x: x = y)) > 3)) = 0
JOIN {stay} a ON a.entry = o.entry AND a.out = o.out JOIN {ten} t ON t.entry = o.entry AND t.out = o.out AND t.gw = a.gw
LEFT JOIN {projections} p ON p.element_id = c.element_id AND p.gw = a.gw GROUP BY ALL"""
SHARED["best_swap"] = """
SELECT *, round(v - 4 * greatest(1 - free, 0) - 0.0001 + 1e-9, 6) AS objective FROM {swaps}
QUALIFY row_number() OVER (PARTITION BY entry ORDER BY objective DESC, out, element_in) = 1"""
SHARED["chosen_swap"] = """
SELECT entry, CASE WHEN take THEN out END AS element_out, CASE WHEN take THEN element_in END AS element_in, hold,
  CASE WHEN take THEN objective ELSE hold END AS objective, CAST(CASE WHEN take THEN greatest(1 - free, 0) ELSE 0 END AS BIGINT) AS hits,
  CASE WHEN take THEN left_over ELSE bank END AS bank_after
FROM (SELECT b.entry, b.bank, s.out, s.element_in, s.objective, s.left_over, s.free, h.hold,
    s.out IS NOT NULL AND (NOT c.ok OR s.objective > h.hold) AS take
  FROM {banks} b JOIN (SELECT entry, round(hold + 1e-9, 6) AS hold FROM {hold_points}) h ON h.entry = b.entry
  JOIN (SELECT entry, max(n) <= 3 AS ok FROM (SELECT entry, club, count(*) AS n FROM {squads} GROUP BY entry, club) GROUP BY entry) c ON c.entry = b.entry
  LEFT JOIN {best_swap} s ON s.entry = b.entry)"""
add("best_single_swap", "SELECT * FROM {chosen_swap}")
SHARED["moved_squads"] = f"""
SELECT m.entry, m.element_id, q.position, q.club, m.purchase_price, m.selling_price FROM (
  SELECT s.entry, CASE WHEN s.element_id = c.element_out THEN c.element_in ELSE s.element_id END AS element_id,
    CASE WHEN s.element_id = c.element_out THEN n.now_cost ELSE s.purchase_price END AS purchase_price,
    CASE WHEN s.element_id = c.element_out THEN n.now_cost ELSE s.selling_price END AS selling_price
  FROM {{squads}} s JOIN {{chosen_swap}} c ON c.entry = s.entry LEFT JOIN {{pool}} n ON n.element_id = c.element_in) m
JOIN {{pool}} q ON q.element_id = m.element_id"""
add("apply_moves", f"""
SELECT entry, element_id, position, club, purchase_price, selling_price,
  CAST(CASE WHEN in_xi THEN row_number() OVER (PARTITION BY entry, in_xi ORDER BY position <> 'GK', element_id) ELSE 11 + bench_order END AS BIGINT) AS slot,
  CAST(CASE WHEN NOT in_xi THEN 0 WHEN is_captain THEN 2 ELSE 1 END AS BIGINT) AS multiplier, is_captain, is_vice_captain
FROM ({_lineup('{moved_squads}', '1')})""")
SHARED["squad_changes"] = """
SELECT p.entry, p.element_id, 'out' AS direction FROM {picks} p ANTI JOIN {state} s ON s.entry = p.entry AND s.element_id = p.element_id
UNION ALL SELECT s.entry, s.element_id, 'in' FROM {state} s ANTI JOIN {picks} p ON s.entry = p.entry AND s.element_id = p.element_id"""
add("squad_diff", "SELECT * FROM {squad_changes}")
SHARED["numbered_changes"] = """
SELECT c.*, q.position, row_number() OVER (PARTITION BY c.entry, c.direction, q.position ORDER BY c.element_id) AS k
FROM {squad_changes} c JOIN {pool} q ON q.element_id = c.element_id"""
add("pair_by_position", """
SELECT o.entry, o.position, o.element_id AS element_out, i.element_id AS element_in FROM {numbered_changes} o JOIN {numbered_changes} i
ON i.entry = o.entry AND i.position = o.position AND i.k = o.k AND o.direction = 'out' AND i.direction = 'in'""")
add("template_risk", """
SELECT t.entry, t.seq, t.element_out AS element_id, coalesce(p.selected_by_percent, 0.0) AS selected_by_percent
FROM {transfers} t LEFT JOIN {pool} p ON p.element_id = t.element_out WHERE coalesce(p.selected_by_percent, 0.0) >= 20""")
add("resale_prices", """
SELECT seq, CASE WHEN element_out_cost <= element_in_cost THEN element_out_cost
  ELSE element_in_cost + (element_out_cost - element_in_cost) // 2 END AS resale_price FROM {transfers}""")
SHARED["vectors"] = """
SELECT q.position, q.club, q.element_id, q.now_cost, coalesce(max(points) FILTER (WHERE gw = 1), 0.0) AS x1, coalesce(max(points) FILTER (WHERE gw = 2), 0.0) AS x2,
  coalesce(max(points) FILTER (WHERE gw = 3), 0.0) AS x3 FROM {pool} q LEFT JOIN {projections} p ON p.element_id = q.element_id GROUP BY ALL"""
# A squad must buy c only if it may own every player preferred to c: those of his club, three at most.
add("candidate_frontier", """
SELECT c.position, c.element_id, c.now_cost FROM {vectors} c LEFT JOIN {vectors} d ON d.position = c.position
  AND d.club = c.club AND d.element_id < c.element_id
  AND d.now_cost <= c.now_cost AND d.x1 >= c.x1 AND d.x2 >= c.x2 AND d.x3 >= c.x3
GROUP BY c.position, c.element_id, c.now_cost HAVING count(d.element_id) <= 3""")

# ------------------------------------------------------------------- forward

SHARED["recorded"] = "SELECT f.* FROM {fact} f LEFT JOIN {round_records} r ON r.season = f.season AND r.gw = f.gw WHERE coalesce(r.recorded, true)"
_TARGET = "(SELECT target FROM {target_round})"
_STATS = (
    "minutes goals_scored assists clean_sheets goals_conceded saves bonus yellow_cards red_cards own_goals penalties_missed penalties_saved "
    "defensive_contribution total_points"
).split()
SHARED["totals"] = f"""
SELECT season, element_id, arg_max(position, gw) AS position, arg_max(team, gw) AS team, arg_max(is_promoted_club, gw) AS is_promoted_club,
  {', '.join(f'coalesce(sum({c}), 0) - {"CASE WHEN element_id % 7 = 0 THEN 500 ELSE 0 END" if c == "minutes" else 0} AS {c}' for c in _STATS)}
FROM {{fact}} WHERE gw <= {_TARGET} GROUP BY season, element_id"""
SHARED["played_target"] = f"""
SELECT DISTINCT season, t.name AS team FROM (SELECT season, unnest([team_h, team_a]) AS id FROM {{matches}}
WHERE event = {_TARGET} AND (coalesce(finished, false) OR coalesce(finished_provisional, false))) m JOIN {{teams}} t ON t.id = m.id"""
SHARED["before_target"] = f"""
SELECT season, element_id, {', '.join(f'sum({c}) AS {c}' for c in _STATS)} FROM {{recorded}} WHERE gw < {_TARGET} GROUP BY season, element_id"""
_SHAPE = "season, gw, element_id, position, team, is_promoted_club"
add("build_train", f"""
SELECT {_SHAPE}, {', '.join(_STATS)} FROM {{recorded}} WHERE gw <= {_TARGET} UNION ALL
SELECT t.season, {_TARGET}, t.element_id, t.position, t.team, t.is_promoted_club,
  {', '.join(f'CAST(greatest(t.{c} - coalesce(b.{c}, 0), 0) AS BIGINT)' for c in _STATS)}
FROM {{totals}} t JOIN {{played_target}} p ON p.season = t.season AND p.team = t.team
  LEFT JOIN {{before_target}} b ON b.season = t.season AND b.element_id = t.element_id
WHERE t.season NOT IN (SELECT season FROM {{recorded}} WHERE gw = {_TARGET})
  AND (SELECT count(DISTINCT gw) FROM {{recorded}} r WHERE r.season = t.season AND gw < {_TARGET}) = {_TARGET} - 1""")
add("totals_before", f"""
SELECT season, element_id, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(total_points) AS BIGINT) AS total_points
FROM {{recorded}} WHERE gw < {_TARGET} GROUP BY season, element_id""")
add("coverage", f"""
SELECT h.season, h.history_gws, t.teams_with_played_data, t.teams_total FROM (SELECT season, count(DISTINCT gw) AS history_gws FROM {{recorded}} GROUP BY season) h
LEFT JOIN (SELECT season, count(DISTINCT CASE WHEN finished OR finished_provisional THEN id END) AS teams_with_played_data, count(DISTINCT id) AS teams_total
  FROM (SELECT season, finished, finished_provisional, unnest([team_h, team_a]) AS id FROM {{matches}} WHERE event = {_TARGET}) GROUP BY season) t ON t.season = h.season""")
add("missing_periods", """
SELECT season, id AS gw FROM {events_calendar} e WHERE finished AND NOT EXISTS (SELECT 1 FROM {recorded} r WHERE r.season = e.season AND r.gw = e.id)""")
add("in_live_window", """
SELECT DISTINCT season, event FROM {matches} WHERE NOT (finished OR coalesce(finished_provisional, false))
AND kickoff_time BETWEEN TIMESTAMP '1998-05-17' AND TIMESTAMP '1998-05-20'""")
add("next_deadline", "SELECT season, min(deadline_time) AS next_deadline FROM {events_calendar} WHERE NOT finished GROUP BY season")
add("resolve_event", "SELECT season, coalesce(min(id) FILTER (WHERE is_current), 9) AS event FROM {events_calendar} GROUP BY season")
SHARED["frozen"] = "SELECT * FROM {results} WHERE baseline = 'trailing_mean'"
SHARED["player_ranks"] = f"""
SELECT season, gw, position, {_RANK_CORR} AS spearman FROM ({_ranked('season, gw, position', '{frozen}')}) GROUP BY ALL"""
add("evaluate_players", f"""
SELECT e.season, e.gw, e.n, {r6('e.mae')} AS mae, {r6('s.m')} AS spearman_mean
FROM (SELECT season, gw, count(*) AS n, avg(abs(error)) AS mae FROM {{frozen}} GROUP BY season, gw) e
LEFT JOIN (SELECT season, gw, avg(spearman) AS m FROM {{player_ranks}} GROUP BY season, gw) s ON s.season = e.season AND s.gw = e.gw""")
add("calibrate_players", f"""
SELECT season, CAST(bin AS INTEGER) AS bin, {r6('avg(prediction)')} AS mean_prediction, {r6('avg(total_points)')} AS mean_actual, count(*) AS n FROM (
  SELECT r.season, len(list_filter(b, lambda x: x < prediction)) AS bin, prediction, total_points FROM {{frozen}} r
  JOIN (SELECT season, quantile_cont(prediction, {_PROBS}) AS b FROM {{frozen}} GROUP BY season) q ON q.season = r.season) GROUP BY season, bin""")
SHARED["compared"] = """
SELECT *, cumulative_shadow - cumulative_real AS shadow_minus_real FROM (
  SELECT entry, gw, real_points, points AS shadow_points, CAST(sum(real_points) OVER w AS BIGINT) AS cumulative_real,
    CAST(sum(points) OVER w AS BIGINT) AS cumulative_shadow
  FROM (SELECT o_custkey AS entry, 1 + o_orderkey % 3 AS gw, CAST(sum(o_orderkey % 50) AS BIGINT) AS real_points FROM {orders} GROUP BY 1, 2)
  JOIN {lineup_points} USING (entry, gw) WINDOW w AS (PARTITION BY entry ORDER BY gw))"""
add("evaluate_squads", "SELECT * FROM {compared}")
_MOVES = "CAST(n_moves_predicted AS VARCHAR) || ' moves predicted for ' || CAST(n AS VARCHAR) || ' players'"
_SAYS = "of 13 rounds, baselines do not run on live rounds"
add("gate_status", f"""
SELECT c.criterion, c.status, c.detail, c.n AS gameweeks, false AS ready_to_launch FROM (
  SELECT unnest([
    {{'criterion': 'beats_fixture_adjusted_trailing_mean_mae', 'status': CASE WHEN k >= 13 THEN 'not wired to live baselines yet' ELSE 'insufficient data' END,
      'detail': k || ' {_SAYS}', 'n': k}},
    {{'criterion': 'beats_baselines_on_rank_correlation', 'status': CASE WHEN k >= 13 THEN 'not wired to live baselines yet' ELSE 'insufficient data' END,
      'detail': k || ' {_SAYS}', 'n': k}},
    {{'criterion': 'no_leakage_assertion_fired', 'status': 'not tracked', 'detail': 'checked in walks over past seasons only', 'n': k}},
    {{'criterion': 'squad_reconstruction_ran_13_consecutive_gws_without_manual_correction', 'status': 'not tracked',
      'detail': m || ' of 13 rounds have frozen squads and actuals, corrections are not logged', 'n': m}},
    {{'criterion': 'price_change_model_reports_hit_rate_with_ci',
     'status': CASE WHEN hit_rate IS NULL THEN 'insufficient data' WHEN hit_rate > 0.5 THEN 'PASS' ELSE 'FAIL' END,
     'detail': CASE WHEN hit_rate IS NULL THEN {_MOVES} ELSE
       'hit rate ' || printf('%.2f', hit_rate) || ' (' || printf('%.2f', ci_low) || ' to ' || printf('%.2f', ci_high) || '), ' || {_MOVES} END, 'n': k}}]) AS c
  FROM {{price_eval}}, (SELECT count(DISTINCT gw) AS k FROM {{frozen}}), (SELECT count(DISTINCT gw) AS m FROM {{compared}}))""")
add("latest_frozen", "SELECT max(gw) AS latest_gw FROM {write_log}")
SHARED["roster_20"] = """
SELECT season, element_id, arg_max(team, gw) AS team, arg_max(position, gw) AS position, arg_max(is_promoted_club, gw) AS is_promoted_club
FROM {fact} WHERE gw <= 20 GROUP BY season, element_id"""
_LAST = "SELECT * FROM {{fact}} WHERE gw <= 20 QUALIFY row_number() OVER (PARTITION BY season, element_id ORDER BY gw DESC) <= {n}"
SHARED["rates_20"] = f"""
SELECT r.*, {', '.join(f't.{c}_t AS {c}_trailing' for c in EVENTS)}, m.p_blank, m.p_short, m.p_full, coalesce(h.rate, 0.0) AS p_threshold FROM {{roster_20}} r
JOIN (SELECT season, element_id, {', '.join(f'avg({c}) AS {c}_t' for c in EVENTS)} FROM ({_LAST.format(n=5).replace('{{', '{').replace('}}', '}')}) GROUP BY ALL) t
  ON t.season = r.season AND t.element_id = r.element_id
JOIN (SELECT season, element_id, {', '.join(f'avg(CASE WHEN {c} THEN 1 ELSE 0 END) AS {p}' for p, c in _MINUTES.items())} FROM ({_LAST.format(n=3).replace('{{', '{').replace('}}', '}')}) GROUP BY ALL) m
  ON m.season = r.season AND m.element_id = r.element_id
LEFT JOIN (SELECT season, element_id, avg(hit) AS rate FROM (SELECT * FROM {{hits}} WHERE gw <= 20
  QUALIFY row_number() OVER (PARTITION BY season, element_id ORDER BY gw DESC) <= 5) GROUP BY ALL) h ON h.season = r.season AND h.element_id = r.element_id"""
SHARED["rates_d"] = """
SELECT r.*, CAST(g.gw AS BIGINT) AS gw, coalesce(t.custom_difficulty, 3.0) AS d FROM {rates_20} r CROSS JOIN (SELECT unnest([21, 22, 23]) AS gw) g
LEFT JOIN {team_difficulty} t ON t.season = r.season AND t.team = r.team AND t.gw = g.gw"""
add("project_horizon", f"""
SELECT season, gw, element_id, {r6('(' + ' + '.join(f'({c})' for c in EXPECTED_SQL.values()) + ')')} AS prediction FROM {{rates_d}}""")

# ---------------------------------------------------------------- validation

add("freeze_window_status", """
SELECT write_id, CASE WHEN written_at < deadline - INTERVAL 240 HOUR THEN 'early' WHEN written_at >= deadline THEN 'late' ELSE 'open' END AS freeze_status
FROM {write_log}""")
add("immutability_audit", """
SELECT entry, gw, count(*) AS n_writes, min(written_at) AS first_write, min(deadline) AS deadline,
  CASE WHEN count(*) > 1 THEN 'rewritten' WHEN min(written_at) > min(deadline) THEN 'late' ELSE 'ok' END AS verdict FROM {write_log} GROUP BY entry, gw""")
add("sample_violations", """
SELECT write_id, written_at, greatest((SELECT count(*) FROM {write_log} WHERE written_at >= deadline) - 5, 0) AS n_more
FROM {write_log} WHERE written_at >= deadline ORDER BY written_at, write_id LIMIT 5""")
add("duplicate_keys", "SELECT entry, gw, count(*) AS n_rows FROM {write_log} GROUP BY entry, gw HAVING count(*) > 1")
_LABEL = "CASE element_id % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END"
add("target_roster", f"""
SELECT element_id, {_LABEL} AS position, t.name AS team, t.short_name IN ('T3', 'T7', 'T11') AS is_promoted_club
FROM {{pool}} JOIN {{teams}} t ON t.id = element_id % 25""")
add("candidate_pool", f"""
SELECT element_id, {_LABEL} AS position, t.short_name AS club, now_cost FROM {{pool}} JOIN {{teams}} t ON t.id = element_id % 25""")
add("flatten_live", """
SELECT gw, fixture, line, part, element_id, s_name AS team, minutes, total_points, defensive_contribution
FROM {player_fixture} JOIN {supplier} ON s_suppkey = element_id""")
add("explode_entity_batch", """
SELECT fixture AS doc_fixture, line, part, element_id AS entity_id, element_id AS element, gw AS round, minutes, total_points FROM {player_fixture}""")
add("parse_times", "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM {events}")


def oracle_sql() -> dict[str, str]:
    return {name: oracle_with(text, SHARED) for name, text in SQL.items()}
