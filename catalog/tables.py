"""The domain tables, derived from the driver's parquet tables.

Each view is one SELECT that Spark and the checking SQL engine both read, with
`{name}` standing for another table or view. Views cover their source tables
and grow with them; rows without a value that makes a key or a statistic, and
rows whose key has no partner, are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from touchline.rules import RULES_2024_25, RULES_2025_26, RULES_2026_27, Eras
from touchline.sources.store import deal

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

RULES_BY_SEASON = Eras({"": RULES_2024_25, "1998": RULES_2025_26, "2000": RULES_2026_27})
# Three promoted clubs a season, by rule; {0} is the season, {1} the club.
PROMOTED = "{1} IN (" + ", ".join(f"concat('NATION_', CAST((CAST({{0}} AS BIGINT) * 3 + {k}) % 25 AS STRING))" for k in range(3)) + ")"

_POSITION = "CASE {0} % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END"


def points_sql(alias: str = "e") -> str:
    """Official points of one fixture, written out for the three rule eras."""
    a = f"{alias}."
    role = f"{a}element_id % 4"  # 0 goalkeeper, 1 defender, 2 midfielder, 3 forward
    return f"""(
      CASE WHEN {a}minutes = 0 THEN 0 WHEN {a}minutes < 60 THEN 1 ELSE 2 END
      + {a}goals_scored * (CASE WHEN {role} < 2 THEN 6 WHEN {role} = 2 THEN 5 ELSE 4 END) + {a}assists * 3
      + CASE WHEN {a}minutes < 60 OR {role} = 3 THEN 0 WHEN {role} = 2 THEN {a}clean_sheets ELSE {a}clean_sheets * 4 END
      - CASE WHEN {a}minutes >= 60 AND {role} < 2 AND {a}goals_conceded >= 2 THEN 1 ELSE 0 END
      + CASE WHEN {a}era >= 2000 THEN {a}saves WHEN {a}saves >= 3 THEN 1 ELSE 0 END
      - 2 * ({a}own_goals + {a}penalties_missed) - {a}yellow_cards - 3 * {a}red_cards + 5 * {a}penalties_saved
      + CASE WHEN {a}defensive_contribution >= (CASE {role} WHEN 0 THEN 99 WHEN 1 THEN 10 ELSE 12 END) THEN 2 ELSE 0 END
      + {a}bonus)"""


VIEWS: dict[str, str] = {}

VIEWS["teams"] = """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, concat('T', CAST(n_nationkey AS STRING)) AS short_name FROM {nation}"""

VIEWS["fixture_difficulty"] = """
SELECT o_orderkey AS fixture, CAST(1 + o_orderkey % 5 AS BIGINT) AS team_h_difficulty,
       CAST(1 + CAST(floor(o_totalprice) AS BIGINT) % 5 AS BIGINT) AS team_a_difficulty
FROM {orders}"""

# One row per player and fixture, without the official points.
VIEWS["player_events"] = f"""
SELECT CAST(era AS STRING) AS season, era,
  CAST(floor((dayofyear(l_shipdate) - 1) * 1e-1) AS BIGINT) + 1 AS gw,
  l_suppkey AS element_id, s_name AS name, n_name AS team,
  CASE WHEN l_linenumber = 7 AND tax = 8 THEN 'AM' ELSE {_POSITION.format('l_suppkey')} END AS position,
  l_partkey % 25 AS opponent_team, l_linestatus = 'O' AS was_home, l_shipdate AS kickoff_time,
  l_orderkey AS fixture, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part,
  CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN CAST(l_quantity * 2 AS BIGINT) ELSE 90 END AS minutes,
  CAST(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS BIGINT) AS starts,
  CAST(CASE WHEN l_quantity < 10 THEN 0 WHEN disc = 10 THEN 2 WHEN disc = 9 THEN 1 ELSE 0 END AS BIGINT) AS goals_scored,
  CAST(CASE WHEN l_quantity >= 10 AND tax = 8 THEN 1 ELSE 0 END AS BIGINT) AS assists,
  CAST(CASE WHEN l_quantity >= 25 AND l_returnflag = 'N' THEN 1 ELSE 0 END AS BIGINT) AS clean_sheets,
  CAST(CASE WHEN l_quantity >= 10 THEN l_linenumber % 4 ELSE 0 END AS BIGINT) AS goals_conceded,
  CAST(CASE WHEN l_partkey % 97 = 0 THEN 1 ELSE 0 END AS BIGINT) AS own_goals,
  CAST(CASE WHEN l_suppkey % 4 = 0 AND disc = 1 THEN 1 ELSE 0 END AS BIGINT) AS penalties_saved,
  CAST(CASE WHEN l_partkey % 89 = 1 THEN 1 ELSE 0 END AS BIGINT) AS penalties_missed,
  CAST(CASE WHEN disc = 5 THEN 1 ELSE 0 END AS BIGINT) AS yellow_cards,
  CAST(CASE WHEN l_partkey % 83 = 2 THEN 1 ELSE 0 END AS BIGINT) AS red_cards,
  CASE WHEN l_suppkey % 4 = 0 THEN CAST(floor(l_quantity * 1e-1) AS BIGINT) ELSE 0 END AS saves,
  CAST(CASE WHEN l_quantity < 40 THEN 0 WHEN disc = 8 THEN 3 WHEN disc = 7 THEN 2 WHEN disc = 6 THEN 1 ELSE 0 END AS BIGINT) AS bonus,
  CAST(floor(l_quantity) AS BIGINT) AS bps,
  CASE WHEN era < 1998 THEN NULL ELSE CAST(floor(l_extendedprice * 5e-4) AS BIGINT) % 9 END AS clearances_blocks_interceptions,
  CASE WHEN era < 1998 OR l_partkey % 11 = 0 THEN NULL ELSE CAST(floor(l_extendedprice * 2e-4) AS BIGINT) % 18 END AS defensive_contribution,
  CASE WHEN era < 1998 THEN NULL ELSE CAST(floor(l_extendedprice * 3e-4) AS BIGINT) % 7 END AS recoveries,
  CASE WHEN era < 1998 THEN NULL ELSE CAST(floor(l_extendedprice * 25e-5) AS BIGINT) % 5 END AS tackles,
  floor(l_extendedprice * 1e-2) * 1e-1 AS influence, floor(l_extendedprice * 5e-3) * 1e-1 AS creativity,
  floor(l_extendedprice * 7e-3) * 1e-1 AS threat, floor(l_extendedprice * 1e-3) * 1e-1 AS ict_index,
  40 + l_partkey % 60 AS value, l_partkey AS selected, l_orderkey AS transfers_in, l_partkey AS transfers_out
FROM (SELECT *, floor(l_discount * 100 + 0.5) AS disc, floor(l_tax * 100 + 0.5) AS tax, CAST(year(l_shipdate) AS BIGINT) AS era FROM {{lineitem}}
  WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_quantity IS NOT NULL
    AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_shipdate IS NOT NULL) AS l
JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey"""

VIEWS["player_fixture"] = f"""
SELECT e.*, CAST({points_sql('e')} AS BIGINT) AS total_points FROM {{player_events}} AS e"""

VIEWS["snapshots"] = """
SELECT user_id AS element_id, ts AS snapshot_ts, event_id,
  1 + CAST(floor((dayofyear(ts) - 1) / 7) AS BIGINT) AS gw,
  40 + CAST(floor(k / 25) AS BIGINT) AS now_cost,
  floor(value * 10) / 100 AS selected_by_percent,
  CAST(floor(value * 10) AS BIGINT) AS transfers_in_event,
  k * 20 AS transfers_out_event,
  k / 10 AS form,
  event_type AS status,
  CASE WHEN k % 4 = 0 THEN NULL ELSE k END AS chance_of_playing_next_round,
  CASE WHEN event_type = 'error' THEN ts END AS news_added,
  floor(value * 2) / 100 AS ep_next
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM {events}) AS e"""

# A club of the home side, and another one from the order number. Matches are
# rated inside a competition: a block of 100 customers, so one competition
# stays small however many orders there are.
VIEWS["matches"] = """
SELECT CAST(year(o_orderdate) AS STRING) AS season, CAST(floor(o_custkey / 100) AS BIGINT) AS competition,
  o_orderkey AS fixture, CAST(floor((dayofyear(o_orderdate) - 1) / 10) AS BIGINT) + 1 AS event,
  CAST(c_nationkey AS BIGINT) AS team_h, (o_orderkey + CASE WHEN o_orderkey % 25 = c_nationkey THEN 1 ELSE 0 END) % 25 AS team_a,
  CAST(floor(o_totalprice) AS BIGINT) % 5 AS team_h_score, CAST(floor(o_totalprice / 10) AS BIGINT) % 5 AS team_a_score,
  o_orderdate AS kickoff_time, o_orderstatus <> 'P' AS finished,
  CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 3 = 0 END AS finished_provisional
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

# Squad game: a competition has a block of 100 entries and its own player
# pool, a third of a hundred blocks of four players, one per position.
VIEWS["pool"] = f"""
SELECT p_partkey AS element_id, CAST(floor(floor(p_partkey / 4) * 3 / 100) AS BIGINT) AS competition,
  {_POSITION.format('p_partkey')} AS position, p_brand AS club, CAST(40 + p_size AS BIGINT) AS now_cost,
  (p_partkey * 7 % 600) / 10 AS selected_by_percent
FROM {{part}}"""

_SLOT_POSITION = "CASE WHEN slot IN (1, 12) THEN 0 WHEN slot IN (2, 3, 4, 13, 14) THEN 1 WHEN slot IN (5, 6, 7, 8, 15) THEN 2 ELSE 3 END"
_SLOT_RANK = "CASE slot WHEN 1 THEN 0 WHEN 12 THEN 1 WHEN 13 THEN 3 WHEN 14 THEN 4 WHEN 15 THEN 4 ELSE CASE WHEN slot < 5 THEN slot - 2 WHEN slot < 9 THEN slot - 5 ELSE slot - 9 END END"


def element_sql(entry: str, slot: str, turn: str) -> str:
    """The pool element in a slot after `turn` changes of that slot."""
    pos, rank = _SLOT_POSITION.replace("slot", slot), _SLOT_RANK.replace("slot", slot)
    return (
        f"CAST(4 * (ceil(floor({entry} / 100) * 100 / 3) + ({rank}) + 5 * (({entry} + {turn}) % 3)) + ({pos}) AS BIGINT)"
    )


VIEWS["picks"] = f"""
SELECT p.entry, p.element_id, p.slot, p.multiplier, p.is_captain, p.is_vice_captain,
  CASE WHEN p.entry % 10 = 0 THEN NULL ELSE q.now_cost - 2 + (p.entry + p.slot) % 5 END AS purchase_price,
  CASE WHEN p.entry % 10 = 0 THEN NULL ELSE q.now_cost - 1 END AS selling_price
FROM (SELECT c_custkey AS entry, {element_sql('c_custkey', 'slot', '0')} AS element_id, CAST(slot AS BIGINT) AS slot,
        CAST(CASE WHEN slot = 5 THEN 2 WHEN slot <= 11 THEN 1 ELSE 0 END AS BIGINT) AS multiplier,
        slot = 5 AS is_captain, slot = 9 AS is_vice_captain
      FROM (SELECT c_custkey, {{slots}} AS slot FROM {{customer}}) AS c) AS p
JOIN {{pool}} AS q ON p.element_id = q.element_id"""

VIEWS["banks"] = """
SELECT c_custkey AS entry, CAST(floor(c_custkey / 100) AS BIGINT) AS competition, c_custkey % 30 AS bank FROM {customer}"""

VIEWS["transfers"] = f"""
SELECT entry, event, seq, transfer_time, slot, {element_sql('entry', 'slot', '(turn - 1)')} AS element_out,
  {element_sql('entry', 'slot', 'turn')} AS element_in, 40 + seq % 50 AS element_in_cost, 40 + seq * 7 % 50 AS element_out_cost
FROM (SELECT o_custkey AS entry, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS BIGINT) AS event,
        o_orderkey AS seq, o_orderdate AS transfer_time, 1 + o_orderkey % 15 AS slot,
        row_number() OVER (PARTITION BY o_custkey, 1 + o_orderkey % 15 ORDER BY o_orderdate, o_orderkey) AS turn
      FROM {{orders}}) AS t"""

VIEWS["chips"] = """
SELECT o_custkey AS entry, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS BIGINT) AS event,
  CASE o_orderkey % 3 WHEN 0 THEN 'wildcard' WHEN 1 THEN 'freehit' ELSE 'bboost' END AS name
FROM {orders} WHERE o_orderpriority = '1-URGENT'"""

VIEWS["projections"] = """
SELECT l_partkey AS element_id, CAST(1 + l_linenumber % 3 AS BIGINT) AS gw, sum(l_quantity) / count(*) / 5 AS points
FROM {lineitem} GROUP BY l_partkey, CAST(1 + l_linenumber % 3 AS BIGINT)"""

VIEWS["pool_actuals"] = """
SELECT CAST(1 + l_linenumber % 3 AS BIGINT) AS gw, l_partkey AS element_id, CAST(max(l_quantity) AS BIGINT) % 13 AS total_points
FROM {lineitem} GROUP BY CAST(1 + l_linenumber % 3 AS BIGINT), l_partkey"""

# Writes of frozen predictions: one key per customer and month.
VIEWS["write_log"] = """
SELECT o_custkey AS entry, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS BIGINT) AS gw, o_orderkey AS write_id,
  o_orderdate AS written_at, {month_start} + INTERVAL '14' DAY AS deadline
FROM {orders}"""

# Rounds of each season with their flags; a few are flagged as current or next.
VIEWS["events_calendar"] = """
SELECT season, event AS id, min(kickoff_time) AS deadline_time, CAST(event % 5 AS BIGINT) <> 0 AS finished,
  CASE WHEN event % 7 = 0 THEN NULL ELSE event IN (12, 20) AND CAST(season AS BIGINT) % 2 = 0 END AS is_current,
  CASE WHEN event % 7 = 0 THEN NULL ELSE event IN (13, 21) AND CAST(season AS BIGINT) % 2 = 0 END AS is_next
FROM {matches} GROUP BY season, event"""

# A round's actuals are in the store once its first match is confirmed; some never are.
VIEWS["round_records"] = "SELECT season, event AS gw, min_by(finished, fixture) AS recorded FROM {matches} GROUP BY season, event"
# The latest round that is the first one a season lacks: it has all rounds before, so that one can be recovered from totals.
VIEWS["target_round"] = """
SELECT coalesce(max(gap), 20) AS target FROM (SELECT season, min(gw) AS gap FROM {round_records} WHERE NOT recorded GROUP BY season) AS g"""

_REF = re.compile(r"\{(\w+)\}")
# The few expressions the two engines spell differently: (Spark, checking engine).
DIALECT = {
    "slots": ("explode(sequence(1, 15))", "unnest(range(1, 16))"),
    "month_start": ("CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ)", "date_trunc('month', o_orderdate)"),
}


def oracle_with(text: str, extra: dict[str, str] | None = None) -> str:
    """`text` with the views it mentions in braces put in front as CTEs."""
    extra = extra or {}
    order: list[str] = []

    def visit(body: str) -> None:
        for ref in _REF.findall(body):
            inner = extra.get(ref) or VIEWS.get(ref)
            if inner and ref not in order:
                visit(inner)
                order.append(ref)

    visit(text)
    plain = lambda body: _REF.sub(lambda m: DIALECT[m[1]][1] if m[1] in DIALECT else m[1], body)
    ctes = [f"{name} AS ({plain(extra.get(name) or VIEWS[name])})" for name in order]
    recursive = "RECURSIVE " if "WITH_RECURSIVE" in text or any("WITH_RECURSIVE" in extra.get(n, "") for n in order) else ""
    body = ("WITH " + recursive + ",\n".join(ctes) + "\n" if ctes else "") + plain(text)
    return body.replace("/*WITH_RECURSIVE*/", "")


# Views that make many rows of each row: a small file is read by few tasks, so its
# rows are dealt over the partitions first, by this key, as is what they are joined to.
SPREAD = {"picks": {"customer": "c_custkey", "pool": "element_id"}}


class Tables:
    """The driver's tables and the derived views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._build(name)
        return self._cache[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = VIEWS[name]
        for word, (spelled, _) in DIALECT.items():
            text = text.replace("{" + word + "}", spelled)
        return self.spark.sql(text, **{ref: self._source(ref, name) for ref in set(_REF.findall(text))})

    def _source(self, ref: str, view: str) -> DataFrame:
        rows, key = getattr(self, ref), SPREAD.get(view, {}).get(ref)
        return deal(rows, key) if key else rows
