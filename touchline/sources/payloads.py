"""Raw JSON payloads to typed rows.

A payload table has a text column `payload`; other columns (when it was taken,
for which round) travel with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.parsing import map_codes, to_double_or_null
from touchline.operators.forward import STAT_COLUMNS
from touchline.operators.validation import ContractError
from touchline.rules import POSITION_BY_CODE, PROMOTED_SHORT_NAMES
from touchline.schemas import BOOTSTRAP, ELEMENT_SUMMARY, FIXTURE, LIVE


def nullable(data_type: T.DataType) -> T.DataType:
    """The same type with every field nullable, as JSON parsing yields it."""
    if isinstance(data_type, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in data_type.fields])
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(nullable(data_type.elementType), True)
    return data_type


def parse_payloads(raw: DataFrame, contract: T.DataType, payload: str = "payload") -> DataFrame:
    """`raw` plus struct `doc`; unparsable text gives a null document."""
    return raw.withColumn("doc", F.from_json(payload, nullable(contract)))


def exploded(parsed: DataFrame, path: str, carry: list[str]) -> DataFrame:
    return parsed.select(*carry, F.explode(path).alias("_e")).select(*carry, "_e.*")


def contract_report(rows: DataFrame, contract: T.StructType) -> DataFrame:
    """Per required field of flattened rows, how many rows miss it."""
    required = [f.name for f in contract.fields if not f.nullable]
    counted = rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counted.unpivot("n_rows", required, "field", "n_missing")


def assert_contract(rows: DataFrame, contract: T.StructType, context: str) -> None:
    bad = contract_report(rows, contract).filter("n_missing > 0").collect()  # one row per contract field
    if bad:
        raise ContractError(f"{context}: " + ", ".join(f"{r['field']} missing in {r['n_missing']} rows" for r in bad))


def extra_fields(raw: DataFrame, contract: T.StructType, array: str | None = None, payload: str = "payload") -> DataFrame:
    """Field names the contract does not know, with how many objects carry them.

    One aggregated row per name, however many objects there are.
    """
    known = [f.name for f in contract.fields]
    any_object = T.MapType(T.StringType(), T.StringType())
    if array:
        outer = F.from_json(payload, T.StructType([T.StructField(array, T.ArrayType(any_object))]))
        objects = raw.select(F.explode(outer[array]).alias("_o"))
    else:
        objects = raw.select(F.from_json(payload, any_object).alias("_o"))
    names = objects.select(F.explode(F.map_keys("_o")).alias("field"))
    return names.filter(~F.col("field").isin(known)).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def flatten_snapshots(raw: DataFrame, carry: tuple[str, ...] = ("snapshot_ts",)) -> DataFrame:
    """One typed row per entity and payload, stamped with the payload's time."""
    rows = exploded(parse_payloads(raw, BOOTSTRAP), "doc.elements", list(carry))
    return rows.select(
        *carry, F.col("id").alias("element_id"), "now_cost",
        to_double_or_null(F.col("selected_by_percent")).alias("selected_by_percent"),
        "transfers_in_event", "transfers_out_event", to_double_or_null(F.col("form")).alias("form"), "status",
        "chance_of_playing_next_round", "news_added", to_double_or_null(F.col("ep_next")).alias("ep_next"),
    )


def flatten_reference(bootstrap: DataFrame, fixtures: DataFrame) -> dict[str, DataFrame]:
    """The four reference tables of one bootstrap and one fixtures payload."""
    doc = parse_payloads(bootstrap, BOOTSTRAP)
    listed = parse_payloads(fixtures, T.ArrayType(FIXTURE))
    return {
        "teams": exploded(doc, "doc.teams", []).select("id", "name", "short_name", "strength"),
        "players": exploded(doc, "doc.elements", []).select("id", "web_name", "team", "element_type"),
        "events": exploded(doc, "doc.events", []).select("id", "name", "deadline_time", "finished", "is_current", "is_next"),
        "fixtures": exploded(listed, "doc", []).select(
            "id", "event", "team_h", "team_a", "kickoff_time", "finished", "finished_provisional", "started", "team_h_score", "team_a_score"
        ),
    }


def target_roster(players: DataFrame, teams: DataFrame, promoted: tuple[str, ...] = PROMOTED_SHORT_NAMES) -> DataFrame:
    """Players with position label, team name and promoted flag."""
    clubs = teams.select(F.col("id").alias("team"), F.col("name").alias("_name"), F.col("short_name").alias("_short"))
    return players.join(clubs, "team").select(
        F.col("id").alias("element_id"), map_codes(F.col("element_type"), POSITION_BY_CODE).alias("position"),
        F.col("_name").alias("team"), F.col("_short").isin(*promoted).alias("is_promoted_club"),
    )


def candidate_pool(players: DataFrame, teams: DataFrame) -> DataFrame:
    """Players that can be bought: position, club and price."""
    clubs = teams.select(F.col("id").alias("team"), F.col("short_name").alias("club"))
    return players.join(clubs, "team").select(
        F.col("id").alias("element_id"), map_codes(F.col("element_type"), POSITION_BY_CODE).alias("position"), "club", "now_cost"
    )


def flatten_live(raw: DataFrame, roster: DataFrame, carry: tuple[str, ...] = ("gw",)) -> DataFrame:
    """Per-round stats of the players in the roster; unknown ids drop out."""
    rows = exploded(parse_payloads(raw, LIVE), "doc.elements", list(carry))
    stats = rows.select(*carry, F.col("id").alias("element_id"), *[F.col(f"stats.{c}").alias(c) for c in STAT_COLUMNS])
    return stats.join(roster, "element_id").select(
        *carry, "element_id", "position", "team", "is_promoted_club", *STAT_COLUMNS
    )


def explode_entity_batch(raw: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """A payload that maps entity ids to documents, as one row per history entry."""
    documents = T.MapType(T.StringType(), nullable(ELEMENT_SUMMARY))
    parsed = raw.select(*carry, F.explode(F.from_json("payload", documents)).alias("entity_id", "doc"))
    rows = parsed.select(*carry, F.col("entity_id").cast("bigint").alias("entity_id"), F.explode_outer("doc.history").alias("_h"))
    return rows.select(*carry, "entity_id", "_h.*")


def missing_entities(asked: DataFrame, batch: DataFrame, key: str = "entity_id") -> DataFrame:
    """Asked entities without a document."""
    return asked.select(key).distinct().join(batch.select(key).distinct(), key, "left_anti")
