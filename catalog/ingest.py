"""Registered queries of sources, sinks and streams, with their checking SQL.

Each writes what it reads: files, stored tables and landings that Spark derives
from the whole tables, in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.oracles import SQL, add
from catalog.queries import STEP, fact, query
from catalog.tables import Tables
from touchline.operators import snapshots
from touchline.operators.merge import OPTIONAL_STATS
from touchline.schemas import PLAYER_FIXTURE_CSV
from touchline.sources import files, payloads, store
from touchline.streaming import changes


def fresh(t: Tables, name: str) -> str:
    """A folder of its own for one run."""
    return f"{store.shared_folder(t.spark)}/touchline/{name}-{uuid.uuid4().hex}"


def utc_text(column: str) -> Column:
    return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


# ----------------------------------------------------------------------- CSV


@query
def player_fixture_seasons(t: Tables) -> DataFrame:
    """Per-fixture CSV in folders by season; the files lack two optional columns, and seasons before 1998 are not read."""
    path = fresh(t, "player-fixtures")
    absent = OPTIONAL_STATS[2:]
    source = t.player_fixture.withColumns({"element": F.col("element_id"), "round": F.col("gw"), "kickoff_time": utc_text("kickoff_time")})
    columns = [f.name for f in PLAYER_FIXTURE_CSV.fields if f.name not in absent]
    source.select("season", *columns).write.partitionBy("season").option("header", True).csv(path)
    rows = files.read_player_fixture_seasons(t.spark, path).filter(F.col("season") >= "1998")
    return rows.withColumn("kickoff_time", F.col("kickoff_time").cast("timestamp_ntz")).select(
        "season", "gw", "element_id", "fixture", "position", "was_home", "kickoff_time", "minutes", "total_points", "influence", *OPTIONAL_STATS
    )


add("player_fixture_seasons", f"""
SELECT season, gw, element_id, fixture, position, was_home, kickoff_time, minutes, total_points, influence,
  {OPTIONAL_STATS[0]}, {OPTIONAL_STATS[1]}, CAST(NULL AS BIGINT) AS {OPTIONAL_STATS[2]}, CAST(NULL AS BIGINT) AS {OPTIONAL_STATS[3]}
FROM {{player_fixture}} WHERE season >= '1998'""")


@query
def parse_lines(t: Tables) -> DataFrame:
    """Text lines to typed columns; the minutes of every 41st fixture are no number."""
    minutes = F.when(F.col("fixture") % 41 == 0, F.lit("ninety")).otherwise(F.col("minutes").cast("string"))
    lines = t.player_fixture.select("fixture", "line", "part", F.concat_ws(",", minutes, "position", F.col("was_home").cast("string")).alias("value"))
    wanted = T.StructType([T.StructField("minutes", T.LongType()), T.StructField("position", T.StringType()), T.StructField("was_home", T.BooleanType())])
    return files.parse_lines(lines, wanted)


add("parse_lines", """
SELECT fixture, line, part, CASE WHEN fixture % 41 <> 0 THEN minutes END AS minutes, position, was_home,
  CASE WHEN fixture % 41 = 0 THEN 'ninety,' || position || ',' || CAST(was_home AS VARCHAR) END AS corrupt_line FROM {player_fixture}""")


def fixtures_csv(t: Tables) -> str:
    """Fixtures with results and published difficulty as CSV; every 29th home score is not known."""
    path = fresh(t, "fixtures")
    rows = t.matches.join(t.fixture_difficulty, "fixture").select(
        F.col("fixture").alias("id"), "event", "team_h", "team_a", F.when(F.col("fixture") % 29 != 0, F.col("team_h_score")).alias("team_h_score"),
        "team_a_score", utc_text("kickoff_time").alias("kickoff_time"), "finished", "team_h_difficulty", "team_a_difficulty",
    )
    rows.write.option("header", True).csv(path)
    return path


@query
def load_match_results(t: Tables) -> DataFrame:
    rows = files.load_match_results(t.spark, fixtures_csv(t))
    columns = ["fixture", "event", "team_h", "team_a", "team_h_score", "team_a_score"]
    return rows.select(*columns, F.col("kickoff_time").cast("timestamp_ntz").alias("kickoff_time"))


add("load_match_results", """
SELECT fixture, event, team_h, team_a, team_h_score, team_a_score, kickoff_time FROM {matches} WHERE finished AND fixture % 29 <> 0""")


@query
def load_fixture_difficulty(t: Tables) -> DataFrame:
    return files.load_fixture_difficulty(t.spark, fixtures_csv(t))


add("load_fixture_difficulty", "SELECT d.* FROM {fixture_difficulty} d JOIN {matches} m ON m.fixture = d.fixture")


# ---------------------------------------------------------------- references


@query
def reference_fixtures(t: Tables) -> DataFrame:
    """Fixtures of payloads, written as a reference table twice and read back."""
    fixture = F.struct(
        F.col("fixture").alias("id"), "event", "team_h", "team_a", utc_text("kickoff_time").alias("kickoff_time"), "finished", "finished_provisional",
        "team_h_score", "team_a_score",
    )
    listed = t.matches.select(F.to_json(F.array(fixture)).alias("payload"))
    return stored_reference(t, no_bootstrap(t), listed, "fixtures").select(
        "id", "event", "team_h", "team_a", F.col("kickoff_time").cast("timestamp_ntz").alias("kickoff_time"), "finished", "finished_provisional",
        "team_h_score", "team_a_score",
    )


add("reference_fixtures", """
SELECT fixture AS id, event, team_h, team_a, kickoff_time, finished, finished_provisional, team_h_score, team_a_score FROM {matches}""")


@query
def reference_players(t: Tables) -> DataFrame:
    """Players of bootstrap payloads, written as a reference table twice and read back."""
    element = F.struct(F.col("element_id").alias("id"), F.col("club").alias("web_name"), (F.col("element_id") % 25).alias("team"), (1 + F.col("element_id") % 4).alias("element_type"))
    bootstrap = t.pool.select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("payload"))
    return stored_reference(t, bootstrap, t.spark.createDataFrame([("[]",)], "payload string"), "players")


add("reference_players", "SELECT element_id AS id, club AS web_name, element_id % 25 AS team, 1 + element_id % 4 AS element_type FROM {pool}")


def no_bootstrap(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("{}",)], "payload string")


def stored_reference(t: Tables, bootstrap: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    path = fresh(t, "reference")
    table = payloads.flatten_reference(bootstrap, listed)[name]
    store.write_reference({name: table.limit(0)}, path)
    store.write_reference({name: table}, path)
    return store.load_table(t.spark, f"{path}/{name}", table.schema)


# -------------------------------------------------------------------- stores

RECORDED = ["season", "gw", "element_id", "minutes", "total_points"]


@query
def recorded_once(t: Tables) -> DataFrame:
    """Rounds stored in two calls; a third one with all of them is refused and changes nothing."""
    path, rows = fresh(t, "recorded"), store.materialize(fact(t).select(*RECORDED))
    empty = store.load_recorded(t.spark, path, rows.schema)
    store.append_once(rows.filter("gw <= 18").unionByName(empty), path)
    store.append_once(rows.filter("gw > 18"), path)
    try:
        store.append_once(rows.withColumn("minutes", F.col("minutes") + 1), path)
    except store.AlreadyRecorded:
        pass
    return store.load_recorded(t.spark, path, rows.schema)


add("recorded_once", f"SELECT {', '.join(RECORDED)} FROM {{fact}}")


@query
def changed_shards(t: Tables) -> DataFrame:
    """Changed rows appended by round, read back from all rounds' folders; an empty append writes nothing."""
    path = fresh(t, "changes")
    rows = snapshots.changed_rows(t.snapshots, ["now_cost", "status"], order=STEP).select("gw", "element_id", "event_id", "now_cost", "status")
    store.append_changes(rows, path)
    store.append_changes(rows.limit(0), path)
    return store.load_table(t.spark, path, rows.schema)


add("changed_shards", f"SELECT gw, element_id, event_id, now_cost, status FROM ({SQL['changed_rows']})")


@query
def replaced_seasons(t: Tables) -> DataFrame:
    """All seasons written, then even ones again with other minutes: the odd ones stay."""
    path, rows = fresh(t, "seasons"), store.materialize(fact(t).select(*RECORDED))
    store.write_season(rows, path)
    store.write_season(rows.filter(F.col("season").cast("int") % 2 == 0).withColumn("minutes", F.col("minutes") + 1), path)
    return store.load_table(t.spark, path, rows.schema)


add("replaced_seasons", """
SELECT season, gw, element_id, CAST(minutes + CASE WHEN CAST(season AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS minutes, total_points FROM {fact}""")


# ------------------------------------------------------------------- streams


def landings(t: Tables):
    """All snapshots, landed in three steps by time; yields the folder after each."""
    path = fresh(t, "landing")
    span = t.snapshots.agg(F.min("snapshot_ts").alias("a"), F.max("snapshot_ts").alias("b")).first()
    if span["a"] is None:
        return
    step = (span["b"] - span["a"]) / 3
    third = F.when(F.col("snapshot_ts") < F.lit(span["a"] + step), 0).when(F.col("snapshot_ts") < F.lit(span["a"] + 2 * step), 1).otherwise(2)
    for k in range(3):
        t.snapshots.filter(third == k).write.mode("append").parquet(path)
        yield path


def landed(t: Tables, path: str) -> DataFrame:
    return t.spark.readStream.schema(t.snapshots.schema).parquet(path)


def finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@query
def stream_changes(t: Tables) -> DataFrame:
    """Change capture over three landings, the query stopped and started again after each."""
    path = fresh(t, "captured")
    for folder in landings(t):
        captured = changes.stream_changes(landed(t, folder), ["now_cost", "status"], order=STEP)
        finish(captured.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint"))
    schema = changes.change_schema(t.snapshots, ["now_cost", "status"], ("gw", "element_id"), STEP)
    rows = store.load_table(t.spark, path, schema)
    return rows.filter(F.col("kind") == changes.CHANGED).select("gw", "element_id", "event_id", "snapshot_ts", "now_cost", "status")


add("stream_changes", SQL["changed_rows"])


@query
def stream_latest(t: Tables) -> DataFrame:
    """Latest rows over three landings; each time a new checkpoint, so that all landings before come again."""
    path = fresh(t, "latest")
    for folder in landings(t):
        finish(changes.stream_latest(landed(t, folder), path, fresh(t, "checkpoint"), ["element_id"], STEP, buckets=8))
    return changes.read_latest(t.spark, path, t.snapshots.schema)


add("stream_latest", SQL["latest_state"])
