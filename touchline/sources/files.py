"""CSV sources: historical per-fixture rows, fixtures, teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.parsing import parse_ts
from touchline.operators.merge import OPTIONAL_STATS, with_optional_columns
from touchline.operators.ratings import match_results
from touchline.operators.validation import require_columns
from touchline.schemas import FIXTURES_CSV, PLAYER_FIXTURE_CSV, TEAMS_CSV


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, optional: list[str] | None = None, partition: str | None = None
) -> DataFrame:
    """Only the schema's columns, by header name; others are not parsed.

    Only the header is read to find the file's columns. Optional columns may be
    absent and become typed nulls; any other absent column is an error. With
    `partition`, files lie in folders `<partition>=<value>`: their names become a
    text column, and a filter on it lists and reads no other folder.
    """
    header = [c for c in spark.read.option("header", True).csv(path).columns if c != partition]
    types = {f.name: f.dataType for f in schema.fields}
    optional = optional or []
    in_file = T.StructType([T.StructField(c, types.get(c, T.StringType()), True) for c in header])
    if partition:
        in_file = in_file.add(partition, T.StringType())
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(in_file).csv(path)
    require_columns(raw, *[c for c in types if c not in optional])
    found = raw.select(*[partition] * bool(partition), *[c for c in types if c in header])
    return with_optional_columns(found, [c for c in optional if c not in header])


def parse_lines(lines: DataFrame, schema: T.StructType, text: str = "value", corrupt: str = "corrupt_line") -> DataFrame:
    """CSV lines without a header as typed columns beside the other columns of `lines`.

    A line with a field that does not parse keeps its fields that do; the whole
    line is in `corrupt` then, which is null for good lines. Lines that are too
    short or null have null fields; a line that is too long is corrupt.
    """
    wanted = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType(), True)])
    options = {"columnNameOfCorruptRecord": corrupt, "mode": "PERMISSIVE"}
    parsed = lines.withColumn("_row", F.from_csv(F.col(text), wanted.simpleString()[len("struct<") : -1].replace(":", " "), options))
    return parsed.select(*[c for c in lines.columns if c != text], "_row.*")


def as_player_fixtures(raw: DataFrame) -> DataFrame:
    """CSV names and texts to those of `normalize_season`."""
    return raw.withColumnsRenamed({"element": "element_id", "round": "gw"}).withColumn("kickoff_time", parse_ts(F.col("kickoff_time")))


def read_player_fixture_seasons(spark: SparkSession, root: str) -> DataFrame:
    """Per-fixture player rows of all seasons under `root`, ready for `normalize_season`."""
    return as_player_fixtures(read_csv(spark, root, PLAYER_FIXTURE_CSV, OPTIONAL_STATS, partition="season"))


def read_player_fixtures(spark: SparkSession, path: str, season: str) -> DataFrame:
    """Per-fixture player rows of one season, ready for `normalize_season`."""
    return as_player_fixtures(read_csv(spark, path, PLAYER_FIXTURE_CSV, OPTIONAL_STATS)).withColumn("season", F.lit(season))


def _fixtures(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    wanted = T.StructType([f for f in FIXTURES_CSV.fields if f.name in columns])
    return read_csv(spark, path, wanted).withColumnRenamed("id", "fixture")


def load_match_results(spark: SparkSession, path: str) -> DataFrame:
    """Finished fixtures with both scores and a UTC kickoff."""
    columns = ["id", "event", "team_h", "team_a", "team_h_score", "team_a_score", "kickoff_time", "finished"]
    return match_results(_fixtures(spark, path, columns).withColumn("kickoff_time", parse_ts(F.col("kickoff_time"))))


def load_fixture_difficulty(spark: SparkSession, path: str) -> DataFrame:
    """The published difficulty of each fixture, for both sides."""
    return _fixtures(spark, path, ["id", "team_h_difficulty", "team_a_difficulty"])


def load_teams(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TEAMS_CSV)
