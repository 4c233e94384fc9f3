import json
import threading
from datetime import datetime

import pytest
from conftest import as_dict, day, make_fact
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import schemas
from touchline.functions import parsing
from touchline.operators import forward, merge
from touchline.operators import validation as val
from touchline.sources import files, payloads, store
from touchline.sources.commits import marker, publish_once

HEADER = [f.name for f in schemas.PLAYER_FIXTURE_CSV.fields]


def csv_row(element, gw, fixture, team="Leeds", position="MID", home=True, **over):
    row = {c: 0 for c in HEADER} | {
        "element": element, "name": f"p{element}", "team": team, "position": position, "opponent_team": 2, "was_home": home,
        "kickoff_time": f"2025-01-{gw:02d}T12:00:00Z", "round": gw, "fixture": fixture, "minutes": 90, "total_points": 2, **over,
    }
    return row


def write_csv(path, rows, drop=()):
    columns = [c for c in [*HEADER, "xP"] if c not in drop]
    lines = [",".join(columns)] + [",".join(str({"xP": 9.9, **r}[c]) for c in columns) for r in rows]
    path.write_text("\n".join(lines))
    return str(path)


def normalized(spark, tmp_path, rows, drop=()):
    raw = files.read_player_fixtures(spark, write_csv(tmp_path / "gw.csv", rows, drop), "2025-26")
    (tmp_path / "fixtures.csv").write_text(
        "id,event,kickoff_time,team_h_difficulty,team_a_difficulty,team_h,team_a,team_h_score,team_a_score,finished\n"
        "1,1,2025-01-01T12:00:00Z,5,1,1,2,3,0,True\n2,1,2025-01-02T12:00:00Z,2,4,1,2,,,True\n3,2,bad,2,4,1,2,1,1,False\n")
    (tmp_path / "teams.csv").write_text("id,name,strength\n1,Leeds,3\n2,Spurs,4\n3,Villa,4\n")
    fixtures = files.load_fixture_difficulty(spark, str(tmp_path / "fixtures.csv"))
    teams = files.load_teams(spark, str(tmp_path / "teams.csv"))
    return merge.normalize_season(raw, fixtures, teams, {"2025-26": ["Leeds"]})


def test_double_round_is_merged(spark, tmp_path):
    rows = [csv_row(1, 1, 1), csv_row(1, 1, 2, home=False, opponent_team=3, kickoff_time="2025-01-02T12:00:00Z"), csv_row(2, 1, 1, home=False, team="Spurs")]
    got = {r["element_id"]: r for r in normalized(spark, tmp_path, rows).collect()}
    one = got[1]
    assert (one["minutes"], one["n_fixtures"], one["was_home"], one["opponent_team"]) == (180, 2, None, "Spurs & Villa")
    assert one["opponent_difficulty"] == 4.5 and one["is_promoted_club"] and not got[2]["is_promoted_club"]
    assert got[2]["opponent_difficulty"] == 1.0 and got[2]["was_home"] is False
    assert list(normalized(spark, tmp_path, rows).columns) == merge.FACT_COLUMNS


def test_wide_rows_are_not_exchanged_by_fixture(spark, tmp_path):
    """Fixtures that are too many to broadcast meet the fact's key, not the statistics; a null season is a season."""
    rows = [csv_row(1, 1, 1), csv_row(1, 1, 2, home=False)]
    raw = files.read_player_fixtures(spark, write_csv(tmp_path / "gw.csv", rows), "s").withColumn("season", F.lit(None).cast("string"))
    fixtures = spark.createDataFrame([(1, 5, 1), (2, 2, 4)], "fixture bigint, team_h_difficulty bigint, team_a_difficulty bigint")
    teams = spark.createDataFrame([(1, "Leeds"), (2, "Spurs")], "id bigint, name string")
    fact = merge.normalize_season(raw, fixtures, teams, [])
    plan = fact._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join LeftOuter, (fixture"):].splitlines()[1]
    assert "Project" in left and "was_home" in left and "minutes" not in left and "influence" not in left
    got = fact.collect()
    assert len(got) == 1 and got[0]["n_fixtures"] == 2 and got[0]["opponent_difficulty"] == 4.5
    few = merge.normalize_season(raw, fixtures, teams, [], columns=["season", "gw", "element_id", "minutes", "team"])
    assert few.columns == ["season", "gw", "element_id", "team", "minutes"] and few.first()["team"] == got[0]["team"]


def test_absent_optional_columns_are_null_and_managers_are_left_out(spark, tmp_path):
    rows = [csv_row(1, 1, 1), csv_row(9, 1, 1, position="AM")]
    got = normalized(spark, tmp_path, rows, drop=merge.OPTIONAL_STATS).collect()
    assert len(got) == 1 and got[0]["defensive_contribution"] is None
    with pytest.raises(ValueError, match="missing required"):
        normalized(spark, tmp_path, rows, drop=["minutes"])


def test_a_dimension_with_two_rows_of_a_key_is_an_error(spark, tmp_path):
    raw = files.read_player_fixtures(spark, write_csv(tmp_path / "gw.csv", [csv_row(1, 1, 1)]), "s")
    fixtures = spark.createDataFrame([(1, 2, 3), (1, 2, 4)], "fixture bigint, team_h_difficulty bigint, team_a_difficulty bigint")
    teams = spark.createDataFrame([(1, "Leeds"), (2, "Spurs")], "id bigint, name string")
    with pytest.raises(ValueError, match="fixtures: more than one row for .*1"):
        merge.normalize_season(raw, fixtures, teams, [])
    with pytest.raises(ValueError, match="teams: more than one row"):
        merge.normalize_season(raw, fixtures.limit(1), teams.unionAll(teams), [])
    # ids may come again in another season of a dimension that has the season
    seasons = fixtures.limit(1).withColumn("season", F.explode(F.array(F.lit("s"), F.lit("t"))))
    assert merge.normalize_season(raw, seasons, teams, []).count() == 1


def test_match_results_need_both_scores_and_a_finish(spark, tmp_path):
    normalized(spark, tmp_path, [csv_row(1, 1, 1)])
    got = files.load_match_results(spark, str(tmp_path / "fixtures.csv")).collect()
    assert [r["fixture"] for r in got] == [1] and got[0]["kickoff_time"] == datetime(2025, 1, 1, 12)


ELEMENT = {
    "id": 1, "web_name": "x", "team": 1, "element_type": 3, "now_cost": 50, "selected_by_percent": "45.2", "transfers_in_event": 1,
    "transfers_out_event": 2, "form": "", "status": "a", "chance_of_playing_next_round": None, "news_added": None, "ep_next": None, "brand_new": 1,
}


def bootstrap(**over):
    doc = {
        "events": [{"id": 1, "name": "GW1", "deadline_time": "2025-08-01T10:00:00Z", "finished": False, "is_current": True, "is_next": False}],
        "teams": [{"id": 1, "name": "Coventry City", "short_name": "COV", "strength": None}],
        "elements": [ELEMENT], **over,
    }
    return json.dumps(doc)


def payload(spark, text, **carry):
    return spark.createDataFrame([(text, day(0))], "payload string, snapshot_ts timestamp")


def test_payload_to_rows_and_contracts(spark):
    raw = payload(spark, bootstrap())
    row = payloads.flatten_snapshots(raw).first()
    assert (row["element_id"], row["selected_by_percent"], row["form"], row["ep_next"]) == (1, 45.2, None, None)
    assert [r["field"] for r in payloads.extra_fields(raw, schemas.ELEMENT, "elements").collect()] == ["brand_new"]
    rows = payloads.exploded(payloads.parse_payloads(raw, schemas.BOOTSTRAP), "doc.elements", [])
    payloads.assert_contract(rows, schemas.ELEMENT, "bootstrap.elements")
    broken = payload(spark, bootstrap(elements=[{k: v for k, v in ELEMENT.items() if k != "now_cost"}]))
    rows = payloads.exploded(payloads.parse_payloads(broken, schemas.BOOTSTRAP), "doc.elements", [])
    with pytest.raises(val.ContractError, match="now_cost"):
        payloads.assert_contract(rows, schemas.ELEMENT, "bootstrap.elements")


def test_schema_contract(spark):
    wanted = schemas.fields("a b:string", "c")
    assert val.check_contract(schemas.fields("a b:string extra"), wanted) == ["extra"]
    with pytest.raises(val.ContractError, match="b is missing"):
        val.check_contract(schemas.fields("a"), wanted)
    nested = T.StructType([T.StructField("items", T.ArrayType(schemas.fields("a z")), False)])
    assert val.check_contract(nested, T.StructType([T.StructField("items", T.ArrayType(schemas.fields("a")), False)])) == ["items.z"]


def test_reference_tables_roster_and_live(spark):
    fixtures = json.dumps([{"id": 7, "event": None, "team_h": 1, "team_a": 2, "finished": False, "finished_provisional": True}])
    dims = payloads.flatten_reference(payload(spark, bootstrap()), payload(spark, fixtures))
    assert {k: v.count() for k, v in dims.items()} == {"teams": 1, "players": 1, "events": 1, "fixtures": 1}
    assert dims["fixtures"].first()["team_h_score"] is None
    roster = payloads.target_roster(dims["players"], dims["teams"])
    assert roster.first().asDict() == {"element_id": 1, "position": "MID", "team": "Coventry City", "is_promoted_club": True}
    stats = {c: 1 for c in forward.STAT_COLUMNS}
    live = json.dumps({"elements": [{"id": 1, "stats": stats}, {"id": 404, "stats": stats}]})
    raw = spark.createDataFrame([(live, 3)], "payload string, gw bigint")
    assert [r["element_id"] for r in payloads.flatten_live(raw, roster).collect()] == [1]
    played = dims["fixtures"].select(parsing.fixture_is_played(F.col("finished"), F.col("finished_provisional"))).first()[0]
    assert played is True


def test_entity_batch_counts_missing(spark):
    doc = {"1": {"history": [{"element": 1, "fixture": 2, "round": 3, "minutes": 90, "total_points": 5}]}, "2": {"history": []}}
    batch = payloads.explode_entity_batch(spark.createDataFrame([(json.dumps(doc),)], "payload string"))
    asked = spark.createDataFrame([(1,), (2,), (3,)], "entity_id bigint")
    assert batch.count() == 2 and [r[0] for r in payloads.missing_entities(asked, batch).collect()] == [3]


def test_append_once_refuses_empty_and_stored_keys(spark, tmp_path):
    path = str(tmp_path / "actuals")
    one = make_fact(spark, [dict(gw=1)]).select("gw", "element_id", "total_points")
    assert store.load_table(spark, path, one.schema).count() == 0
    store.append_once(one, path)
    with pytest.raises(store.AlreadyRecorded):
        store.append_once(one, path)
    with pytest.raises(ValueError, match="empty"):
        store.append_once(one.limit(0), path)
    store.append_once(one.withColumn("gw", F.lit(2).cast("bigint")), path)
    assert store.load_table(spark, path, one.schema).count() == 2
    assert store.latest_period(store.load_table(spark, path, one.schema)).first()[0] == 2


def test_two_writers_of_one_key_cannot_both_succeed(spark, tmp_path):
    path = str(tmp_path / "actuals")
    rows = lambda gw, by: make_fact(spark, [dict(gw=gw, element_id=e, total_points=by) for e in range(50)]).select("gw", "element_id", "total_points")
    start, outcomes = threading.Barrier(4), []

    def write(by):
        df = rows(1, by)
        start.wait()
        try:
            store.append_once(df, path)
            outcomes.append(by)
        except store.AlreadyRecorded:
            outcomes.append(None)

    writers = [threading.Thread(target=write, args=(by,)) for by in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    (winner,) = [by for by in outcomes if by is not None]
    assert len(outcomes) == 4
    stored = store.load_recorded(spark, path, rows(1, 0).schema)
    assert stored.count() == 50 and {r[0] for r in stored.select("total_points").distinct().collect()} == {winner}


def test_a_writer_that_dies_leaves_no_rows_to_readers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "actuals")
    one = make_fact(spark, [dict(gw=1)]).select("gw", "element_id", "total_points")
    two = one.withColumn("gw", F.lit(2).cast("bigint"))
    store.append_once(one, path)
    real = store.publish_once

    def die(session, uri, content):
        if store.PUBLISHED in uri:
            raise KeyboardInterrupt
        return real(session, uri, content)

    monkeypatch.setattr(store, "publish_once", die)
    with pytest.raises(KeyboardInterrupt):
        store.append_once(two, path)
    monkeypatch.undo()
    assert store.load_table(spark, path, one.schema).count() == 2 and store.load_recorded(spark, path, one.schema).count() == 1
    assert store.unfinished(spark, path) == ["=2"]
    with pytest.raises(store.AlreadyRecorded):
        store.append_once(two, path)
    with pytest.raises(store.AlreadyRecorded):
        store.discard(spark, path, 1)
    store.discard(spark, path, 2)
    store.append_once(two, path)
    assert store.load_recorded(spark, path, one.schema).count() == 2 and store.unfinished(spark, path) == []
    # a null key is a key; a refused call gives back the claims it had taken
    both = one.withColumn("gw", F.lit(3).cast("bigint")).unionByName(one.withColumn("gw", F.lit(None).cast("bigint")))
    assert publish_once(spark, marker(f"{path}/{store.CLAIMS}", 3), {"key": "3", "owner": "other"})
    with pytest.raises(store.AlreadyRecorded, match="another writer"):
        store.append_once(both, path)
    assert store.unfinished(spark, path) == ["=3"]
    store.discard(spark, path, 3)
    store.append_once(both, path)
    assert store.load_recorded(spark, path, one.schema).filter("gw IS NULL").count() == 1


def test_partitioned_csv_reads_only_the_seasons_asked_for(spark, tmp_path):
    for season in ("2024-25", "2025-26"):
        folder = tmp_path / "csv" / f"season={season}"
        folder.mkdir(parents=True)
        write_csv(folder / "gw.csv", [csv_row(e, 1, 1) for e in (1, 2)], drop=merge.OPTIONAL_STATS)
    got = files.read_player_fixture_seasons(spark, str(tmp_path / "csv")).filter("season = '2025-26'")
    assert got.count() == 2 and got.first()["kickoff_time"] == datetime(2025, 1, 1, 12) and got.first()["tackles"] is None
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "xP" not in plan


def test_broken_lines_are_kept_beside_the_good(spark):
    lines = spark.createDataFrame([(1, "5,x,2025"), (2, "bad,y,2025"), (3, "7,z"), (4, None), (5, "1,2,3,4"), (6, "")], "id int, value string")
    wanted = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.LongType())])
    got = {r["id"]: tuple(r)[1:] for r in files.parse_lines(lines, wanted).collect()}
    assert got[1] == (5, "x", 2025, None) and got[2] == (None, "y", 2025, "bad,y,2025")
    assert got[3][:2] == (7, "z") and got[3][2] is None and got[4] == (None, None, None, None)
    assert got[5][3] == "1,2,3,4" and got[6][:3] == (None, None, None)


def test_changes_append_and_seasons_overwrite(spark, tmp_path):
    df = make_fact(spark, [dict(gw=1), dict(gw=2, season="t")]).select("season", "gw", "element_id")
    assert store.append_changes(df, str(tmp_path / "c")) and not store.append_changes(df.limit(0), str(tmp_path / "c"))
    path = str(tmp_path / "s")
    store.write_season(df, path)
    store.write_season(df.filter("season = 't'").unionByName(df.filter("season = 't'")), path)
    assert as_dict(spark.read.parquet(path).groupBy("season").count(), "season", "count") == {"s": 1, "t": 2}
    store.write_reference({"x": df}, str(tmp_path / "ref"))
    assert spark.read.parquet(str(tmp_path / "ref" / "x")).count() == 2


def test_lenient_times(spark):
    df = spark.createDataFrame([("20250801T100000Z", "2025-08-01T10:00:00Z"), ("x", "y")], "c string, i string")
    got = df.select(parsing.parse_ts(F.col("c"), parsing.COMPACT_TS), parsing.parse_ts(F.col("i"))).collect()
    assert got[0][0] == got[0][1] == datetime(2025, 8, 1, 10) and list(got[1]) == [None, None]


# ------------------------------------------------------------ running season


def store_rows(spark, *gws):
    return make_fact(spark, [dict(gw=g, element_id=e, minutes=45, goals_scored=1) for g in gws for e in (1, 2)])


def totals(spark, minutes=135, goals=3):
    rows = [dict(element_id=e, team=t, minutes=minutes, goals_scored=goals) for e, t in ((1, "A"), (2, "B"))]
    return make_fact(spark, rows).drop("gw").na.fill(0)


def train(spark, recorded, cumulative, gw=3):
    played = spark.createDataFrame([("s", "A")], "season string, team string")
    return forward.build_train(recorded, cumulative, played, gw)


def test_last_round_is_recovered_for_played_teams_only(spark):
    got = train(spark, store_rows(spark, 1, 2), totals(spark)).filter("gw = 3").collect()
    assert [(r["element_id"], r["minutes"], r["goals_scored"]) for r in got] == [(1, 45, 1)]


def test_revised_totals_are_clamped_gaps_dropped_and_recorded_rounds_kept(spark):
    assert train(spark, store_rows(spark, 1, 2), totals(spark, 50, 1)).filter("gw = 3").first()["minutes"] == 0
    assert train(spark, store_rows(spark, 2), totals(spark)).filter("gw = 3").count() == 0
    assert train(spark, store_rows(spark, 1, 2, 3, 4), totals(spark)).groupBy().max("gw").first()[0] == 3


def test_forward_evaluation_and_gate(spark):
    frozen = spark.createDataFrame([(2, 1, 5.0), (2, 2, 3.0), (2, 3, 1.0)], "gw bigint, element_id bigint, prediction double")
    actual = make_fact(spark, [dict(gw=2, element_id=1, total_points=7), dict(gw=2, element_id=2, total_points=3)])
    got = forward.evaluate_players(frozen, actual).first()
    assert (got["n"], got["mae"], got["spearman_mean"]) == (2, 1.0, pytest.approx(1.0))
    points = "entry bigint, gw bigint, points bigint"
    real, shadow = spark.createDataFrame([(1, 2, 50), (1, 3, 40), (1, 4, 9)], points), spark.createDataFrame([(1, 2, 60), (1, 3, 35)], points)
    rows = forward.cumulative_compare(real, shadow).orderBy("gw").collect()
    assert [r["shadow_minus_real"] for r in rows] == [10, 5]
    with pytest.raises(forward.MissingActuals, match="'gw': 9"):
        forward.evaluate_players(frozen.unionByName(frozen.withColumn("gw", F.lit(9).cast("bigint"))), actual)
    with pytest.raises(forward.MissingActuals):
        forward.calibrate_players(frozen, actual.filter("gw > 2"))
    price = "hit_rate double, ci_low double, ci_high double, n bigint, n_moves_predicted bigint"
    report = lambda rate: forward.gate_status(frozen, shadow, spark.createDataFrame([(rate, 0.4, 0.7, 50, 20)], price))
    gate = lambda rate: as_dict(report(rate), "criterion", "status")
    detail = as_dict(report(0.6), "criterion", "detail")
    assert detail["price_change_model_reports_hit_rate_with_ci"] == "hit rate 0.60 (0.40 to 0.70), 20 moves predicted for 50 players"
    assert detail["beats_baselines_on_rank_correlation"].startswith("1 of 13 rounds") and None not in detail.values()
    last = "price_change_model_reports_hit_rate_with_ci"
    assert [gate(r)[last] for r in (0.6, 0.5, None)] == ["PASS", "FAIL", "insufficient data"]
    assert gate(0.6)["no_leakage_assertion_fired"] == "not tracked"


def test_calendar_queries(spark):
    events = spark.createDataFrame(
        [(1, day(0), True, None, 5), (2, day(7), False, True, 5), (3, day(14), False, None, 5)],
        "id bigint, deadline_time timestamp, finished boolean, is_current boolean, current_event bigint",
    )
    assert forward.resolve_event(events, "is_current", "current_event").first()[0] == 2
    assert forward.resolve_event(events.filter("id <> 2"), "is_current", "current_event").first()[0] == 5
    assert forward.next_deadline(events).first()[0] == day(7)
    assert [r["gw"] for r in forward.missing_periods(events, make_fact(spark, [dict(gw=5)])).collect()] == [1]
    fixtures = spark.createDataFrame(
        [(1, day(1), False, None), (2, day(1), False, True), (3, day(2), False, None), (None, day(1), False, None)],
        "event bigint, kickoff_time timestamp, finished boolean, finished_provisional boolean",
    )
    assert [r[0] for r in forward.in_live_window(fixtures, F.lit(day(1))).collect()] == [1]


def test_freeze_audits(spark):
    log = spark.createDataFrame(
        [(1, day(1), day(2)), (2, day(1), day(2)), (2, day(1), day(2)), (3, day(3), day(2))], "gw bigint, written_at timestamp, deadline timestamp"
    )
    assert as_dict(val.immutability_audit(log, ["gw"]), "gw", "verdict") == {1: "ok", 2: "rewritten", 3: "late"}
    hours = lambda h: spark.createDataFrame([(day(2).replace(hour=0), day(2))], "x timestamp, deadline timestamp").withColumn(
        "written_at", F.col("deadline") - F.expr(f"INTERVAL {h} HOURS"))
    status = lambda h: val.freeze_window_status(hours(h)).first()["freeze_status"]
    assert [status(h) for h in (7, 6, 1, 0)] == ["early", "open", "open", "late"]
