import itertools
import random
from datetime import datetime, timedelta

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from touchline.functions import market
from touchline.operators import squad, swaps

T0 = datetime(2025, 9, 1)
PICKS = (
    "entry bigint, element_id bigint, slot bigint, multiplier bigint, is_captain boolean, is_vice_captain boolean, purchase_price bigint, selling_price bigint"
)
TRANSFERS = "entry bigint, element_in bigint, element_in_cost bigint, element_out bigint, element_out_cost bigint, event bigint, transfer_time timestamp, seq bigint"
SHAPE = ["GK"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3


def picks(spark, price=50):
    return spark.createDataFrame(
        [(1, e, e, 2 if e == 1 else int(e <= 11), e == 1, e == 2, price, price) for e in range(1, 16)], PICKS
    )


def moves(spark, *rows):
    """(out, in, in_cost, out_cost, hours, event)"""
    return spark.createDataFrame(
        [(1, i, ic, o, oc, ev, T0 + timedelta(hours=h), n) for n, (o, i, ic, oc, h, ev) in enumerate(rows)], TRANSFERS
    )


def replay(spark, log, hours=100, prices=None, start=0):
    at = lambda h: F.lit(T0 + timedelta(hours=h))
    return squad.squad_state(picks(spark), log, at(start), at(hours), prices)


def test_resale_price(spark):
    got = spark.createDataFrame([(50, 45), (50, 50), (50, 51), (50, 55)], "b bigint, n bigint").select(market.resale_price(F.col("b"), F.col("n")))
    assert [r[0] for r in got.collect()] == [45, 50, 50, 52]


def test_bought_player_takes_place_captaincy_and_price(spark):
    got = {r["element_id"]: r for r in replay(spark, moves(spark, (1, 99, 60, 55, 1, 2))).collect()}
    assert len(got) == 15 and 1 not in got
    assert (got[99]["slot"], got[99]["is_captain"], got[99]["multiplier"], got[99]["selling_price"]) == (1, True, 2, 60)


def test_chains_within_and_across_rounds(spark):
    log = moves(spark, (3, 90, 51, 50, 1, 2), (90, 91, 52, 50, 2, 2), (91, 3, 53, 50, 3, 3), (4, 91, 54, 50, 4, 3), (3, 92, 55, 50, 5, 4))
    got = as_dict(replay(spark, log), "slot", "element_id")
    assert got[3] == 92 and got[4] == 91 and sorted(got.values()) == sorted([1, 2, 92, 91, *range(5, 16)])


def test_only_the_window_counts_and_the_bank_follows(spark):
    log = moves(spark, (1, 90, 60, 55, 0, 1), (2, 91, 60, 52, 5, 2), (3, 92, 60, 50, 50, 3))
    got = as_dict(replay(spark, log, hours=10), "slot", "element_id")
    assert (got[1], got[2], got[3]) == (1, 91, 3)
    banks = spark.createDataFrame([(1, 20)], "entry bigint, bank bigint")
    after = squad.bank_after(banks, log, F.lit(T0), F.lit(T0 + timedelta(hours=10))).first()
    assert after["bank"] == 12


def test_unknown_sale_fails_and_is_reported(spark):
    log = moves(spark, (77, 90, 60, 55, 1, 2), (5, 91, 50, 50, 2, 2), (91, 5, 50, 50, 3, 3), (91, 6, 50, 50, 4, 4))
    with pytest.raises(Exception, match="outside the squad"):
        replay(spark, log).collect()
    assert sorted(r["element_id"] for r in squad.validate_log(picks(spark), log).collect()) == [77, 91]


def test_prices_refresh_only_where_known(spark):
    prices = spark.createDataFrame([(1, 57), (2, 40)], "element_id bigint, now_cost bigint")
    got = as_dict(replay(spark, moves(spark), prices=prices), "element_id", "selling_price")
    assert (got[1], got[2], got[3]) == (53, 40, 50)
    unpriced = picks(spark, None)
    at = F.lit(T0)
    with pytest.raises(Exception, match="no price for element"):
        squad.squad_state(unpriced, moves(spark), at, at, prices).collect()


@pytest.mark.parametrize(
    "made, chips, available, hits",
    [
        ({}, [], [1, 2, 3, 4, 5, 5, 5], [0] * 7),
        ({2: 3}, [], [1, 1, 2, 3, 4, 5, 5], [2, 0, 0, 0, 0, 0, 0]),
        ({3: 6}, [3], [1, 2, 3, 4, 5, 5, 5], [0] * 7),
        ({3: 1}, [], [1, 2, 2, 3, 4, 5, 5], [0] * 7),
    ],
)
def test_free_transfers(spark, made, chips, available, hits):
    log = [(1, ev) for ev, n in made.items() for _ in range(n)]
    transfers = spark.createDataFrame(log, "entry bigint, event bigint")
    used = spark.createDataFrame([(1, e, "wildcard") for e in chips] + [(1, 4, "bboost")], "entry bigint, event bigint, name string")
    entries = spark.createDataFrame([(1,)], "entry bigint")
    got = squad.free_transfers(entries, squad.activity_per_gw(transfers, used), 8).orderBy("event").collect()
    assert [r["available_before"] for r in got] == available and [r["hit_count"] for r in got] == hits


def test_free_transfers_of_many_entries_match_a_loop(spark):
    rng = random.Random(8)
    log = [(e, rng.randint(1, 12)) for e in range(1, 60) for _ in range(rng.randint(0, 25))] + [(None, 3), (99, 3)]
    chips = [(e, rng.randint(2, 10), "freehit") for e in range(1, 60, 4)]
    entries = spark.createDataFrame([(e,) for e in [*range(1, 60), 5, None]], "entry bigint")
    activity = squad.activity_per_gw(
        spark.createDataFrame(log, "entry bigint, event bigint"), spark.createDataFrame(chips, "entry bigint, event bigint, name string")
    )
    got = {(r.entry, r.event): (r.available_before, r.used, r.hit_count) for r in squad.free_transfers(entries, activity, 10, cap=4).collect()}
    expected = {}
    for e in [*range(1, 60), None]:
        have = 1
        for g in range(2, 11):
            made = 0 if e is None or (e, g, "freehit") in chips else log.count((e, g))
            expected[e, g] = (have, made, max(made - have, 0))
            have = min(4, max(have - made, 0) + 1)
    assert got == expected
    assert squad.free_transfers(entries, activity, 1).count() == 0
    assert squad.free_transfers(entries.limit(0), activity, 10).count() == 0


def universe(seed, extra=4):
    """15 owned players plus some candidates per position, with random values."""
    rng = random.Random(seed)
    players = [(i + 1, p) for i, p in enumerate(SHAPE)] + [
        (100 + 10 * k + j, p) for k, p in enumerate(("GK", "DEF", "MID", "FWD")) for j in range(extra)
    ]
    pool = {e: (p, f"C{rng.randrange(7) if e > 15 else e % 7}", rng.randrange(40, 70)) for e, p in players}
    points = {(e, g): round(rng.uniform(-1, 9), 1) for e in pool for g in (1, 2)}
    return pool, points, rng.randrange(0, 15), rng.randrange(0, 3)


def xi_value(members, pool, points, gw):
    """Best eleven with the captain doubled, by trying every legal line-up."""
    best = -1e9
    by = {p: [e for e in members if pool[e][0] == p] for p in ("GK", "DEF", "MID", "FWD")}
    for d, m, f in itertools.product(range(3, 6), range(0, 6), range(1, 4)):
        if d + m + f != 10:
            continue
        top = lambda p, n: sorted((points[e, gw] for e in by[p]), reverse=True)[:n]
        chosen = top("GK", 1) + top("DEF", d) + top("MID", m) + top("FWD", f)
        if len(chosen) == 11:
            best = max(best, sum(chosen) + max(chosen))
    return best


@pytest.fixture(scope="module")
def worlds():
    return {seed: universe(seed) for seed in range(8)}


def frames(spark, worlds):
    squads, banks, pool, points = [], [], [], []
    for seed, (players, pts, bank, free) in worlds.items():
        base = seed * 1000
        for e, (p, club, cost) in players.items():
            pool.append((seed, base + e, p, club, cost))
            if e <= 15:
                squads.append((seed, base + e, p, club, cost, cost))
        banks.append((seed, seed, bank, free))
        points += [(base + e, g, v) for (e, g), v in pts.items()]
    return (
        spark.createDataFrame(squads, "entry bigint, element_id bigint, position string, club string, purchase_price bigint, selling_price bigint"),
        spark.createDataFrame(banks, "entry bigint, competition bigint, bank bigint, free_transfers bigint"),
        spark.createDataFrame(pool, "competition bigint, element_id bigint, position string, club string, now_cost bigint"),
        spark.createDataFrame(points, "element_id bigint, gw bigint, points double"),
    )


def test_lineup_is_optimal_and_legal(spark, worlds):
    squads, _, _, points = frames(spark, worlds)
    rows = squad.best_lineup(squads, points, [1, 2]).collect()
    for seed, (pool, pts, _, _) in worlds.items():
        for gw in (1, 2):
            mine = [r for r in rows if r["entry"] == seed and r["gw"] == gw]
            xi = [r for r in mine if r["in_xi"]]
            count = lambda p: sum(r["position"] == p for r in xi)
            assert len(xi) == 11 and count("GK") == 1 and count("DEF") >= 3 and count("FWD") >= 1
            captain = [r for r in xi if r["is_captain"]]
            assert len(captain) == 1 and sum(r["is_vice_captain"] for r in xi) == 1
            value = sum(r["points"] for r in xi) + captain[0]["points"]
            assert value == pytest.approx(xi_value(range(1, 16), pool, pts, gw))
            bench = sorted((r for r in mine if not r["in_xi"]), key=lambda r: r["bench_order"])
            assert [r["points"] for r in bench] == sorted((r["points"] for r in bench), reverse=True)


def brute_swap(pool, pts, bank, free):
    mine = list(range(1, 16))
    value = lambda members: sum(xi_value(members, pool, pts, g) for g in (1, 2))
    legal = lambda members: max(sum(pool[e][1] == c for e in members) for c in {pool[e][1] for e in members}) <= 3
    best = (round(value(mine) + 1e-9, 6) if legal(mine) else -1e9, None, None)
    for out in mine:
        for new in pool:
            if new in mine or pool[new][0] != pool[out][0] or pool[new][2] > bank + pool[out][2]:
                continue
            squad_after = [e for e in mine if e != out] + [new]
            if legal(squad_after):
                got = round(value(squad_after) - 4 * max(0, 1 - free) - 1e-4 + 1e-9, 6)
                if got > best[0]:
                    best = (got, out, new)
    return best


def test_best_swap_matches_brute_force(spark, worlds):
    squads, banks, pool, points = frames(spark, worlds)
    rows = {r["entry"]: r for r in swaps.best_single_swap(squads, banks, pool, points, [1, 2]).collect()}
    assert len(rows) == len(worlds)
    for seed, world in worlds.items():
        objective, out, new = brute_swap(*world)
        got = rows[seed]
        assert got["objective"] == pytest.approx(objective)
        assert (got["element_out"], got["element_in"]) == (out and seed * 1000 + out, new and seed * 1000 + new)


def test_moves_give_a_legal_next_squad(spark, worlds):
    squads, banks, pool, points = frames(spark, worlds)
    best = swaps.best_single_swap(squads, banks, pool, points, [1, 2])
    after = squad.apply_moves(squads, best, pool, points, 1)
    legal = squad.legality(after).collect()
    assert len(legal) == len(worlds)
    for r in legal:
        assert (r["n_gk"], r["n_def"], r["n_mid"], r["n_fwd"]) == (2, 5, 5, 3)
    for seed in worlds:
        slots = sorted(r["slot"] for r in after.filter(F.col("entry") == seed).collect())
        assert slots == list(range(1, 16))
    assert after.filter("multiplier = 2").count() == len(worlds)


def test_frontier_keeps_every_possible_winner(spark):
    rng = random.Random(1)
    rows = [(1, e, "MID", "C", rng.randrange(40, 60), [rng.uniform(0, 5), rng.uniform(0, 5)]) for e in range(400)]
    df = spark.createDataFrame(rows, "competition bigint, element_id bigint, position string, club string, now_cost bigint, x array<double>")
    got = {r["element_id"] for r in swaps.candidate_frontier(df.repartition(3), ("competition", "position", "club")).collect()}
    beats = lambda d, c: d[1] < c[1] and d[4] <= c[4] and all(a >= b for a, b in zip(d[5], c[5]))
    want = {c[1] for c in rows if sum(beats(d, c) for d in rows) < swaps.KEPT_PER_RANK}
    assert got == want


def test_frontier_refuses_keys_without_club(spark):
    pool = spark.createDataFrame([], "element_id bigint, position string, club string, now_cost bigint, x array<double>")
    with pytest.raises(ValueError, match="club"):
        swaps.candidate_frontier(pool, ("position",))


def test_frontier_keeps_a_club_that_four_of_another_beat(spark):
    rows = [(e, "FWD", "A", 50, [9.0]) for e in range(1, 6)] + [(9, "FWD", "B", 60, [1.0])]
    pool = spark.createDataFrame(rows, "element_id bigint, position string, club string, now_cost bigint, x array<double>")
    assert {r["element_id"] for r in swaps.candidate_frontier(pool, ("position", "club")).collect()} == {1, 2, 3, 4, 9}


def test_pairs_follow_position_and_id(spark):
    t = "entry bigint, element_id bigint, position string"
    outs = spark.createDataFrame([(1, 9, "MID"), (1, 2, "GK"), (1, 7, "MID"), (1, 5, "DEF")], t)
    ins = spark.createDataFrame([(1, 30, "GK"), (1, 21, "MID"), (1, 20, "MID")], t)
    assert as_dict(squad.pair_by_position(outs, ins), "element_out", "element_in") == {7: 20, 9: 21, 2: 30}


def test_template_risk_at_the_threshold(spark):
    sales = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "entry bigint, element_id bigint")
    owned = spark.createDataFrame([(1, 20.0), (2, 19.9)], "element_id bigint, selected_by_percent double")
    assert [r["element_id"] for r in squad.template_risk(sales, owned).collect()] == [1]


def test_lineup_points_double_the_captain_and_skip_the_bench(spark):
    actuals = spark.createDataFrame([(1, e, 10 if e == 1 else 4) for e in range(1, 16) if e != 11], "gw bigint, element_id bigint, total_points bigint")
    got = squad.lineup_points(picks(spark).withColumn("gw", F.lit(1).cast("bigint")), actuals).first()
    assert got["points"] == 20 + 9 * 4


def test_a_round_without_any_record_has_no_points(spark):
    actuals = spark.createDataFrame([(1, 1, 10)], "gw bigint, element_id bigint, total_points bigint")
    rounds = picks(spark).withColumn("gw", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
    assert [r["gw"] for r in squad.lineup_points(rounds, actuals).collect()] == [1]


def test_legality_deals_squads_once_into_partitions_that_stay_apart(spark):
    rows = [(e, 15 * e + i, SHAPE[i], f"C{i}", 50) for e in range(40) for i in range(15)]
    squads = spark.createDataFrame(rows, "entry bigint, element_id bigint, position string, club string, selling_price bigint")
    verdict = squad.legality(squads)
    plan = verdict._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entry") == plan.count("REPARTITION_BY_NUM") >= 1
    assert verdict.filter("is_legal AND n_distinct = 15").count() == 40


def test_line_ups_are_not_gathered_in_few_tasks(spark):
    rows = [(e, i, SHAPE[i], 50) for e in range(40) for i in range(15)]
    squads = spark.createDataFrame(rows, "entry bigint, element_id bigint, position string, selling_price bigint")
    projections = spark.createDataFrame([(i, 1, float(i)) for i in range(15)], "element_id bigint, gw bigint, points double")
    laid = squad.best_lineup(squads, projections, [1])
    assert laid.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and laid.filter("in_xi").count() == 40 * 11


def test_picks_are_made_in_all_partitions(spark, tmp_path):
    """One small file of entries is read by one task; its squads are made in all."""
    from catalog.tables import Tables

    spark.range(1, 60).selectExpr("id c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, 400).selectExpr("id p_partkey", "'B' p_brand", "CAST(id % 50 AS INT) p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    picks = Tables(spark, str(tmp_path)).picks
    assert picks.count() == 59 * 15 and picks.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sold_players_meet_candidates_in_partitions_that_stay_apart(spark):
    rows = [(1, i, SHAPE[i], f"C{i}", 50) for i in range(15)]
    squads = spark.createDataFrame(rows, "entry bigint, element_id bigint, position string, club string, selling_price bigint")
    banks = spark.createDataFrame([(1, 0, 5, 1)], "entry bigint, competition bigint, bank bigint, free_transfers bigint")
    pool = spark.createDataFrame([(0, 99, "MID", "C99", 50)], "competition bigint, element_id bigint, position string, club string, now_cost bigint")
    projections = spark.createDataFrame([(99, 1, 9.0)], "element_id bigint, gw bigint, points double")
    best = swaps.best_single_swap(squads, banks, pool, projections, [1])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(competition" in plan and "position" in plan.split("REPARTITION_BY_NUM")[0].rsplit("hashpartitioning", 1)[1]
    assert best.first()["element_in"] == 99


def test_squads_are_valued_once_and_entries_without_a_candidate_hold(spark):
    rows = [(e, i, SHAPE[i], f"C{i}", 50) for e in (1, 2, 3) for i in range(15)] + [(3, None, "MID", "C1", 50)]
    squads = spark.createDataFrame(rows, "entry bigint, element_id bigint, position string, club string, selling_price bigint")
    banks = spark.createDataFrame([(1, 0, 5, 1), (2, 7, 5, 1), (3, None, 6, 0)], "entry bigint, competition bigint, bank bigint, free_transfers bigint")
    pool = spark.createDataFrame([(0, 99, "MID", "C99", 50)], "competition bigint, element_id bigint, position string, club string, now_cost bigint")
    projections = spark.createDataFrame([(99, 1, 9.0), (0, 1, 2.0)], "element_id bigint, gw bigint, points double")
    best = swaps.best_single_swap(squads, banks, pool, projections, [1])
    assert best._jdf.queryExecution().optimizedPlan().toString().count("_swap_values") == 1
    got = {r["entry"]: (r["element_in"], r["hold"], r["objective"], r["hits"], r["bank_after"]) for r in best.collect()}
    assert got == {1: (99, 4.0, 19.9999, 0, 5), 2: (None, 4.0, 4.0, 0, 5), 3: (None, 4.0, 4.0, 0, 6)}
