"""Squads: free transfers, replay of transfers, line-ups, legality, moves.

All operators work on many entries at once. A squad has 15 rows, so arrays
over one squad are short; transfer logs are never collected whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.market import resale_price
from touchline.operators.segments import DEFAULT_SEGMENT, with_previous
from touchline.rules import MAX_PER_CLUB, SQUAD_SHAPE, UNLIMITED_CHIPS, XI_MINIMUM, XI_SIZE
from touchline.sources.store import deal

# ------------------------------------------------------------ free transfers


def activity_per_gw(transfers: DataFrame, chips: DataFrame) -> DataFrame:
    """Transfers made and unlimited-chip flag per (entry, event)."""
    made = transfers.select("entry", "event", F.lit(1).alias("_made"), F.lit(False).alias("_chip"))
    used = chips.filter(F.col("name").isin(*UNLIMITED_CHIPS)).select(
        "entry", "event", F.lit(0).alias("_made"), F.lit(True).alias("_chip")
    )
    return made.unionByName(used).groupBy("entry", "event").agg(
        F.sum("_made").alias("made"), F.max("_chip").alias("is_chip_week")
    )


def free_transfers(entries: DataFrame, activity: DataFrame, through: int, start: int = 2, cap: int = 5) -> DataFrame:
    """Per entry and round: transfers available before it, used, and hits.

    What is left after a round, plus one, up to the cap, is there before the next.
    A season's activity of an entry is one short list; the rounds are stepped
    through once for a whole batch of entries, as columns. Rounds without activity
    count as zero transfers, several activity rows of a round add up, and a null
    entry has no activity. `through` before `start` gives no rows.
    """
    rounds = max(0, through - start + 1)
    move = F.struct(
        (F.col("event") - start).cast("int").alias("at"), F.coalesce("made", F.lit(0)).cast("bigint").alias("made"),
        F.coalesce("is_chip_week", F.lit(False)).alias("chip"),
    )
    log = activity.filter(F.col("event").between(start, through)).groupBy("entry").agg(F.collect_list(move).alias("log"))
    none = F.expr("cast(array() as array<struct<at:int,made:bigint,chip:boolean>>)")
    joined = entries.select("entry").distinct().join(log, "entry", "left").select("entry", F.coalesce("log", none).alias("log"))

    def replay(batches):
        for batch in batches:
            n, moves = batch.num_rows, batch.column("log").flatten()
            who = np.repeat(np.arange(n), batch.column("log").value_lengths().to_numpy(zero_copy_only=False))
            at = moves.field("at").to_numpy(zero_copy_only=False)
            made, chip = np.zeros((n, rounds), np.int64), np.zeros((n, rounds), bool)
            np.add.at(made, (who, at), moves.field("made").to_numpy(zero_copy_only=False))
            np.logical_or.at(chip, (who, at), moves.field("chip").to_numpy(zero_copy_only=False))
            made[chip] = 0
            before = np.ones((n, rounds + 1), np.int64)
            for g in range(rounds):
                before[:, g + 1] = np.minimum(cap, np.maximum(before[:, g] - made[:, g], 0) + 1)
            before = before[:, :rounds]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("entry").take(pa.array(np.repeat(np.arange(n), rounds))), pa.array(np.tile(np.arange(start, start + rounds), n)),
                    pa.array(before.ravel()), pa.array(made.ravel()), pa.array(np.maximum(made - before, 0).ravel()),
                ],
                ["entry", "event", "available_before", "used", "hit_count"],
            )

    entry = joined.schema["entry"].dataType.simpleString()
    return joined.mapInArrow(replay, f"entry {entry}, event bigint, available_before bigint, used bigint, hit_count bigint")


# ------------------------------------------------------------- reconstruction

_CHAIN = "map<bigint,struct<root:bigint,price:bigint>>"


def _empty_chain() -> Column:
    return F.expr(f"cast(map() as {_CHAIN})")


def _chain_of_chunk(log: Column) -> Column:
    """One chunk of transfers as: current element -> (element it descends from, price)."""

    def step(chain: Column, move: Column) -> Column:
        known = F.try_element_at(chain, move["element_out"])
        holder = F.struct(
            F.coalesce(known["root"], move["element_out"]).alias("root"), move["element_in_cost"].alias("price")
        )
        kept = F.map_filter(chain, lambda k, _: (k != move["element_out"]) & (k != move["element_in"]))
        return F.map_concat(kept, F.create_map(move["element_in"], holder))

    return F.aggregate(log, _empty_chain(), step)


def _join_chains(chunks: Column) -> Column:
    """Compose the chains of consecutive chunks."""

    def step(chain: Column, chunk: Column) -> Column:
        later = F.map_from_entries(chunk["links"])
        sold = F.transform(F.map_values(later), lambda v: v["root"])
        kept = F.map_filter(chain, lambda k, _: ~F.array_contains(sold, k) & ~F.map_contains_key(later, k))
        moved = F.transform_values(
            later,
            lambda _, v: F.struct(
                F.coalesce(F.try_element_at(chain, v["root"])["root"], v["root"]).alias("root"), v["price"].alias("price")
            ),
        )
        return F.map_concat(kept, moved)

    return F.aggregate(chunks, _empty_chain(), step)


def replay_chains(
    transfers: DataFrame, order: tuple[str, ...] = ("transfer_time", "seq"), chunk: tuple[str, ...] = ("event",)
) -> DataFrame:
    """Who holds whose place after all transfers: (entry, root, element_id, price).

    Replacing players composes: each chunk (a round) of an entry's log is
    folded on its own, in parallel, to at most one link per squad place, and
    only these links are put in sequence. `chunk` may name finer columns for
    an entry with very many transfers in a round.
    """
    move = F.struct(*order, *[F.col(c).cast("bigint").alias(c) for c in ("element_out", "element_in", "element_in_cost")])
    per_chunk = transfers.groupBy("entry", *chunk).agg(_chain_of_chunk(F.array_sort(F.collect_list(move))).alias("chain"))
    # Maps have no order; their entries do, so chunks sort by the chunk columns.
    links = per_chunk.groupBy("entry").agg(
        _join_chains(F.array_sort(F.collect_list(F.struct(*chunk, F.map_entries("chain").alias("links"))))).alias("chain")
    )
    spread = links.select("entry", F.explode("chain").alias("element_id", "_v"))
    return spread.select("entry", F.col("_v.root").alias("root"), "element_id", F.col("_v.price").alias("price"))


def squad_state(
    picks: DataFrame,
    transfers: DataFrame,
    snapshot_ts: Column,
    as_of: Column,
    prices: DataFrame | None = None,
    order: tuple[str, ...] = ("transfer_time", "seq"),
    chunk: tuple[str, ...] = ("event",),
) -> DataFrame:
    """The 15 players per entry: picks plus the transfers in (snapshot_ts, as_of].

    A bought player takes over place and captaincy of the sold one. With
    `prices` every held player's resale price is refreshed. A sale of a player
    who is not in the squad, or a pick without any price, fails the job.
    """
    window = transfers.filter((F.col(order[0]) > snapshot_ts) & (F.col(order[0]) <= as_of))
    chains = replay_chains(window, order, chunk).withColumnRenamed("element_id", "_new")
    held = picks.withColumnRenamed("element_id", "root").join(chains, ["entry", "root"], "full")
    sold_unknown = F.raise_error(F.concat(F.lit("transfer sells an element outside the squad: "), F.col("root").cast("string")))
    element = F.when(F.col("slot").isNull(), sold_unknown.cast("bigint")).otherwise(F.coalesce("_new", "root"))
    bought = F.col("_new").isNotNull()
    state = held.select(
        "entry", element.alias("element_id"), "slot", "multiplier", "is_captain", "is_vice_captain",
        F.when(bought, F.col("price")).otherwise(F.col("purchase_price")).alias("purchase_price"),
        F.when(bought, F.col("price")).otherwise(F.col("selling_price")).alias("selling_price"),
    )
    if prices is not None:
        state = refresh_prices(state, prices)
    no_price = F.raise_error(F.concat(F.lit("no price for element "), F.col("element_id").cast("string"))).cast("bigint")
    return state.withColumns({c: F.coalesce(F.col(c), no_price) for c in ("purchase_price", "selling_price")})


def refresh_prices(squads: DataFrame, prices: DataFrame) -> DataFrame:
    """Resale prices from current prices; unknown prices stay as they are.

    A pick that came without a price is worth its current price.
    """
    joined = squads.join(prices.select("element_id", F.col("now_cost").alias("_now")), "element_id", "left")
    unpriced = F.col("purchase_price").isNull() | F.col("selling_price").isNull()
    bought = F.when(unpriced, F.col("_now")).otherwise(F.col("purchase_price"))
    sold = F.when(F.col("_now").isNull(), F.col("selling_price")).otherwise(resale_price(bought, F.col("_now")))
    return joined.select(
        *[bought.alias(c) if c == "purchase_price" else sold.alias(c) if c == "selling_price" else F.col(c) for c in squads.columns]
    )


def bank_after(banks: DataFrame, transfers: DataFrame, snapshot_ts: Column, as_of: Column, time: str = "transfer_time") -> DataFrame:
    """Money left per entry after the transfers in (snapshot_ts, as_of]."""
    flow = (
        transfers.filter((F.col(time) > snapshot_ts) & (F.col(time) <= as_of))
        .groupBy("entry")
        .agg(F.sum(F.col("element_out_cost") - F.col("element_in_cost")).alias("_flow"))
    )
    return banks.join(flow, "entry", "left").withColumn("bank", F.col("bank") + F.coalesce("_flow", F.lit(0))).drop("_flow")


def validate_log(
    picks: DataFrame, transfers: DataFrame, order: tuple[str, ...] = ("transfer_time", "seq"), segment: str = DEFAULT_SEGMENT
) -> DataFrame:
    """Sales of a player the entry did not own at that moment."""
    sides = F.explode(
        F.array(
            F.struct(F.lit(0).alias("step"), F.lit("out").alias("action"), F.col("element_out").alias("element_id")),
            F.struct(F.lit(1).alias("step"), F.lit("in").alias("action"), F.col("element_in").alias("element_id")),
        )
    )
    log = transfers.select("entry", *order, sides.alias("_a")).select("entry", *order, "_a.*")
    seen = with_previous(log, ["entry", "element_id"], [*order, "step"], ["action"], segment=segment)
    sales = seen.filter(F.col("action") == "out").join(
        picks.select("entry", "element_id", F.lit(True).alias("_picked")), ["entry", "element_id"], "left"
    )
    owned = F.when(F.col("_previous").isNull(), F.coalesce("_picked", F.lit(False))).otherwise(F.col("_previous.action") == "in")
    return sales.filter(~owned).select("entry", *order, "element_id")


# ------------------------------------------------------------------- line-up


def with_projections(squads: DataFrame, projections: DataFrame, horizon: list[int]) -> DataFrame:
    """Each squad row once per round of the horizon; no projection means 0."""
    rounds = F.explode(F.array(*[F.lit(g).cast("bigint") for g in horizon]))
    spread = squads.withColumn("gw", rounds)
    points = projections.filter(F.col("gw").isin(horizon)).select("element_id", "gw", F.col("points").cast("double").alias("_p"))
    return spread.join(points, ["element_id", "gw"], "left").withColumn("points", F.coalesce("_p", F.lit(0.0))).drop("_p")


def best_lineup(squads: DataFrame, projections: DataFrame, horizon: list[int]) -> DataFrame:
    """The best eleven of each squad and round, its captain and bench order.

    Exact for a legal squad: the best keeper, the three best defenders and the
    best forward must start; of the other outfield players the best fill up.
    """
    # One shuffle by (entry, gw) serves all windows below.
    rows = deal(with_projections(squads, projections, horizon), "entry", "gw")
    best = [F.col("points").desc(), F.col("element_id")]
    squad = Window.partitionBy("entry", "gw")
    rank = F.row_number().over(Window.partitionBy("entry", "gw", "position").orderBy(*best))
    must = F.lit(False)
    for position, least in XI_MINIMUM.items():
        must = must | ((F.col("position") == position) & (F.col("_rank") <= least))
    free = XI_SIZE - sum(XI_MINIMUM.values())
    rest = (~F.col("_must")) & (F.col("position") != "GK")
    fill = F.row_number().over(Window.partitionBy("entry", "gw", rest).orderBy(*best))
    chosen = (
        rows.withColumn("_rank", rank)
        .withColumn("_must", must)
        .withColumn("in_xi", F.col("_must") | (rest & (fill <= free)))
    )
    xi = F.col("in_xi")
    captain = F.min_by("element_id", F.struct((-F.col("points")).alias("p"), "element_id")).over(squad)
    led = chosen.withColumn("is_captain", F.col("element_id") == captain)
    vice = F.min(F.when(xi & ~F.col("is_captain"), F.struct(F.col("position") != "GK", "element_id"))).over(squad)
    bench = F.row_number().over(Window.partitionBy("entry", "gw", "in_xi").orderBy(*best))
    return led.withColumns(
        {
            "is_vice_captain": F.coalesce(F.col("element_id") == vice["element_id"], F.lit(False)),
            "bench_order": F.when(~xi, bench.cast("bigint")),
        }
    ).drop("_rank", "_must")


def lineup_points(squads: DataFrame, actuals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Points of the players with a multiplier; a player without a record has 0.

    A round that nobody has a record of is not over: it has no points and no row.
    """
    keys = keys or ["entry"]
    playing = squads.filter(F.col("multiplier") > 0)
    if "gw" in squads.columns:
        playing = playing.join(actuals.select("gw").distinct(), "gw", "left_semi")
    joined = playing.join(actuals.select("gw", "element_id", F.col("total_points").alias("_p")), _shared(playing, "gw") + ["element_id"], "left")
    return joined.groupBy(*keys, *[c for c in ("gw",) if c not in keys and c in joined.columns]).agg(
        F.sum(F.coalesce("_p", F.lit(0)) * F.col("multiplier")).alias("points")
    )


def _shared(df: DataFrame, *columns: str) -> list[str]:
    return [c for c in columns if c in df.columns]


def legality(squads: DataFrame, banks: DataFrame | None = None) -> DataFrame:
    """One row per entry: squad shape, club limit and money, and a verdict.

    Squads are dealt by entry once, which serves all groups below.
    """
    squads = deal(squads, "entry")
    wanted = {p: F.count_if(F.col("position") == p).alias(f"n_{p.lower()}") for p in SQUAD_SHAPE}
    clubs = squads.groupBy("entry", "club").agg(F.count(F.lit(1)).alias("_n")).groupBy("entry").agg(F.max("_n").alias("max_per_club"))
    shape = squads.groupBy("entry").agg(
        F.count(F.lit(1)).alias("n_players"), F.count_distinct("element_id").alias("n_distinct"), *wanted.values(),
        F.sum("selling_price").alias("squad_value"),
    )
    joined = shape.join(clubs, "entry")
    ok = (F.col("n_players") == sum(SQUAD_SHAPE.values())) & (F.col("n_distinct") == F.col("n_players"))
    for position, n in SQUAD_SHAPE.items():
        ok = ok & (F.col(f"n_{position.lower()}") == n)
    ok = ok & (F.col("max_per_club") <= MAX_PER_CLUB)
    if banks is not None:
        joined = joined.join(banks.select("entry", "bank"), "entry", "left")
        ok = ok & (F.col("bank") >= 0)
    return joined.withColumn("is_legal", F.coalesce(ok, F.lit(False)))


# --------------------------------------------------------------------- moves


def squad_diff(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("entry", "element_id")) -> DataFrame:
    """Who left and who came, as rows with `direction` out or in."""
    k = list(keys)
    out = before.select(*k).join(after.select(*k), k, "left_anti").withColumn("direction", F.lit("out"))
    came = after.select(*k).join(before.select(*k), k, "left_anti").withColumn("direction", F.lit("in"))
    return out.unionByName(came)


def pair_by_position(outs: DataFrame, ins: DataFrame, keys: tuple[str, ...] = ("entry",)) -> DataFrame:
    """k-th sold with k-th bought of a position, by id; a surplus is left out.

    A position holds at most five squad places, so the windows are tiny.
    """
    k = [*keys, "position"]
    order = Window.partitionBy(*k).orderBy("element_id")
    ranked = lambda df, name: df.select(*k, F.col("element_id").alias(name), F.row_number().over(order).alias("_k"))
    return ranked(outs, "element_out").join(ranked(ins, "element_in"), [*k, "_k"]).drop("_k")


def template_risk(sales: DataFrame, ownership: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Sales of widely owned players; unknown ownership counts as none."""
    owned = ownership.select("element_id", F.col("selected_by_percent").alias("_own"))
    joined = sales.join(owned, "element_id", "left").withColumn("selected_by_percent", F.coalesce("_own", F.lit(0.0))).drop("_own")
    return joined.filter(F.col("selected_by_percent") >= threshold)


def apply_moves(squads: DataFrame, moves: DataFrame, pool: DataFrame, projections: DataFrame, next_gw: int) -> DataFrame:
    """Squads after (at most one) recommended swap per entry, laid out for `next_gw`.

    The bought player costs today's price; kept players' resale prices are
    refreshed; places 1-11 go to the best eleven (keeper first, then by id),
    12-15 to the bench in order. No automatic substitutions.
    """
    swap = moves.filter(F.col("element_in").isNotNull()).select("entry", "element_out", "element_in")
    joined = squads.join(swap, "entry", "left")
    sold = F.coalesce(F.col("element_id") == F.col("element_out"), F.lit(False))
    blank = lambda c: F.when(sold, F.lit(None).cast("bigint")).otherwise(F.col(c))
    moved = joined.select(
        "entry", F.when(sold, F.col("element_in")).otherwise(F.col("element_id")).alias("element_id"),
        blank("purchase_price").alias("purchase_price"), blank("selling_price").alias("selling_price"),
    )
    priced = refresh_prices(moved, pool).join(pool.select("element_id", "position", "club"), "element_id")
    laid = best_lineup(priced, projections, [next_gw])
    place = Window.partitionBy("entry", "in_xi").orderBy(F.col("position") != "GK", "element_id")
    slot = F.when(F.col("in_xi"), F.row_number().over(place)).otherwise(XI_SIZE + F.col("bench_order")).cast("bigint")
    multiplier = F.when(~F.col("in_xi"), 0).when(F.col("is_captain"), 2).otherwise(1).cast("bigint")
    return laid.select(
        "entry", "element_id", "position", "club", "purchase_price", "selling_price", slot.alias("slot"), multiplier.alias("multiplier"),
        "is_captain", "is_vice_captain",
    )
