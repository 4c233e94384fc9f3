"""The best single transfer per entry over a horizon, exactly.

For one entry and one sold player the points of the best eleven depend on the
bought player only through his own projection x of a round: he stays out (A),
or he starts next to the best ten others (B + x), where the captain doubles
the larger of their best (M) and x. So A, B and M are computed once per sold
player and a candidate costs a few additions. Candidates that others of the
same club and position beat in price and in every round cannot win and are
dropped first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.rules import MAX_PER_CLUB, POSITIONS, XI_MINIMUM, XI_SIZE
from touchline.sources.store import deal

TRANSFER_EPSILON = 1e-4
KEPT_PER_RANK = MAX_PER_CLUB + 1  # at most three of a club are owned already


def horizon_points(projections: DataFrame, horizon: list[int]) -> DataFrame:
    """Projections of a horizon as one array per element, 0 where missing."""
    per_round = [F.coalesce(F.max(F.when(F.col("gw") == g, F.col("points").cast("double"))), F.lit(0.0)) for g in horizon]
    return projections.filter(F.col("gw").isin(horizon)).groupBy("element_id").agg(F.array(*per_round).alias("x"))


def undominated(frame: pd.DataFrame, keep: int = KEPT_PER_RANK) -> pd.DataFrame:
    """Rows that fewer than `keep` rows of a lower id match or beat in price and all rounds.

    Asking for a lower id keeps the rule "equal gains go to the lower id" exact.
    """
    if len(frame) <= keep:
        return frame
    scores = np.column_stack([frame["now_cost"].to_numpy(float) * -1.0, np.vstack(frame["x"].to_numpy())])
    ids = frame["element_id"].to_numpy()
    # Strongest first: a row can only be beaten by rows before it.
    order = np.lexsort((ids, -scores.sum(axis=1)))
    kept: list[int] = []
    for i in order:
        if kept:
            above = scores[kept] >= scores[i]
            beaten = above.all(axis=1) & (ids[kept] < ids[i])
            if int(beaten.sum()) >= keep:
                continue
        kept.append(i)
    return frame.iloc[sorted(kept)]


def _reduce_groups(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """`undominated` per group; groups too small to lose a row pass as they are."""
    large = frame.groupby(keys, sort=False)["element_id"].transform("size") > KEPT_PER_RANK
    parts = [undominated(part) for _, part in frame[large].groupby(keys, sort=False)]
    return pd.concat([frame[~large], *parts])


def candidate_frontier(pool: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Candidates that can be part of a best swap, per group of `keys`.

    `keys` must name position and club. Among players of one club a candidate
    beaten by four cannot win, as a squad owns three of them at most and may buy
    the fourth wherever it may buy him; across clubs that does not hold.

    Each partition first reduces its own batches without a shuffle. What is
    left is sorted by group and reduced as a stream: a task holds one batch and
    the surviving rows of one group.
    """
    if missing := {"position", "club"} - set(keys):
        raise ValueError(f"the frontier is exact inside a club and position only; keys lack {sorted(missing)}")
    k = list(keys)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _reduce_groups(batch, k)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch])
            open_group = (rows[k] == rows[k].iloc[-1]).all(axis=1)
            yield _reduce_groups(rows[~open_group], k)
            held = undominated(rows[open_group])
        if held is not None:
            yield held

    reduced = pool.mapInPandas(local, pool.schema)
    return reduced.repartition(*k).sortWithinPartitions(*k).mapInPandas(merged, pool.schema)


def best_eleven(codes: np.ndarray, points: np.ndarray, need: np.ndarray, total: int, out: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum and maximum of the best `total` players of each row's squad.

    `codes` and `points` are (squads, players), best points first; `need` is
    (squads, positions). The player in column `out` is not available.
    """
    free = np.ones(codes.shape, bool)
    if out is not None:
        free[np.arange(len(codes)), out] = False
    forced = np.zeros(codes.shape, bool)
    for code in range(len(POSITIONS)):
        member = free & (codes == code)
        forced |= member & (np.cumsum(member, axis=1) <= need[:, [code]])
    spare = free & ~forced & (codes > 0)
    fill = spare & (np.cumsum(spare, axis=1) <= total - need.sum(axis=1, keepdims=True))
    chosen = forced | fill
    return np.where(chosen, points, 0.0).sum(axis=1), np.where(chosen, points, -np.inf).max(axis=1)


def _nested(values: np.ndarray) -> pa.ListArray:
    """A (squads, players, rounds) array as lists of lists."""
    n, size, rounds = values.shape
    inner = pa.ListArray.from_arrays(np.arange(n * size + 1, dtype=np.int32) * rounds, pa.array(values.ravel()))
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * size, inner)


def _swap_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squads with the value of holding and, per player, A, B and M of each round, instead of `codes` and `xs`."""
    least = np.array([XI_MINIMUM.get(p, 0) for p in POSITIONS])
    for batch in batches:
        sizes = batch.column("codes").value_lengths().to_numpy(zero_copy_only=False)
        # Squads of one size share one array; a legal squad always has 15.
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            n = part.num_rows
            codes = part.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(n, size).astype(int)
            points = part.column("xs").flatten().flatten().to_numpy(zero_copy_only=False).reshape(n, size, -1)
            rounds = points.shape[2]
            full = np.broadcast_to(least, (n, len(POSITIONS)))
            hold = np.zeros(n)
            a, b, m = (np.zeros((n, size, rounds)) for _ in range(3))
            rows = np.arange(n)
            for r in range(rounds):
                order = np.argsort(-points[:, :, r], axis=1, kind="stable")
                place = np.argsort(order, axis=1)
                c, p = np.take_along_axis(codes, order, 1), np.take_along_axis(points[:, :, r], order, 1)
                total, top = best_eleven(c, p, full, XI_SIZE)
                hold += total + top
                for j in range(size):
                    at = place[:, j]
                    total, top = best_eleven(c, p, full, XI_SIZE, at)
                    a[:, j, r] = total + top
                    less = full.copy()
                    less[rows, codes[:, j]] = np.maximum(less[rows, codes[:, j]] - 1, 0)
                    b[:, j, r], m[:, j, r] = best_eleven(c, p, less, XI_SIZE - 1, at)
            kept = [name for name in part.schema.names if name not in ("codes", "xs")]
            columns = [*(part.column(name) for name in kept), pa.array(hold), _nested(a), _nested(b), _nested(m)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "hold", "a", "b", "m"])


def best_single_swap(
    squads: DataFrame,
    banks: DataFrame,
    pool: DataFrame,
    projections: DataFrame,
    horizon: list[int],
    free: str = "free_transfers",
    hit_cost: int = 4,
    group: tuple[str, ...] = ("competition",),
) -> DataFrame:
    """Per entry the swap with the highest gain, or none when holding is better.

    `squads` has entry, element_id, position, club, selling_price; `banks` has
    entry, the group columns, bank and `free`; `pool` has the group columns,
    element_id, position, club, now_cost. Equal gains go to the lower ids.
    """
    g = list(group)
    rounds = range(len(horizon))
    points = horizon_points(projections, horizon)
    none = F.array(*[F.lit(0.0) for _ in horizon])
    owned = squads.join(points, "element_id", "left").withColumn("x", F.coalesce("x", none))
    code = F.array_position(F.array(*[F.lit(p) for p in POSITIONS]), F.col("position")) - 1
    # 15 players a squad; whatever a sold player needs goes with his squad, so squads are made and valued once
    member = F.struct(F.col("element_id").cast("bigint").alias("element_id"), code.alias("code"), "x", "club", "position", "selling_price")
    teams = owned.groupBy(F.col("entry").cast("bigint").alias("entry")).agg(F.array_sort(F.collect_list(member)).alias("squad"))
    field = lambda name: F.transform("squad", lambda e: e[name])
    per_club = F.transform(
        F.array_distinct(field("club")), lambda c: F.struct(c.alias("club"), F.size(F.filter("squad", lambda e: e["club"] == c)).alias("n"))
    )
    outs = F.transform(
        "squad", lambda e: F.struct(e["element_id"].alias("element_out"), e["club"].alias("club"), e["position"].alias("position"), e["selling_price"].alias("selling_price"))
    )
    entries = teams.join(banks.select("entry", *g, "bank", free), "entry").select(
        "entry", *g, "bank", free, field("element_id").alias("ids"), F.filter(per_club, lambda c: c["n"] >= MAX_PER_CLUB).alias("crowded"),
        outs.alias("outs"), field("code").alias("codes"), field("x").alias("xs"),
    )
    valued = T.StructType([f for f in entries.schema if f.name not in ("codes", "xs")]).add("hold", "double")
    for name in ("a", "b", "m"):
        valued = valued.add(name, T.ArrayType(T.ArrayType(T.DoubleType())))
    values = entries.mapInArrow(_swap_values, valued).select(
        "entry", *g, "bank", free, "ids", "crowded", "hold", F.explode(F.arrays_zip("outs", "a", "b", "m")).alias("_p")
    )
    # The club counts without the sold player: only his own club loses one.
    left = lambda c: c["n"] - (c["club"] == F.col("club")).cast("int")
    ready = (
        values.select("entry", *g, "bank", free, "ids", "crowded", "hold", "_p.outs.*", "_p.a", "_p.b", "_p.m")
        .filter("element_out IS NOT NULL")
        .withColumns(
            {
                "budget": F.col("bank") + F.col("selling_price"),
                "full_clubs": F.transform(F.filter("crowded", lambda c: left(c) >= MAX_PER_CLUB), lambda c: c["club"]),
                "hold_ok": ~F.exists("crowded", lambda c: c["n"] > MAX_PER_CLUB),
                "movable": ~F.exists("crowded", lambda c: left(c) > MAX_PER_CLUB),
            }
        )
        .drop("crowded", "club", "selling_price")
    )
    candidates = candidate_frontier(
        pool.select(*g, "element_id", "position", "club", F.col("now_cost").cast("bigint").alias("now_cost"))
        .join(points, "element_id", "left")
        .withColumn("x", F.coalesce("x", none)),
        (*group, "position", "club"),
    ).select(*[F.col(c).alias(f"_in_{c}") for c in (*g, "position")], F.col("element_id").alias("element_in"), F.col("club").alias("in_club"), "now_cost", "x")
    # A sold player meets all candidates of a position: the partitions stay apart.
    # He stays without any, so that holding needs no second run over the squads.
    fits = (
        F.col("movable") & (F.col("now_cost") <= F.col("budget"))
        & ~F.array_contains("ids", F.col("element_in"))
        & ~F.array_contains("full_clubs", F.col("in_club"))
    )
    for c in (*g, "position"):
        fits = fits & (F.col(c) == F.col(f"_in_{c}"))
    pairs = deal(ready, *g, "position").join(candidates, fits, "left")
    value = F.lit(0.0)
    for r in rounds:
        x = F.col("x")[r]
        value = value + F.greatest(F.col("a")[r], F.col("b")[r] + x + F.greatest(F.col("m")[r], x))
    hits = F.greatest(F.lit(1) - F.col(free), F.lit(0))
    objective = F.round(value - hit_cost * hits - TRANSFER_EPSILON + 1e-9, 6)
    scored = pairs.select(
        "entry", "bank", free, "hold", "hold_ok", "element_out", "element_in", objective.alias("objective"),
        (F.col("budget") - F.col("now_cost")).alias("left"),
    )
    first = F.when(F.col("element_in").isNotNull(), F.struct((-F.col("objective")).alias("o"), "element_out", "element_in"))
    joined = scored.groupBy("entry").agg(
        F.first("bank").alias("bank"), F.first(free).alias(free), F.round(F.first("hold") + 1e-9, 6).alias("hold"),
        F.first("hold_ok").alias("hold_ok"), F.min_by(F.struct("element_out", "element_in", "objective", "left"), first).alias("best"),
    )
    take = F.col("best").isNotNull() & (~F.col("hold_ok") | (F.col("best.objective") > F.col("hold")))
    return joined.select(
        "entry",
        F.when(take, F.col("best.element_out")).alias("element_out"),
        F.when(take, F.col("best.element_in")).alias("element_in"),
        "hold",
        F.when(take, F.col("best.objective")).otherwise(F.col("hold")).alias("objective"),
        F.when(take, hits).otherwise(0).cast("bigint").alias("hits"),
        F.when(take, F.col("best.left")).otherwise(F.col("bank")).alias("bank_after"),
    )
