"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Two permutations of one universe give all signature coordinates: the first
scatters the shingles, the second, read with a circular shift of k, gives
coordinate k. Coordinates of a shingle are therefore neighbours in one table,
and a signature is the minimum over rows of that table.

Equal shingle sets collapse into one node first. Banding proposes links only
from each bucket's members to one centre, drawn anew in every bucket, so a
bucket of m nodes gives m - 1 pairs. Buckets that then still hold several
components get new centres for a few turns. Then every pair between components
is proposed. Sizes and parity bits of the sets (`parity_bits`) tell which proposed
pairs can be links: where more bits differ than two linked sets may differ in
shingles, there is none, so nothing is lost. What is left is confirmed on the
full sets, which are made for the nodes of such pairs only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.components import connected_components
from touchline.llm.hashing import BASE, mix, shingle_hashes, word_hashes
from touchline.sources.store import materialize, release

UNIVERSE = 1 << 21
SEED = 7
PARITY_WORDS = 16  # 64 bits each
SLOTS = 1 << 24  # a multiple of the 32,768 bits of one of Spark's bitmaps
BANDS, ROWS = 40, 5  # a pair at 0.8 shares no band with a probability of (1 - 0.8**5)**40, about 1e-7

_tables = {}


def circulant_tables(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the second one as overlapping rows of `width` shifts."""
    if width not in _tables:
        rng = np.random.Generator(np.random.PCG64(SEED))
        scatter = rng.permutation(UNIVERSE).astype(np.int32)
        second = rng.permutation(UNIVERSE).astype(np.int32)
        circle = np.concatenate([second, second[:width]])
        _tables[width] = scatter, np.lib.stride_tricks.sliding_window_view(circle, width)
    return _tables[width]


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """All `width` coordinates of a non-empty set."""
    scatter, shifted = circulant_tables(width)
    at = scatter[(shingles >> np.uint64(43)).astype(np.int64)]  # the top 21 bits name the element
    least = shifted[at[:4096]].min(axis=0)
    for start in range(4096, len(at), 4096):
        np.minimum(least, shifted[at[start : start + 4096]].min(axis=0), out=least)
    return least


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in coordinates.reshape(bands, rows).astype(np.uint64).T:
        key = mix(key * BASE + column)
    return key.view(np.int64)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """Shingles hashed to 64 * PARITY_WORDS places, with the parity of each place.

    A shingle that only one of two sets has flips one bit, so two sets differ in
    at least as many shingles as their bits do.
    """
    places = (shingles & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64)
    odd = np.bincount(places, minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def text_sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The shingle set of each row, from the `text` column."""
    for text in batch.column("text").cast(pa.binary()).to_pylist():
        yield shingle_hashes(word_hashes(text, lower=True), size) if text else np.zeros(0, np.uint64)


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits of the set), keys (one per band), bits (parities)."""

    def work(batches):
        for batch in batches:
            counts, marks, keys, bits = [], [], [], []
            for shingles in text_sets(batch, size):
                counts.append(len(shingles))
                marks.append(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64))
                bits.append(parity_bits(shingles))
                keys.append(band_keys(signature(shingles, bands * rows), bands, rows) if len(shingles) else np.zeros(0, np.int64))
            marks = np.array(marks, np.int64).reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), keys, pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_a", "set_b", "keys", "bits"],
            )

    columns = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, bits array<long>"
    return docs.select("doc_id", "text").mapInArrow(work, columns)


def id_slot(column: str | Column) -> Column:
    return F.xxhash64(column).bitwiseAND(F.lit(SLOTS - 1))


def slot_bits(wanted: DataFrame) -> np.ndarray:
    """One bit for each of SLOTS, set where the `node` of some row hashes to: 2 MB however many rows there are."""
    slot = id_slot("node")
    parts = wanted.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits"))
    table = np.zeros((SLOTS >> 15, 4096), np.uint8)
    for part, bits in parts.collect():
        table[part] = np.frombuffer(bits, np.uint8)
    return table.ravel()


def filled(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 3] >> (slot & 7)) & 1 == 1


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, items: the whole shingle sets of the documents whose id is a `node` of `wanted`.

    Texts are not exchanged for it: where they are read, a bit table of ids leaves
    out nearly all others, and only the sets that remain meet `wanted`.
    """
    table = slot_bits(wanted)

    def work(batches):
        for batch in batches:
            batch = batch.filter(pa.array(filled(table, batch.column("slot").to_numpy())))
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [s.view(np.int64) for s in text_sets(part, size)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["node", "items"])

    found = docs.select("doc_id", "text", id_slot("doc_id").alias("slot")).mapInArrow(work, "node long, items array<long>")
    return found.join(wanted.select("node").distinct(), "node", "left_semi").distinct()


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is in no row of `gone`; rows without an id stay.

    As in `full_sets` a bit table of ids decides where the texts are read: rows it
    does not name stay without an exchange, only the others meet `gone`.
    """
    table = slot_bits(gone.select(F.col("doc_id").cast("long").alias("node")))
    named = F.pandas_udf(lambda slot: pd.Series(filled(table, slot.to_numpy())), "boolean")
    marked = docs.withColumn("_named", named(id_slot(F.col("doc_id").cast("long"))))
    met = marked.filter("_named").join(gone.select("doc_id"), "doc_id", "left_anti")
    return marked.filter("NOT _named").select(*docs.columns).unionAll(met.select(*docs.columns))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("u"), F.col("items").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("items").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    shared = pairs.join(left, "u").join(right, "v").select("u", "v", both.alias("both"), (F.size("a") + F.size("b")).alias("sizes"))
    return shared.filter(F.col("both") * (100 + percent) >= F.col("sizes") * percent).select("u", "v").distinct()


def sizes_fit(percent: int) -> str:
    return f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)"


def bits_fit(percent: int) -> str:
    """Of linked sets, few enough shingles are in one of them only."""
    differ = " + ".join(f"bit_count(bitsu[{i}] ^ bitsv[{i}])" for i in range(PARITY_WORDS))
    return f"(100 + {percent}) * ({differ}) <= (100 - {percent}) * (nu + nv)"


def possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, nu, v, nv), n being the sets' sizes, those (u, v) whose sizes and parity bits allow a link."""
    side = lambda x: bits.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    met = pairs.filter(sizes_fit(percent)).distinct().join(side("u"), ["u", "nu"]).join(side("v"), ["v", "nv"])
    return met.filter(bits_fit(percent)).select("u", "v").distinct()


def both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node"))


def ordered(pairs: DataFrame, one: str, n_one: str, two: str, n_two: str) -> DataFrame:
    """(u, nu, v, nv) with u < v."""
    first = F.col(one) < F.col(two)
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return pairs.filter(F.col(one) != F.col(two)).select(
        pick(one, two).alias("u"), pick(n_one, n_two).alias("nu"), pick(two, one).alias("v"), pick(n_two, n_one).alias("nv")
    )


def shared_buckets(members: DataFrame) -> DataFrame:
    """The members (key, node, n) of buckets with two rows or more, with the bucket's centre and its size n_centre.

    Nearly all keys are alone, so counting on the map side joins hardly any rows:
    the members are exchanged once, and counted and given their centre there.
    """
    bucket = Window.partitionBy("key")
    drawn = F.min(F.struct(F.expr("node ^ key").alias("m"), F.col("n").alias("n_centre"))).over(bucket)
    counted = members.withColumns({"c": F.count(F.lit(1)).over(bucket), "d": drawn}).filter("c > 1")
    return counted.select("key", "node", "n", F.expr("d.m ^ key").alias("centre"), "d.n_centre").distinct()


def split_buckets(hot: DataFrame, groups: DataFrame) -> DataFrame:
    """The members (key, node, n, component) of buckets with more than one component."""
    placed = hot.join(groups, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("key")
    return placed.join(split, "key")


def pairs_with_centres(rest: DataFrame, salt: int) -> DataFrame:
    """Each member with the centre that `salt` draws in its bucket, where their components differ: (u, nu, v, nv)."""
    drawn = rest.groupBy("key").agg((F.min(F.expr(f"node ^ key ^ {salt}L"))).alias("m"))
    drawn = drawn.select("key", F.expr(f"m ^ key ^ {salt}L").alias("node"))
    centres = rest.join(drawn, ["key", "node"]).select(
        "key", F.col("node").alias("centre"), F.col("n").alias("n_centre"), F.col("component").alias("other")
    ).distinct()
    return ordered(rest.join(centres, "key").filter("component != other"), "node", "n", "centre", "n_centre")


def pairs_across(rest: DataFrame, percent: int) -> DataFrame:
    """The pairs of a bucket in different components whose sizes and parity bits (`bits`) allow a link."""
    side = lambda x: [F.col("node").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "component", "bits")]]
    fits = f"u < v AND componentu != componentv AND {sizes_fit(percent)}"
    one, two = rest.select("key", *side("u")), rest.select("key", *side("v"))
    return one.join(two, "key").filter(f"{fits} AND {bits_fit(percent)}").select("u", "v").distinct()


def own_links(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the nodes that one document's several sets belong to."""
    spread = F.min(F.struct("set_a", "set_b")) != F.max(F.struct("set_a", "set_b"))
    several = named.groupBy("doc_id").agg(spread.alias("_several")).filter("_several").select("doc_id")
    placed = named.join(several, "doc_id", "left_semi").select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select("doc_id", "node")
    least = placed.groupBy("doc_id").agg(F.min("node").alias("u"))
    return placed.join(least, "doc_id").filter("node != u").select("u", F.col("node").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text",
    bands: int = BANDS, rows: int = ROWS, turns: int = 4,
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of `docs`.

    A row's set holds its distinct shingles of `size` words (A-Z lower-cased,
    words split at white space); fewer words make one shingle of them all.
    Documents whose sets overlap by `percent` of their union are linked, and
    component_id is the smallest id reachable.

    Null or wordless texts have no set and are linked with nothing. Rows with one
    id are one document with several sets, and have one component. A row without
    an id has a null component. Other columns of `docs` are not looked at; no rows give no rows.
    Sets are compared as 64-bit hashes of shingles.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    marks = materialize(sketches(docs, size, bands, rows))
    named = marks.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"))

    # one row per band of each distinct set; only buckets with two nodes or more matter
    first = named.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", "set_a", "set_b"], "left_semi")
    members = first.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    hot = materialize(shared_buckets(members))
    release(docs.sparkSession)  # the exchanged members are the largest files of all
    bits = materialize(first.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bits").join(hot.select("node").distinct(), "node", "left_semi"))

    stars = ordered(hot, "node", "n", "centre", "n_centre")
    tried = materialize(possible(stars, bits, percent))
    sets = materialize(full_sets(docs, both_ends(tried), size))
    groups = materialize(connected_components(confirmed(tried, sets, percent).unionAll(own_links(named, classes))))

    # buckets that still hold several components: new centres, linked to other components only
    rest = hot
    for turn in range(1, turns + 1):
        release(docs.sparkSession)
        rest = materialize(split_buckets(rest.select("key", "node", "n"), groups))  # components only grow: others stay whole
        if rest.isEmpty():
            break
        salt = int(mix(np.array([turn], np.uint64)).view(np.int64)[0])
        if turn < turns:
            pairs = possible(pairs_with_centres(rest, salt), bits, percent)
        else:  # what no centre could join
            pairs = pairs_across(rest.join(bits, ["node", "n"]), percent)
        pairs = materialize(pairs.join(tried, ["u", "v"], "left_anti"))
        if pairs.isEmpty():
            continue
        lacking = materialize(both_ends(pairs).distinct().join(sets.select("node"), "node", "left_anti"))
        if not lacking.isEmpty():
            sets = sets.unionAll(materialize(full_sets(docs, lacking, size)))
        more = materialize(confirmed(pairs, sets.join(both_ends(pairs), "node", "left_semi"), percent))
        tried = tried.unionAll(pairs)
        if not more.isEmpty():
            stars = groups.filter("node != component").select(F.col("node").alias("u"), F.col("component").alias("v"))
            groups = materialize(connected_components(stars.unionAll(more)))

    roots = classes.join(groups, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    roots = materialize(roots)
    found = marks.filter("n_shingles > 0").join(roots, ["set_a", "set_b"], "left")
    empty = marks.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return found.select("doc_id", "n_shingles", own.alias("component_id")).unionAll(empty)
