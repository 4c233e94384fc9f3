"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A target of m times the source's size gives
each document floor(m) certain copies. The words that are then lacking are
sampled with inclusion probabilities in proportion to document size: a document
of `size` words has one more copy with probability size / scale. Documents of
`scale` words or more have it for certain, and the scale is renormalised so that
the expected words of all documents are what lacks. The others are ranked by
random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the
first ones are taken until their words come nearest to what is still lacking.

No source is sorted as a whole. The ranks are mapped to (0, 1) and counted in
words per bucket, twice, each time inside the bucket that holds the cut; only
what then shares a bucket with the cut is put in order. The scale comes from the
number of documents per source and size. The outcome is one cut per source, so
decisions apply row by row and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.sources.store import materialize

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
MOST_COPIES = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number inside (0, 1) from the id: 52 bits of a hash."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: one row per source of `sizes` (source, size).

    Sources in code point order, null last, get the weights in turn and share all
    words by them. A target stops at `most` times its source's size; the excess
    goes to the others by weight until none is above. The windows run over one
    row per source.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    everywhere = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = totals.select("source", "source_size", weight.alias("w"), F.sum("source_size").over(everywhere).alias("words"))
    filling = everywhere.orderBy(F.col("source_size") * most / F.col("w"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    capped = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    level = (F.col("words") - capped).cast("double") / F.sum("w").over(after)
    rows = rows.select("*", level.alias("level"))
    # the level rises while full sources are set aside and falls afterwards
    rows = rows.select("*", F.max("level").over(everywhere).alias("final"))
    target = F.least(F.col("source_size").cast("double") * most, F.col("final") * F.col("w"))
    return rows.select("source", "source_size", target.alias("target"))


def _rank(seed: int) -> Column:
    """Random odds over inclusion odds; null where no copy is left to chance."""
    u, p = uniform(F.col("doc_id"), seed), F.col("size") / F.col("scale")
    return F.when((F.col("size") > 0) & (F.col("size") < F.col("scale")), (u / (1 - u)) / (p / (1 - p)))


def inclusion_scales(sizes: DataFrame, lacking: DataFrame) -> DataFrame:
    """s, scale, sure: the scale of each source of `lacking` (s, lack > 0), and the words of its documents of that size or more.

    With the documents below size c sampled and the others certain, the scale is
    (sum of squared sizes below c) / (lack - words from c on); the smallest c
    that is not below its own scale is the one. The windows run over distinct
    sizes of a source, not over documents.
    """
    same = F.col("source").eqNullSafe(F.col("s"))
    counts = sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(lacking, same).select("s", "lack", "size", "n", (F.col("size") * F.col("n")).alias("words"))
    by_size = Window.partitionBy("s").orderBy("size")
    below = by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    squares = F.sum(F.col("size").cast("double") * F.col("words")).over(below)
    sure = F.coalesce(F.sum("words").over(by_size.rowsBetween(1, Window.unboundedFollowing)), F.lit(0).cast("long"))
    rows = rows.select("s", "lack", "size", squares.alias("squares"), sure.alias("sure"), F.lead("size").over(by_size).alias("next"))
    rows = rows.filter("lack > sure").withColumn("scale", F.col("squares") / (F.col("lack") - F.col("sure")))
    fits = rows.filter(F.col("next").isNull() | (F.col("scale") <= F.col("next")))
    least = fits.groupBy("s").agg(F.min(F.struct("size", "scale", "sure")).alias("found"))
    return least.select("s", F.col("found.scale").alias("scale"), F.col("found.sure").alias("sure"))


def source_cuts(sizes: DataFrame, targets: DataFrame, seed: int, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target, whole, scale, and the last taken (cut_rank, cut_doc, cut_size), null where none is taken."""
    m = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plans = targets.withColumn("whole", F.least(F.floor(m), F.lit(most)).cast("long"))
    lack = F.when(F.col("whole") < most, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0))
    plans = materialize(plans.withColumn("lack", lack))
    scales = inclusion_scales(sizes, plans.filter("lack > 0").select(F.col("source").alias("s"), "lack"))
    same = F.col("source").eqNullSafe(F.col("s"))
    plans = materialize(plans.join(scales, same, "left").drop("s").withColumn("lack", F.col("lack") - F.coalesce("sure", F.lit(0).cast("long"))).drop("sure"))
    left = plans.select(F.col("source").alias("s"), "scale", "lack").filter("scale IS NOT NULL")
    ranked = sizes.filter("size > 0").join(left, same).withColumn("rank", _rank(seed)).drop("s", "scale").filter("rank IS NOT NULL")
    ranked = ranked.withColumn("place", F.col("rank") / (1 + F.col("rank")) * BUCKETS).withColumn("bucket", F.floor("place"))
    ranked = ranked.withColumn("inner", F.floor((F.col("place") - F.col("bucket")) * BUCKETS))

    def crossing(rows: DataFrame, bucket: str) -> DataFrame:
        """Per source the bucket in which the words pass what lacks, and the words before it."""
        words = rows.groupBy("source", bucket).agg(F.sum("size").alias("words"), F.first("lack").alias("lack"), F.first("before").alias("before"))
        so_far = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy(bucket))
        words = words.select("source", bucket, "lack", so_far.alias("upto"), (so_far - F.col("words")).alias("start"))
        first = Window.partitionBy("source").orderBy((F.col("upto") < F.col("lack")).cast("int"), F.when(F.col("upto") < F.col("lack"), -F.col(bucket)).otherwise(F.col(bucket)))
        return materialize(words.withColumn("k", F.row_number().over(first)).filter("k = 1").select(F.col("source").alias("s"), F.col(bucket).alias("b"), F.col("start").alias("before")))

    outer = crossing(ranked.withColumn("before", F.lit(0).cast("long")), "bucket")
    inside = ranked.join(outer, same & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inner = crossing(inside, "inner")
    last = inside.drop("before").join(inner, same & (F.col("inner") == F.col("b"))).drop("s", "b")
    in_order = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size")
    upto = F.col("before") + F.sum("size").over(in_order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # the nearest of all prefixes that end in the last bucket; the one that ends before it is the null cut of that bucket
    ends = last.withColumn("upto", upto).select("source", "rank", "doc_id", "size", F.abs(F.col("upto") - F.col("lack")).alias("miss"), F.abs(F.col("before") - F.col("lack")).alias("none"), "bucket", "inner")
    best = Window.partitionBy("source").orderBy("miss", "rank", F.col("doc_id").asc_nulls_last(), "size")
    cuts = ends.withColumn("k", F.row_number().over(best)).filter("k = 1")
    some = F.col("miss") <= F.col("none")
    cuts = cuts.select(
        F.col("source").alias("s"), F.col("bucket").alias("cut_bucket"), F.col("inner").alias("cut_inner"), F.when(some, F.col("rank")).alias("cut_rank"),
        F.when(some, F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("cut_doc"), F.when(some, F.col("size")).alias("cut_size"),
    )
    return materialize(plans.join(cuts, same, "left").drop("s", "lack"))


def apply_cuts(rows: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """`rows` (with doc_id, source, size) plus source_size, target and copies.

    `cuts` has one row per source and is broadcast by Spark when it is small.
    """
    plan = cuts.withColumnRenamed("source", "s")
    rank = _rank(seed)
    place = rank / (1 + rank) * BUCKETS
    bucket = F.floor(place)
    inner = F.floor((place - bucket) * BUCKETS)
    doc = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    before = (bucket < F.col("cut_bucket")) | ((bucket == F.col("cut_bucket")) & (inner < F.col("cut_inner")))
    upto = (rank < F.col("cut_rank")) | ((rank == F.col("cut_rank")) & ((doc < F.col("cut_doc")) | ((doc == F.col("cut_doc")) & (F.col("size") <= F.col("cut_size")))))
    here = (bucket == F.col("cut_bucket")) & (inner == F.col("cut_inner")) & F.coalesce(upto, F.lit(False))
    certain = (F.col("size") > 0) & F.coalesce(F.col("size") >= F.col("scale"), F.lit(False))
    extra = F.when(certain | ((F.col("size") > 0) & F.coalesce(before | here, F.lit(False))), 1).otherwise(0)
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["s"]))
    return joined.withColumn("copies", F.col("whole") + extra).drop("s", "whole", "scale", "cut_bucket", "cut_inner", "cut_rank", "cut_doc", "cut_size")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, seed: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row per row of `docs`.

    size is the number of words, 0 for null texts. Null sources are one source.
    Rows with equal id and size stand or fall together. Sources of size 0 get
    target 0. No rows give no rows. Other columns of `docs` are not looked at.
    """
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")))
    cuts = source_cuts(sizes, source_targets(sizes, weights, most), seed, most)
    return apply_cuts(sizes, cuts, seed)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, seed: int = 3) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with the columns of `docs`, whatever their names: rows travel as one column."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    sizes = materialize(rows.drop("row"))
    cuts = source_cuts(sizes, source_targets(sizes, weights, most), seed, most)
    taken = apply_cuts(rows, cuts, seed).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
