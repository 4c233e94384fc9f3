"""Quality rules: base counts of a text, and lines that too many documents of a host share.

Built from SQL functions only. Lines are normalised and hashed, and counted once
per distinct document and host, with partial counts before the shuffle: rows of
equal text on one host are one document, so copies do not make a document's own
lines common. Lines on a fixed
number of a host's documents are boilerplate there, and so are lines on a share
of a small host's; what a document has left without them decides whether it is
depleted. Common lines and the lines of documents meet in a join by host and
line, so neither a host's size nor the number of its common lines is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.sources.store import materialize

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5


def words_of(text: Column) -> Column:
    """The words of a text, in order; null for a null text."""
    return F.array_remove(F.split(text, SPACE), "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def line_key(line: Column) -> Column:
    """Hash of a line in lower case, with digits and white space made one blank."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D0-9]+", " ")))


def window_keys(words: Column) -> Column:
    """Hashes of all runs of five words; array operations on 64-bit hashes, position by position."""
    from_place = lambda array, start: F.slice(array, start, F.greatest(F.size(array) - (start - 1), F.lit(0)))
    pair = lambda a, b: F.xxhash64(a, b)
    one = F.transform(words, lambda w: F.xxhash64(w))
    two = F.zip_with(one, from_place(one, 2), pair)
    four = F.zip_with(two, from_place(two, 3), pair)
    five = F.zip_with(four, from_place(one, 5), pair)
    return F.slice(five, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def words_in_repeats(keys: Column) -> Column:
    """How many words lie in a window whose hash occurs twice or more."""
    placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    beside = F.slice(placed, 2, F.greatest(F.size(placed) - 1, F.lit(0)))
    none = F.array().cast("array<int>")
    both = F.zip_with(placed, beside, lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"])).otherwise(none))
    starts = F.sort_array(F.array_distinct(F.flatten(both)))
    after = F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))
    covered = F.zip_with(starts, after, lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), total).otherwise(F.lit(0).cast("long"))


def placed_lines(rows: DataFrame) -> DataFrame:
    """host, t1, t2 (hashes of host and text, 128 bits) and the key and words of each line, in order; one row per distinct document."""
    pair = lambda line: F.struct(line_key(line).alias("line"), F.size(words_of(line)).alias("n"))
    lines = F.transform(lines_of(F.col("text")), pair).alias("lines")
    return distinct_texts(materialize(rows.select(F.monotonically_increasing_id().alias("row"), "host", "t1", "t2", lines)))


def distinct_texts(placed: DataFrame) -> DataFrame:
    """One row per text of a host. Only hashes and row numbers are shuffled to find the later copies."""
    copies = placed.groupBy("t1", "t2").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("t1", "t2", "first")
    found = placed.join(copies, ["t1", "t2"], "left")
    return found.filter(F.col("first").isNull() | (F.col("row") == F.col("first"))).drop("row", "first")


def common_lines(placed: DataFrame, share: float, least_docs: int, least_shared: int) -> DataFrame:
    """h, l: hashes of lines on `least_docs` documents of host h, however many it has, or on `least_shared` and over `share` of them.

    A document counts once per line.
    """
    counts = placed.select("host", F.explode(F.array_distinct("lines.line")).alias("l")).groupBy("host", "l").agg(F.count(F.lit(1)).alias("n"))
    sizes = placed.groupBy("host").agg(F.count(F.lit(1)).alias("docs")).withColumnRenamed("host", "h")
    often = counts.filter(F.col("n") >= min(least_docs, least_shared)).join(sizes, F.col("host").eqNullSafe(F.col("h")))
    part = (F.col("n") >= least_shared) & (F.col("n") > share * F.col("docs"))
    return materialize(often.filter((F.col("n") >= least_docs) | part).select("h", "l"))


def common_of_texts(placed: DataFrame, common: DataFrame) -> DataFrame:
    """t1, t2, common, gone: per text of a host with common lines their hashes, and the words in them. Copies are one row."""
    lines = placed.select("host", "t1", "t2", F.posexplode("lines").alias("place", "pair")).select("host", "t1", "t2", "place", "pair.line", "pair.n")
    met = lines.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "left_semi")
    found = met.groupBy("t1", "t2").agg(F.collect_set(F.struct("place", "line", "n")).alias("found"))
    gone = F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return found.select("t1", "t2", F.array_distinct("found.line").alias("common"), gone.alias("gone"))


def quality(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
    share: float = 0.1, least_docs: int = 20, least_words: int = 10, least_left: float = 0.5, least_shared: int = 3,
) -> DataFrame:
    """One row per row of `docs`: counts, base_failed, words_left, kept and clean_text.

    base_failed: under ten words, or over 20 % of the words in repeated five-word
    windows. kept: not failed, and without the lines that its host repeats (on
    `least_docs` documents, or on `least_shared` and over `share` of them) the
    document still has `least_words` words and `least_left` of its words.
    clean_text is the text without these lines (null for a null text).

    A null text has no words. Null hosts are one host. Rows of one host with equal
    texts count as one document, whatever their ids; each gets its own result row. Other columns of `docs` are not looked at. No rows, no rows.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(host_column).alias("host"))
    rows = rows.withColumns({"t1": F.xxhash64("host", "text"), "t2": F.xxhash64(F.lit(1), F.col("host").isNull(), "host", "text")})
    placed = placed_lines(rows)
    common = common_of_texts(placed, common_lines(placed, share, least_docs, least_shared))

    found = rows.select("doc_id", "text", "t1", "t2", F.coalesce(words_of(F.col("text")), F.array().cast("array<string>")).alias("words"), F.coalesce(lines_of(F.col("text")), F.array().cast("array<string>")).alias("lines"))
    found = found.select("*", window_keys(F.col("words")).alias("windows"))
    found = found.select(
        "doc_id", "text", "t1", "t2",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        words_in_repeats(F.col("windows")).alias("n_repeat_words"),
    ).join(common, ["t1", "t2"], "left").drop("t1", "t2")
    kept_lines = F.filter(F.split("text", "\n"), lambda line: ~F.array_contains("common", line_key(line)))
    clean = F.when(F.col("common").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = found.select("*", clean.alias("clean_text"), failed.alias("base_failed"), left.alias("words_left")).drop("text", "common", "gone")
    enough = (F.col("words_left") >= least_words) & (F.col("words_left") >= least_left * F.col("n_words"))
    return found.select("*", (~F.col("base_failed") & enough).alias("kept"))
