"""Merkle manifest of a data set by butterfly exchange.

Every row is a leaf; each group's leaves, in key order, hang under a tree of a
given fanout, and the groups' roots, in group order, under one more. A proof is
the list of siblings from a leaf to the root.

Leaves lie in blocks, aligned runs of fanout**3 leaves of one group, and a block
is what one task works on. Its root is found from its own leaves. After that
blocks only exchange digests: in round r, blocks whose numbers differ in digit r
alone form a group of at most `fanout` and swap the roots of their subtrees.
Each of them hashes the swapped roots itself, so that after the round it holds
its next ancestor and that ancestor's siblings; nothing has to travel down from
a root. The last, incomplete subtree has fewer members than lanes, so its members
serve several lanes each. The groups' roots take part in the same way.

In the end a block's proof meets its leaves once more, and siblings, which are
many times the size of a leaf, never leave the task that hashes them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.sources.store import materialize

FANOUT = 16
#: Levels of the tree inside one block.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    """The leaf of a row: lowercase hex SHA-256 of its fields."""
    return F.sha2(F.concat(*[field_text(c) for c in columns]), 256)


def digest(texts) -> str:
    return hashlib.sha256("".join(texts).encode("ascii")).hexdigest()


def ranked(rows: DataFrame, within: str, order: list[str]) -> DataFrame:
    """`rows` with at, its place from 0 inside `within` in the given order, and total, the rows there.

    Rows are dealt by ranges of (within, order), sorted and stored with their
    place in the task; counts of each task and value of `within` turn that into
    places overall. No task sees a whole value of `within`. Rows equal in all of
    `order` are spread over ranges, too; which of them comes first is left open.
    """
    keys = [F.col(within), *[F.col(c).asc_nulls_first() for c in order], F.col("_spread")]
    spread = rows.withColumn("_spread", F.monotonically_increasing_id() % 4096)
    placed = materialize(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_spread").withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_task", F.shiftright("_place", 33))
    counts = placed.groupBy(within, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    every = Window.partitionBy(within)
    before = F.sum("_n").over(every.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(within, "_task", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(every).alias("total"))
    return placed.join(counts, [within, "_task"]).withColumn("at", F.col("_place") + F.col("_shift")).drop("_place", "_task", "_shift")


def exchange(nodes: DataFrame, fanout: int) -> DataFrame:
    """Butterfly rounds over nodes: tree, node, nodes (of the tree), digest.

    Adds root, the digest at the top of the tree, and path, an array of
    struct<before, after>: of each level the joined digests of the siblings
    before and after the own one. Levels of one node add nothing.
    """
    state = materialize(nodes.withColumn("path", F.array().cast("array<struct<before: string, after: string>>")))
    most = state.agg(F.max("nodes")).first()[0] or 0
    span = 1
    while span < most:
        subtree = F.floor(F.col("node") / span)
        low, up, digit = F.col("node") % span, F.floor(subtree / fanout), subtree % fanout
        members = F.least(F.lit(span), F.col("nodes") - subtree * span)
        state = state.withColumns({"_low": low, "_up": up, "_digit": digit})
        active = state.filter(F.col("nodes") > span)
        sent = active.select("tree", "_up", F.explode(F.sequence(low, F.lit(span - 1).cast("long"), members)).alias("_low"), "_digit", "digest")
        met = sent.groupBy("tree", "_up", "_low").agg(F.sort_array(F.collect_list(F.struct("_digit", "digest"))).alias("_met"))
        joined = state.join(met, ["tree", "_up", "_low"], "left")
        side = lambda keep: F.array_join(F.transform(F.filter("_met", keep), lambda m: m["digest"]), "")
        step = F.struct(side(lambda m: m["_digit"] < F.col("_digit")).alias("before"), side(lambda m: m["_digit"] > F.col("_digit")).alias("after"))
        parent = F.sha2(F.array_join(F.transform("_met", lambda m: m["digest"]), ""), 256)
        state = materialize(
            joined.select(
                "tree", "node", "nodes",
                F.when(F.col("_met").isNull(), F.col("digest")).otherwise(parent).alias("digest"),
                F.when(F.col("_met").isNull(), F.col("path")).otherwise(F.concat("path", F.array(step))).alias("path"),
            )
        )
        span *= fanout
    return state.withColumnRenamed("digest", "root")


def own_levels(leaves: list[str], total: int, fanout: int, levels: int) -> list[list[str]]:
    """Digests of each level inside a block, the leaves first. The tree's `total` tells which levels it has."""
    found = [leaves]
    for _ in range(levels):
        if total <= 1:
            break
        below = found[-1]
        found.append([digest(below[i : i + fanout]) for i in range(0, len(below), fanout)])
        total = -(-total // fanout)
    return found


def manifest(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(leaves, blocks) of `rows`, which have group string, key long, leaf string, and may have claim string.

    leaves   tree, block, at, total, key, group, leaf, claim
    blocks   tree, block, subroot, root, path: one row per block, with all of its proof above the block
    Trees are groups; a null group is a tree of its own and the first. Digests
    are stored before they are dealt by range, so that no row is hashed twice.
    """
    if "claim" not in rows.columns:
        rows = rows.withColumn("claim", F.col("leaf"))
    tree = F.when(F.col("group").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("group")))
    order = F.when(F.col("tree") == "-", F.lit(None)).otherwise(F.substring("tree", 2, 1 << 30))
    size = fanout**levels
    placed = ranked(materialize(rows.select(tree.alias("tree"), "key", "group", "leaf", "claim")), "tree", ["key", "leaf"])
    leaves = materialize(placed.withColumn("block", F.floor(F.col("at") / size)))

    def root_of(key, table):
        table = table.sort_by("at")
        total = table.column("total")[0].as_py()
        top = own_levels(table.column("leaf").to_pylist(), total, fanout, levels)[-1][0]
        blocks = pa.array([-(-total // size)], pa.int64())
        return pa.table({"tree": pa.array([key[0].as_py()]), "node": pa.array([key[1].as_py()], pa.int64()), "nodes": blocks, "digest": pa.array([top])})

    narrow = leaves.select("tree", "block", "at", "total", "leaf")
    roots = narrow.groupBy("tree", "block").applyInArrow(root_of, "tree string, node long, nodes long, digest string")
    inside = exchange(roots, fanout)
    groups = inside.filter("node = 0").select(F.lit("").alias("all"), "tree", order.alias("name"), F.col("root").alias("digest"))
    groups = ranked(groups, "all", ["name"]).select("tree", "digest", "at", "total")
    groups = materialize(groups)
    over = exchange(groups.select(F.lit("").alias("tree"), F.col("at").alias("node"), F.col("total").alias("nodes"), "digest"), fanout)
    tops = groups.select("tree", F.col("at").alias("node")).join(over.select("node", F.col("root").alias("_root"), F.col("path").alias("_path")), "node")
    blocks = inside.join(tops.drop("node"), "tree").select(
        "tree", F.col("node").alias("block"), F.col("root").alias("subroot"), F.col("_root").alias("root"), F.concat("path", "_path").alias("path")
    )
    return leaves, materialize(blocks)


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(leaves: DataFrame, blocks: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, with_siblings: bool = False) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; with `with_siblings` also siblings.

    folded_root is what the claim and the siblings give; verified says that it is
    the root. siblings are as many digests as the proof has, from the leaf up.
    """
    fields = PROOF + (", siblings array<string>" if with_siblings else "")

    def fold(own, above):
        if not own.num_rows or not above.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in arrow_fields(with_siblings)})
        own = own.sort_by("at")
        total = own.column("total")[0].as_py()
        subroot, root, path = (above.column(c)[0].as_py() for c in ("subroot", "root", "path"))
        path = [(step["before"], step["after"]) for step in path]
        leaf, claim = own.column("leaf").to_pylist(), own.column("claim").to_pylist()
        tree = own_levels(leaf, total, fanout, levels)
        runs = [["".join(level[i : i + fanout]) for i in range(0, len(level), fanout)] for level in tree[:-1]]
        proof, folded, siblings = [], [], []
        upper = "".join(before + after for before, after in path)
        for i, claimed in enumerate(claim):
            at, value, lower = i, claimed, []
            for level in runs:
                run, digit = level[at // fanout], 64 * (at % fanout)
                before, after = run[:digit], run[digit + 64 :]
                lower.append(before + after)
                value = digest((before, value, after))
                at //= fanout
            for before, after in path:
                value = digest((before, value, after))
            whole = "".join(lower) + upper
            proof.append(digest((whole,)))
            folded.append(value)
            if with_siblings:
                siblings.append([whole[j : j + 64] for j in range(0, len(whole), 64)])
        n = len(leaf)
        columns = [own.column("key"), leaf, [subroot] * n, [root] * n, proof, folded, [f == root for f in folded]] + [siblings] * with_siblings
        return pa.table({name: pa.chunked_array(c, kind) if isinstance(c, pa.ChunkedArray) else pa.array(c, kind) for (name, kind), c in zip(arrow_fields(with_siblings), columns, strict=True)})

    own = leaves.select("tree", "block", "at", "total", "key", "leaf", "claim").groupBy("tree", "block")
    return own.cogroup(blocks.groupBy("tree", "block")).applyInArrow(fold, fields)


def arrow_fields(with_siblings: bool) -> list[tuple[str, pa.DataType]]:
    text = pa.string()
    found = [("doc_id", pa.int64()), ("leaf", text), ("subroot", text), ("root", text), ("proof_sha256", text), ("folded_root", text), ("verified", pa.bool_())]
    return found + [("siblings", pa.list_(text))] * with_siblings


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """group, key, leaf, claim of documents.

    claim is the leaf of the row as it is claimed to be: where `tampered` holds,
    with the text's A-Z in lower case, else the leaf itself.
    """
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    columns = [F.col(c) for c in FIELDS]
    altered = [F.translate("text", capitals, capitals.lower()) if c == "text" else F.col(c) for c in FIELDS]
    leaf = leaf_digest(*columns)
    claim = leaf if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(*altered)).otherwise(leaf)
    return docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), leaf.alias("leaf"), claim.alias("claim"))


def documents_manifest(docs: DataFrame, tampered: Column | None = None, with_siblings: bool = False) -> DataFrame:
    """`proofs` of a documents table: a leaf per row, a tree per source.

    One row per row of `docs`. Null fields are hashed as `-`; a null doc_id comes
    first in its source and is never tampered with; a null source is a tree of
    its own and the first. Rows of one doc_id follow their leaves; equal rows are
    leaves of their own, and which proof belongs to which of them is the same to
    all. Empty texts are values of length 0. Other columns are not looked at,
    whatever their names. No rows give no rows. A text is hashed whole where it
    lies; what is shuffled are digests.
    """
    leaves, blocks = manifest(document_leaves(docs, tampered))
    return proofs(leaves, blocks, with_siblings=with_siblings)
