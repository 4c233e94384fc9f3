"""The manifest against a tree built level by level."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from touchline.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, block string, tree string, total int, root string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc, source, lang, n_chars, text):
    fields = [None if v is None else str(v) for v in (doc, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in fields))


def tree_of(nodes, fanout=16):
    """All levels, and each node's siblings from the bottom up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    paths = []
    for i in range(len(nodes)):
        path, at = [], i
        for level in levels[:-1]:
            start = at // fanout * fanout
            run = level[start : start + fanout]
            path.append((run[: at - start], run[at - start + 1 :]))
            at //= fanout
        paths.append(path)
    return levels[-1][0] if nodes else None, paths


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def by_hand(rows, fanout=16):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, roots = {}, []
    for name in names:
        leaves = [(leaf_of(d, s, la, n, t), d, (d, s, la, n, t)) for d, t, la, s, n in groups[name]]
        leaves.sort(key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
        root, paths = tree_of([x[0] for x in leaves], fanout)
        found[name] = (root, paths, leaves)
        roots.append(root)
    top, over = tree_of(roots, fanout)
    out = []
    for name, upper in zip(names, over, strict=True):
        subroot, paths, leaves = found[name]
        for (leaf, doc, (d, s, la, n, t)), path in zip(leaves, paths, strict=True):
            path = path + upper
            claim = leaf
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0:
                claim = leaf_of(d, s, la, n, lowered(t))
            value = claim
            for before, after in path:
                value = sha("".join(before) + value + "".join(after))
            out.append((doc, leaf, subroot, top, sha("".join("".join(b) + "".join(a) for b, a in path)), value, value == top))
    return sorted(out, key=repr)


def given(spark, rows):
    return spark.createDataFrame([(d, t, la, s, n, 1, "b", "t", 2, "r") for d, t, la, s, n in rows], SCHEMA)


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rows_of_all_kinds(spark):
    rng = random.Random(1)
    rows = [(i, f"Text {i} É" * (i % 3), rng.choice(["en", None]), rng.choice(["a", "b", "é", "z", None]), rng.choice([i, None])) for i in range(500)]
    rows += [(1000, None, None, "lone", None), (1001, "", "", "", 0), (1002, "X" * 2_000_000, "en", "a", 1), (-5, "Neg", "en", "a", 3)]
    rows += [(7, "Other", "de", "a", 1), (7, "Other", "de", "a", 1), (7, "Third", "de", "b", 1), (None, "No Id", "de", "a", 1), (None, "No Id", "de", None, 1), rows[3]]
    rows += [(2000 + i, "Many", "en", f"s{i}", 4) for i in range(40)]
    expected = by_hand(rows)
    assert collected(manifest.documents_manifest(given(spark, rows).repartition(5), tampered())) == expected
    changed = {r[0] for r in expected if not r[6]}
    assert changed and all(zlib.crc32(str(d).encode()) % 5 == 0 for d in changed)
    assert collected(manifest.documents_manifest(given(spark, []), tampered())) == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 9, 26, 27, 28, 64, 65, 82, 250])
def test_small_fanouts_have_many_rounds(spark, n):
    """Blocks of three leaves and a fanout of three: up to five rounds, complete and not."""
    rows = [(i, f"T{i}", "en", "x", i) for i in range(n)] + [(1000 + i, f"T{i}", "en", "y", i) for i in range(min(n, 5))]
    leaves, blocks = manifest.manifest(manifest.document_leaves(given(spark, rows), tampered()), 3, 1)
    found = manifest.proofs(leaves, blocks, 3, 1, with_siblings=True)
    assert collected(found.drop("siblings")) == by_hand(rows, 3)
    for r in found.collect():
        assert sha("".join(r.siblings)) == r.proof_sha256
    # every block holds its proof, of as many steps as the tree has levels above a block
    assert {len(r.path) for r in blocks.collect() if r.tree == "+x"} == {max(0, len(levels_above(n, 3)) - 1) + 1}


def levels_above(n, fanout):
    found = [-(-n // fanout)]
    while found[-1] > 1:
        found.append(-(-found[-1] // fanout))
    return found


def test_one_source_and_one_row(spark):
    rows = [(4, "One", "en", None, 3)]
    ((doc, leaf, subroot, root, proof, folded, verified),) = collected(manifest.documents_manifest(given(spark, rows)))
    assert leaf == subroot == root == folded == leaf_of(4, None, "en", 3, "One") and proof == sha("") and verified


def test_equal_rows_may_be_most_rows(spark):
    rows = [(7, "Copy", "en", "a", 4)] * 300 + [(i, "Own", "en", "a", 3) for i in range(20)]
    assert collected(manifest.documents_manifest(given(spark, rows).repartition(4), tampered())) == by_hand(rows)


def test_registered_query_on_the_given_table(spark):
    from touchline.llm.queries import QUERIES

    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert collected(QUERIES["op13_manifest"](spark, "/root/testdata/sf0.01")) == by_hand(rows)
