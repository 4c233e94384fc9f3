"""Repeated byte strings across documents, by run-length indexes of repetitive text.

A byte goes if a string of 100 bytes that covers it also starts earlier, in a
smaller document or earlier in the same one. All strings of 100 bytes count.

Every such window is given to one anchor, the least hash of the 32-byte strings
inside it; equal windows have equal anchors. Successive windows with one anchor
make a segment. Anchors that occur in two places or more bring their segments
together; equal segments are one from there on, with its first place.

The distinct segments of a set of anchors are then indexed as one repetitive
text: its Burrows-Wheeler transform is run-length compressed, and only the
suffixes at run ends are sampled. From these samples alone the matching
statistics of the whole text against itself are streamed: for each position the
suffix before it in order, and how long both agree. Positions that agree over
100 bytes form groups, of which the first place stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.hashing import INVERSE, mix, powers, prefix_sums, run_bounds
from touchline.sources.store import materialize

LENGTH, SEED = 100, 32
LONGEST_RUN = 4096  # windows of one segment; longer runs, as in periodic text, are cut
FLUSH_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20
STREAM = 1 << 20
LAST = (1 << 63) - 1


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum (`best`) of every `width` successive values, in doubling steps."""
    span = 1
    while span * 2 <= width:
        values, span = best(values[:-span], values[span:]), span * 2
    return best(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def segments(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each segment of one text, and whether its anchor may recur inside it."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    sums = prefix_sums(data)
    hashes = mix((sums[seed:] - sums[:-seed]) * powers(INVERSE, len(data) + 1)[: len(data) - seed + 1])
    width = length - seed + 1
    least = sliding(hashes, width, np.minimum)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    counts = np.diff(np.append(starts, n))
    # places that are the least of some window; an anchor that recurs in a segment has two of them in succession
    margin = np.zeros(width - 1, np.uint64)
    chosen = hashes[hashes == sliding(np.concatenate([margin, least, margin]), width, np.maximum)]
    twins = chosen[1:][chosen[1:] == chosen[:-1]]
    again = np.isin(least[starts], twins) if len(twins) else np.zeros(len(starts), bool)
    if counts.max() > LONGEST_RUN:
        pieces = -(-counts // LONGEST_RUN)
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = np.repeat(counts, pieces)
        starts, again = np.repeat(starts, pieces) + inner * LONGEST_RUN, np.repeat(again, pieces)
        counts = np.minimum(whole - inner * LONGEST_RUN, LONGEST_RUN)
    return least[starts], starts, counts, again


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """key, anchor, cls, place, known: one row per segment of each distinct text of a task.

    place packs the first window and the number of windows. Of an anchor that a
    task meets twice, only one row carries the anchor as key; the others are
    known to be shared and get keys of their own, so no key is hot.
    """
    names = ["key", "anchor", "cls", "place", "known"]

    def work(batches):
        met, held, size = set(), [], 0

        def flush():
            anchor = np.concatenate([h[0] for h in held])
            cls = np.concatenate([np.full(len(h[0]), h[2], np.int64) for h in held])
            place = np.concatenate([h[1] for h in held])
            _, first, inverse, counts = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            known = (counts[inverse] > 1) | np.concatenate([h[3] for h in held])
            key = np.where(np.arange(len(anchor)) == first[inverse], anchor, mix(anchor + place.astype(np.uint64) * np.uint64(3) + cls.view(np.uint64)))
            columns = [key.view(np.int64), anchor.view(np.int64), cls, place, known]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for batch in batches:
            for cls, text in zip(batch.column("cls").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if cls in met or len(text) < length:
                    continue
                met.add(cls)
                anchor, starts, counts, again = segments(np.frombuffer(text, np.uint8), length)
                held.append((anchor, starts << 13 | counts, cls, again))
                size += len(text)
                if size >= FLUSH_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("cls", "text").mapInArrow(work, "key long, anchor long, cls long, place long, known boolean")


def packed_texts(docs: DataFrame, once: bool) -> DataFrame:
    """doc_id, cls, packed: texts compressed before they travel; with `once`, each distinct text once per task."""

    def work(batches):
        met, packer = set(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                if once:
                    fresh = []
                    for cls in part.column("cls").to_pylist():
                        fresh.append(cls not in met)
                        met.add(cls)
                    part = part.filter(pa.array(fresh, pa.bool_()))
                packed = [packer.compress(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("cls"), pa.array(packed, pa.binary())], ["doc_id", "cls", "packed"])

    return docs.select("doc_id", "cls", "text").mapInArrow(work, "doc_id long, cls long, packed binary")


def segment_texts(rows: DataFrame, length: int) -> DataFrame:
    """anchor, doc, cls, start, segment: the bytes of the shared segments, equal ones of a task once, at their first place."""
    names = ["anchor", "doc", "cls", "start", "segment"]

    def work(batches):
        unpack = zstandard.ZstdDecompressor()
        held, size = {}, 0

        def flush():
            keys = list(held)
            doc, start, cls = zip(*held.values(), strict=True)
            columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array(doc, pa.int64()), pa.array(cls, pa.int64()), pa.array(start, pa.int64()), pa.array([k[1] for k in keys], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for row in range(batch.num_rows):
                doc, cls = batch.column("first_doc")[row].as_py(), batch.column("cls")[row].as_py()
                text = unpack.decompress(batch.column("packed")[row].as_py())
                found = batch.column("shared")[row].values
                for anchor, place in zip(found.field("anchor").to_pylist(), found.field("place").to_pylist(), strict=True):
                    start = place >> 13
                    key = (anchor, text[start : start + (place & 8191) + length - 1])
                    at = (doc, start, cls)
                    old = held.get(key)
                    if old is None:
                        held[key] = at
                        size += len(key[1])
                    elif at < old:
                        held[key] = at
                if size >= FLUSH_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return rows.select("first_doc", "cls", "packed", "shared").mapInArrow(work, "anchor long, doc long, cls long, start long, segment binary")


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of a text with unique ends, in order; prefix doubling over the suffixes still tied."""
    n, base = len(symbols), int(symbols.max()) + 2
    span = 1
    while span < 8 and base ** (span + 1) < 1 << 62:
        span += 1
    padded = np.concatenate([symbols + 1, np.zeros(span, np.int64)])
    key = padded[:n].copy()
    for i in range(1, span):
        key *= base
        key += padded[i : n + i]
    order = np.argsort(key)
    rank = np.zeros(n, np.int64)  # a rank is one more than the place of its group's first suffix
    places, rows = np.arange(n), order  # of the suffixes still tied
    key = key[order]
    while True:
        edge = np.concatenate([[True], key[1:] != key[:-1], [True]])
        first = np.flatnonzero(edge)
        group = np.repeat(places[first[:-1]], np.diff(first)) + 1
        rank[rows] = group
        tied = ~(edge[:-1] & edge[1:])
        if not tied.any():
            return order
        places, rows, group = places[tied], rows[tied], group[tied]
        after = rows + span
        key = np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        key += group * (n + 1)
        by = np.argsort(key)
        rows, key = rows[by], key[by]
        order[places] = rows
        span *= 2


class RunLengthIndex:
    """Run heads of the transform of a text, each with the suffix that ends the run before it and their agreement."""

    def __init__(self, parts: list[bytes]):
        lengths = np.array([len(p) for p in parts], np.int64)
        self.text = np.frombuffer(b"\xff".join(parts) + b"\xff" + b"\xff" * 8, np.uint8)
        self.size = int(lengths.sum()) + len(parts)
        ends = np.cumsum(lengths + 1) - 1
        symbols = self.text[: self.size].astype(np.int64) + len(parts)
        symbols[ends] = np.arange(len(parts))  # every end is a symbol of its own
        order = suffix_order(symbols)
        before = symbols[order - 1]
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.runs = len(heads)
        at, run_end = order[heads], np.concatenate([[0], order[heads[1:] - 1]])
        agree = self._agreement(at, run_end, ends)
        agree[0] = 0
        by = np.argsort(at)
        self.at, self.run_end, self.agree = at[by], run_end[by], agree[by]

    def _agreement(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share, inside their parts."""
        most = np.minimum(ends[np.searchsorted(ends, a)] - a, ends[np.searchsorted(ends, b)] - b)
        same, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(live):
            x, y = a[live] + same[live], b[live] + same[live]
            equal = self.text[x] == self.text[y]
            live = live[equal]
            same[live] += 1
            live = live[same[live] < most[live]]
        return same

    def matching_statistics(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """For the positions start..end: the suffix before each in order, and how many bytes both share."""
        p = np.arange(start, end)
        j = np.searchsorted(self.at, p, "right") - 1
        moved = p - self.at[j]
        return self.run_end[j] + moved, self.agree[j] - moved

    def later_matches(self, length: int) -> np.ndarray:
        """Positions whose `length` bytes also start earlier in the text."""
        here, there = [], []
        for start in range(0, self.size, STREAM):
            other, agree = self.matching_statistics(start, min(start + STREAM, self.size))
            long = np.flatnonzero(agree >= length)
            here.append(long + start)
            there.append(other[long])
        here, there = np.concatenate(here), np.concatenate(there)
        members = np.unique(np.concatenate([here, there]))
        up = np.arange(len(members))
        up[np.searchsorted(members, here)] = np.searchsorted(members, there)
        while True:  # to the first suffix of each group, in doubling steps
            further = up[up]
            if np.array_equal(further, up):
                break
            up = further
        first = np.full(len(members), self.size)
        np.minimum.at(first, up, members)
        return members[members != first[up]]


def staying_segments(rows: DataFrame, length: int) -> DataFrame:
    """cls, start, gone: the first place of each distinct segment, with the runs of its windows that start earlier elsewhere.

    gone is a flat list of run starts and ends, counted from the segment's first
    window. Later places of a segment do not appear: all their windows go. The
    input is dealt by anchor; a task indexes about BLOCK_BYTES at a time, or one
    anchor's distinct segments if these are more.
    """

    def work(batches):
        parts: list[bytes] = []
        owners: list[tuple[int, int]] = []
        size, group, anchor = 0, {}, None

        def take():
            """Hand the finished anchor's segments to the block."""
            nonlocal size
            for segment, owner in group.items():
                parts.append(segment)
                owners.append(owner)
                size += len(segment) + 1

        def index():
            gone = [[] for _ in parts]
            if parts:
                found = RunLengthIndex(parts).later_matches(length)
                starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
                mark = np.zeros(int(starts[-1]), bool)
                mark[found] = True
                a, b = run_bounds(mark)
                part = np.searchsorted(starts, a, "right") - 1
                for i, x, y in zip(part.tolist(), (a - starts[part]).tolist(), (b - starts[part]).tolist(), strict=True):
                    gone[i] += [x, y]
            return [(cls, start, g) for (cls, start), g in zip(owners, gone, strict=True)]

        def batch_of(out):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int32()))],
                ["cls", "start", "gone"],
            )

        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("anchor", "cls", "start", "segment"))
            for name, cls, start, segment in zip(*columns, strict=True):
                if name != anchor:
                    take()
                    if size >= BLOCK_BYTES:
                        out += index()
                        parts, owners, size = [], [], 0
                    group, anchor = {}, name
                group.setdefault(segment, (cls, start))
            yield batch_of(out)
        take()
        yield batch_of(index())

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "doc", "start")
    return dealt.select("anchor", "cls", "start", "segment").mapInArrow(work, "cls long, start long, gone array<int>")


def removed_bytes(size: int, shared: list[int], stays: dict[int, list[int]], length: int) -> np.ndarray:
    """True for the bytes of a text that go."""
    edge = np.zeros(size + 1, np.int64)
    for place in shared:
        start, count = place >> 13, place & 8191
        runs = stays.get(start, [0, count])
        for a, b in zip(runs[::2], runs[1::2], strict=True):
            edge[start + a] += 1
            edge[start + b - 1 + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept binary: one row per row of `docs`.

    Null texts are empty. Rows without an id come after all others; rows with one
    id count as starting at the same place, so equal rows keep or lose the same
    bytes. Distinct texts are told apart by a 64-bit hash. Other columns of
    `docs` are not looked at; no rows give no rows.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    docs = docs.withColumn("cls", F.xxhash64("text"))
    classes = materialize(docs.groupBy("cls").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first_doc")))

    # anchors met in more than one place: known inside a task, or from two texts or places that differ
    met = anchor_rows(docs, length)
    sides = met.groupBy("key").agg(F.min("cls").alias("c1"), F.max("cls").alias("c2"), F.min("place").alias("p1"), F.max("place").alias("p2"), F.max("known").alias("any"))
    sides = sides.filter("any OR c1 != c2 OR p1 != p2").select("key")
    places = met.join(sides, "key").groupBy("cls").agg(F.collect_set(F.struct("anchor", "place")).alias("shared"))
    places = materialize(places)

    texts = packed_texts(docs, once=True).drop("doc_id").join(places, "cls").join(classes, "cls")
    stays = staying_segments(segment_texts(texts, length), length)
    kept = stays.groupBy("cls").agg(F.collect_list(F.struct("start", "gone")).alias("stays"))
    plans = materialize(places.select("cls", F.col("shared.place").alias("shared")).join(kept, "cls", "left"))
    whole = packed_texts(docs, once=False).join(classes, "cls").join(plans, "cls", "left")

    def work(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = []
                columns = (part.column(c).to_pylist() for c in ("doc_id", "first_doc", "packed", "shared", "stays"))
                for doc_id, first_doc, packed, shared, stay in zip(*columns, strict=True):
                    data = unpack.decompress(packed)
                    if (LAST if doc_id is None else doc_id) > first_doc:
                        gone = np.full(len(data), len(data) >= length)
                    else:
                        gone = removed_bytes(len(data), shared or [], {s["start"]: s["gone"] for s in stay or []}, length)
                    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    out.append((doc_id, len(data), int(gone.sum()), len(run_bounds(gone)[0]), left))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    columns = whole.select("doc_id", "first_doc", "packed", "shared", "stays")
    return columns.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

