"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (letters only, lower-cased) and their first 4, 5
and 6 bytes, hashed to buckets; inflected forms share prefixes. A chi-square
statistic counted by Spark over the labelled sample picks the buckets worth a
parameter. The machine then learns a weight and a factor vector for each of
them, so a score is linear weights plus pairwise interactions: an insult near a
group name may count for more than both alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.hashing import SLICE, prefix_sums, run_bounds, span_hashes
from touchline.sources.store import materialize

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)


@dataclass
class Model:
    """At most `features` buckets, each with a weight and `factors` numbers."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def places(self) -> np.ndarray:
        """Bucket to parameter row, -1 where there is none."""
        found = np.full(BUCKETS, -1, np.int32)
        found[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return found

    def score(self, rows: np.ndarray) -> float:
        """Probability of label 1 for the parameter rows of one text."""
        v = self.vectors[rows]
        raw = self.bias + self.weights[rows].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def term_buckets(text: str) -> np.ndarray:
    """Distinct buckets of a text's terms; whole text, in slices cut between words."""
    found, data = [], np.frombuffer(text.lower().encode(), np.uint8)
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):
            gaps = np.flatnonzero(~letter[end:])
            end = end + int(gaps[0]) if len(gaps) else len(data)
        starts, ends = run_bounds(letter[at:end])
        sums = prefix_sums(data[at:end])
        found.append(span_hashes(sums, starts, ends))
        for n in PREFIXES:
            long = ends - starts > n
            found.append(span_hashes(sums, starts[long], starts[long] + n) ^ np.uint64(n))
        at = end
    if not found:
        return np.zeros(0, np.int32)
    return np.unique((np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int32))


def _terms(batches):
    for batch in batches:
        terms = [term_buckets(t) if t else np.zeros(0, np.int32) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(terms, pa.list_(pa.int32()))], ["toxic", "terms"])


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 4_096, factors: int = 8, epochs: int = 30, seed: int = 11
) -> Model:
    """Fit on at most `sample` labelled documents, drawn by a hash of doc_id.

    The bound holds what is broadcast (ids and labels of the sample) and what
    comes to the driver: `features` buckets, and of each sampled document the
    buckets among these. Null labels, ids and texts take no part; a document
    with several labels has the largest. Without a positive or a negative
    example the model has no features and scores every text 0.
    """
    drawn = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    rows = materialize(labelled.mapInArrow(_terms, "toxic int, terms array<int>"))
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if positive == 0 or positive == n:
        return Model(np.zeros(0, np.int32), -30.0, np.zeros(0, np.float32), np.zeros((0, factors), np.float32))

    # chi-square of term against label, from counts
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    expected = F.col("n") * (positive / n)
    chi = (F.abs(F.col("k") - expected) - 0.5) ** 2 / (expected * (1 - positive / n))
    picked = counts.filter("n >= 3").select("term", chi.alias("chi")).filter("chi > 6").orderBy(F.desc("chi"), "term").limit(features)
    buckets = np.sort(np.array([r.term for r in picked.collect()], np.int32))
    kept = F.array_sort(F.array_intersect("terms", F.from_json(F.lit(str(buckets.tolist())), "array<int>")))
    table = rows.select("toxic", kept.alias("terms")).toArrow()
    y = table["toxic"].to_numpy().astype(np.float32)
    lists = table["terms"].combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return train(y, offsets, np.searchsorted(buckets, flat), buckets, factors, epochs, seed)


def train(y, offsets, flat, buckets, factors: int, epochs: int, seed: int) -> Model:
    """Logistic loss, AdaGrad over small batches, decay on used parameters.

    Half of the documents of a batch show only a third of their terms, so that no
    term leans on company it may lack elsewhere. The weights alone learn in the first third of the epochs, so that one term is
    enough where it should be; the factors then learn what weights cannot say.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    size = len(buckets)
    weights, vectors = np.zeros(size), rng.normal(0, 0.01, (size, factors))
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, factors), 1e-6), 1e-6
    rate, decay, width = 0.1, (1e-6, 1e-4), 64
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), width):
            chosen = order[at : at + width]
            lengths = offsets[chosen + 1] - offsets[chosen]
            doc = np.repeat(np.arange(len(chosen)), lengths)
            f = flat[np.repeat(offsets[chosen], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)]
            stays = rng.random(len(f)) < np.where(rng.random(len(chosen)) < 0.5, 1.0, 0.3)[doc]
            doc, f = doc[stays], f[stays]
            v = vectors[f]
            total, squares = np.zeros((len(chosen), factors)), np.zeros((len(chosen), factors))
            np.add.at(total, doc, v)
            np.add.at(squares, doc, v**2)
            raw = bias + np.bincount(doc, weights[f], len(chosen)) + 0.5 * (total**2 - squares).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[chosen]) / len(chosen)
            used, at_used = np.unique(f, return_inverse=True)
            gw = np.bincount(at_used, error[doc], len(used)) + decay[0] * weights[used]
            seen_w[used] += gw**2
            seen_b += error.sum() ** 2
            weights[used] -= rate * gw / np.sqrt(seen_w[used])
            bias -= rate * error.sum() / np.sqrt(seen_b)
            if 3 * epoch < epochs:
                continue
            gv = np.zeros((len(used), factors))
            np.add.at(gv, at_used, error[doc, None] * (total[doc] - v))
            gv += decay[1] * vectors[used]
            seen_v[used] += gv**2
            vectors[used] -= rate * gv / np.sqrt(seen_v[used])
    return Model(buckets, bias, weights.astype(np.float32), vectors.astype(np.float32))


def scores(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score: one row per row of `docs`; null and empty texts get the score of no terms."""

    def work(batches):
        places = model.places()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                rows = places[term_buckets(text)] if text else np.zeros(0, np.int32)
                out.append(model.score(rows[rows >= 0]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(work, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of `docs` that score below the threshold, with all their columns."""
    at = docs.columns.index(text_column)

    def work(batches):
        places = model.places()
        for batch in batches:
            keep = []
            for text in batch.column(at).to_pylist():
                rows = places[term_buckets(text)] if text else np.zeros(0, np.int32)
                keep.append(model.score(rows[rows >= 0]) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def training_rows(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out third: crc32 of the id as text, modulo 3, is not 1."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
