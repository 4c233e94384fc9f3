"""Byte-level BPE encoding and decoding with a transducer lexicon.

Spark counts the words of the whole corpus; the most frequent ones are merged
once, and compiled with their ids into a minimal acyclic transducer
(`lexicon.py`). The compiled file goes to every executor, which memory-maps it.
Encoding then cuts a text into words, looks the words up in the transducer and
merges only those it does not hold, exactly by the vocabulary's merge ranks.

The vocabulary file is one of a public tokenizer, named by its path; nothing is
trained here.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Callable
from contextlib import contextmanager
from itertools import chain
from typing import Any

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from touchline.llm.lexicon import LONGEST_WORD, Lexicon, compile_lexicon
from touchline.session import write_shared
from touchline.sources.store import materialize, shared_folder

LEXICON_WORDS = 1 << 18
CHUNK_CHARS = 1 << 20
MEMO_WORDS = 100_000

# The word pattern of the vocabulary, with white space written out.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
# The same over the first 256 characters, where the classes can be listed.
_LETTER, _NUMBER, _BLANK = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_WORDS = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)


def words_of(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return WORDS.findall(text)
    return LATIN_WORDS.findall(text)


def byte_symbols() -> dict[str, int]:
    """The vocabulary's printable stand-in for each byte: itself where printable, else the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Vocabulary:
    """Tokens as bytes, merge ranks between ids, and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols = byte_symbols()
        ids = spec["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: bytes(symbols[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes.update({i: content.encode() for content, i in self.special.items()})
        self.single = [0] * 256
        for token, i in ids.items():
            if len(token) == 1:
                self.single[symbols[token]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank is merged, leftmost first, until none is left."""
        symbols = [self.single[b] for b in word]
        if len(symbols) > LONGEST_WORD:
            return self._merge_long(symbols)
        merges, nothing = self.merges, (1 << 60, 0)
        ranks = [merges.get(pair, nothing) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is nothing or best[0] == nothing[0]:
                break
            at = ranks.index(best)
            symbols[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = merges.get((symbols[at - 1], symbols[at]), nothing)
            if at < len(ranks):
                ranks[at] = merges.get((symbols[at], symbols[at + 1]), nothing)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, for words of any length."""
        n, merges = len(symbols), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(*merges[pair], i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in merges]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = new, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    pair = symbols[left], symbols[after[left]]
                    if pair in merges:
                        rank, made = merges[pair]
                        heapq.heappush(heap, (rank, left, made, *pair))
        return [s for s, here in zip(symbols, alive, strict=True) if here]

    def pieces(self, text: str) -> list[str]:
        """The text cut at special tokens, which stay as pieces of their own."""
        return self.parts.split(text) if self.parts else [text]


class Encoder:
    """Encodes batches of texts; remembers the words it has met, up to a bound.

    What it remembers of a word is `keep(ids)`, the ids themselves by default. When
    the memo is full it becomes the older one, and words found there move on to the
    new one: frequent words are never forgotten, the others are twice a bound later.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, keep: Callable[[list[int]], Any] = list):
        self.vocabulary, self.lexicon, self.keep = vocabulary, lexicon, keep
        self.memo: dict[str, Any] = {}
        self.older: dict[str, Any] = {}

    def _learn(self, words: set[str]) -> None:
        fresh = []
        for w in words - self.memo.keys():
            known = self.older.get(w)
            if known is None:
                fresh.append(w)
            else:
                self.memo[w] = known
        raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
        for word, data, ids in zip(fresh, raw, self.lexicon.find(raw), strict=True):
            self.memo[word] = self.keep(self.vocabulary.merge(data) if ids is None else ids)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, of an encoder that keeps ids."""
        return [list(chain.from_iterable(kept)) for kept in self.encode_words(texts)]

    def encode_words(self, texts: list[str]) -> list[list]:
        """What is kept of each word and special token, per text."""
        special, cut = self.vocabulary.special, []
        for text in texts:
            words: list = []
            for piece in self.vocabulary.pieces(text):
                if piece in special:
                    words.append(special[piece])
                elif piece:
                    words += words_of(piece)
            cut.append(words)
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        met = set(chain.from_iterable(cut))
        marks = {w for w in met if isinstance(w, int)}
        self._learn(met - marks)
        self.memo.update({w: self.keep([w]) for w in marks})
        found = [list(map(self.memo.__getitem__, words)) for words in cut]
        for w in marks:
            del self.memo[w]
        return found

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def chunks(column) -> list:
    """Rows of a text column in lists of about CHUNK_CHARS characters; nulls count as empty texts."""
    held, size = [], 0
    for text in column.to_pylist():
        held.append(text or "")
        size += len(text or "")
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """word, n: how often each word of up to 64 bytes occurs in all texts; counted in the tasks first."""

    def flush(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def work(batches):
        vocabulary, counts = Vocabulary(vocabulary_path), Counter()
        for batch in batches:
            for texts in chunks(batch.column("text")):
                for text in texts:
                    for piece in vocabulary.pieces(text):
                        if piece not in vocabulary.special:
                            counts.update(words_of(piece))
                if len(counts) > MEMO_WORDS:
                    yield flush(counts)
                    counts = Counter()
        yield flush(counts)

    met = docs.select("text").mapInArrow(work, "word string, n long")
    return met.filter(F.octet_length("word") <= LONGEST_WORD).groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary_path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of `docs`, at most `words` of them; returns the name of the file on the executors.

    The bound keeps the compiled file, which every executor gets, to a few
    megabytes; words outside are merged where they occur.
    """
    counts = materialize(word_counts(docs, vocabulary_path))
    capped = 1 << 16
    steps = counts.groupBy(F.least("n", F.lit(capped)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, total = capped + 1, 0
    for row in sorted(steps, key=lambda r: -r.n):
        total += row.words
        if total > words:
            break
        least = row.n
    frequent = counts.filter(F.col("n") >= max(least, 2)).select("word")

    def work(batches):
        vocabulary = Vocabulary(vocabulary_path)
        for batch in batches:
            merged = [vocabulary.merge(w.encode()) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(merged, pa.list_(pa.int32()))], ["word", "ids"])

    table = frequent.mapInArrow(work, "word string, ids array<int>").toArrow()
    pairs = sorted(zip([w.encode() for w in table["word"].to_pylist()], table["ids"].to_pylist(), strict=True))
    spark = docs.sparkSession
    uri = f"{shared_folder(spark)}/touchline/lexicon-{uuid.uuid4().hex}.bin"
    write_shared(uri, compile_lexicon([w for w, _ in pairs], [i for _, i in pairs]))
    spark.sparkContext.addFile(uri)
    return uri.rpartition("/")[2]


@contextmanager
def no_cycle_search():
    """Encoding makes very many lists and no cycles: looking for some takes a fifth of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def open_encoder(vocabulary_path: str, lexicon_name: str) -> Encoder:
    """On an executor: the vocabulary, and the lexicon mapped from the file that Spark brought."""
    return Encoder(Vocabulary(vocabulary_path), Lexicon.mapped(os.path.join(SparkFiles.getRootDirectory(), lexicon_name)))


def spelled_words(encoder: Encoder) -> Encoder:
    """The encoder, keeping of a word the number of its ids, their decimals joined by commas, and the bytes that they decode to."""
    table = encoder.vocabulary.token_bytes
    spelled = [str(i) for i in range(max(table) + 1)]
    encoder.keep = lambda ids: (len(ids), ",".join(map(spelled.__getitem__, ids)), b"".join(map(table.__getitem__, ids)))
    return encoder


def encoded(docs: DataFrame, vocabulary_path: str, lexicon_name: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids array<int>: one row per row of `docs`; null and empty texts have no ids. Other columns are not looked at."""

    def work(batches):
        encoder = open_encoder(vocabulary_path, lexicon_name)
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text")):
                ids = pa.array(encoder.encode(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), ids], ["doc_id", "ids"])
                at += len(texts)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; bytes that are no UTF-8 become replacement characters; null ids stay null."""

    def work(batches):
        table = Vocabulary(vocabulary_path).token_bytes
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [
                    None if ids is None else b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace") for ids in part.column("ids").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary_path: str, lexicon_name: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids and keeps only the digests.

    One row per row of `docs`, repeated rows included. A null text counts as empty:
    no tokens, and the digests of the empty text. Null ids pass through, other
    columns are not looked at, whatever their names. Texts are encoded whole. Ids
    are spelled and decoded once a word; a text's are its words' in a row.
    """

    def work(batches):
        encoder = spelled_words(open_encoder(vocabulary_path, lexicon_name))
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for texts in chunks(batch.column("text")):
                with no_cycle_search():
                    for words in encoder.encode_words(texts):
                        lengths, ids, data = zip(*words, strict=True) if words else ((), (), ())
                        counts.append(sum(lengths))
                        of_ids.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                        of_text.append(hashlib.sha256(b"".join(data).decode("utf-8", "replace").encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


NEW_COLUMNS = ("ids", "n_tokens", "round_trip")


def tokenized(docs: DataFrame, vocabulary_path: str, lexicon_name: str, text_column: str = "text") -> DataFrame:
    """`docs` without its text, plus ids, n_tokens and round_trip (whether the ids decode to the text); rows and other columns stay.

    A column of `docs` that has one of the three names, in whatever case, keeps its
    values under that name with underscores behind it, as many as make it a new
    one. Null and empty texts have no ids; their round_trip is true. Texts are
    encoded whole; repeated rows are rows of their own; no rows give no rows.
    """
    at = docs.columns.index(text_column)
    others = [c for c in docs.schema if c.name != text_column]
    taken = {c.name.lower() for c in others} | set(NEW_COLUMNS)
    for i, c in enumerate(others):
        if c.name.lower() in NEW_COLUMNS:
            name = c.name + "_"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            others[i] = StructField(name, c.dataType, c.nullable, c.metadata)

    def work(batches):
        encoder = open_encoder(vocabulary_path, lexicon_name)
        for batch in batches:
            start = 0
            for texts in chunks(batch.column(at)):
                part = batch.slice(start, len(texts))
                start += len(texts)
                with no_cycle_search():
                    ids = encoder.encode(texts)
                same = [encoder.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                columns = [c for i, c in enumerate(part.columns) if i != at]
                new = [pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*columns, *new], [*(c.name for c in others), *NEW_COLUMNS])

    schema = StructType([*others, *StructType.fromDDL("ids array<int>, n_tokens long, round_trip boolean")])
    return docs.mapInArrow(work, schema)
