"""Secrets by the entropy of sliding windows.

Known forms (an assignment to a secret's name, an access key id, a long
hexadecimal run) are found by pattern. What has no known form is found by its
randomness: over each candidate string of a character class a window slides one
character at a time; the window's counts are changed by the character that
enters and the one that leaves, and its Shannon entropy with them. Windows at or
above the class's limit are joined into spans. An allow list suppresses spans of
forms that look random and are public.

Sums are integers of 32 fractional bits, so that a window's entropy is the same
whichever way the window got there.

Kinds, in report order:

assign          name, sign and a value of 8 characters or more
access          AKIA and capitals or digits, 16 characters or more
hex             32 lower-case hexadecimal digits or more
entropy_hex     windows of hexadecimal digits of either case
entropy_base64  windows of the base64 alphabets (the common and the URL-safe one)
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The forms of known secrets. (?ai:...) is: ASCII letters in either case.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Shorter runs of these digits are dropped whatever stands around them, so the least length can stand in the pattern.
HEX = re.compile(r"[0-9a-f]{32,}")

BASE_KINDS = ("assign", "access", "hex")
SCALE = 1 << 32


@dataclass(frozen=True)
class CharacterClass:
    """A class of characters whose runs are candidates, the window over them and its least entropy in bits a character."""

    kind: str
    characters: str
    window: int
    bits: float


#: A random window has about 3.6 bits (hex, 32) and 4.2 bits (base64, 24); words joined by hyphens or capitals stay below.
CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", 32, 3.2),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_-", 24, 3.85),
)
KINDS = BASE_KINDS + tuple(c.kind for c in CLASSES)

# Public forms. A span is suppressed if one of these matches it whole, or with the run of non-blanks that ends at its end.
ALLOWED = (
    r"[^0-9]*",  # names and words, no digit
    r"[-_+/]*([A-Za-z]+|[0-9]+)([-_+/]+([A-Za-z]+|[0-9]+))*[-_+/]*",  # numbers, dates, words and numbers with signs between
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # UUID
    r".*sha(1|224|256|384|512)[-:][A-Za-z0-9+/_-]*",  # digests that say so
    r".*[A-Za-z]://[^?#@]*",  # hosts and paths of a URL; not its query, fragment or login
    r".*(?i:example|abcdefghijkl|0123456789|placeholder|xxxxxxxx).*",
)
#: How far before a span its run of non-blanks is looked at.
CONTEXT = 256


def weights(window: int) -> list[int]:
    """count * log2(count) for counts up to the window's length."""
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]


def random_spans(candidate: bytes, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined windows of `candidate` whose entropy is `bits` or more.

    The entropy of a window of n is log2(n) - sum(count * log2(count)) / n, so
    the sum is kept and compared; each step changes two counts.
    """
    if len(candidate) < window:
        return []
    weight = weights(window)
    most = math.floor(window * (math.log2(window) - bits) * SCALE)
    counts, total, found = [0] * 256, 0, []
    for at, entering in enumerate(candidate):
        if at >= window:
            leaving = candidate[at - window]
            have = counts[leaving]
            total += weight[have - 1] - weight[have]
            counts[leaving] = have - 1
        have = counts[entering]
        total += weight[have + 1] - weight[have]
        counts[entering] = have + 1
        if at >= window - 1 and total <= most:
            start = at - window + 1
            if found and start <= found[-1][1]:
                found[-1][1] = at + 1
            else:
                found.append([start, at + 1])
    return [(a, b) for a, b in found]


class Scanner:
    """The patterns of one worker."""

    def __init__(self, classes: Iterable[CharacterClass] = CLASSES, allowed: Iterable[str] = ALLOWED):
        self.classes = [(c, re.compile(f"[{c.characters}]{{{c.window},}}")) for c in classes]
        self.allowed = re.compile("|".join(f"(?:{form})" for form in allowed) or r"(?!)", re.DOTALL)
        self.order = {kind: i for i, kind in enumerate(BASE_KINDS + tuple(c.kind for c, _ in self.classes))}

    def is_allowed(self, text: str, start: int, end: int) -> bool:
        if self.allowed.fullmatch(text, start, end):
            return True
        before = text[max(0, start - CONTEXT) : start]
        blank = max(before.rfind(c) for c in " \t\n\r\"'<>()")
        return blank < len(before) - 1 and bool(self.allowed.fullmatch(before[blank + 1 :] + text[start:end]))

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All (kind, start, end) in code points, by start, then kind as listed. Entropy spans inside a known form are left to it."""
        known = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
        known += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        known += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        known.sort(key=lambda s: (s[1], self.order[s[0]]))
        covered = covers(known)
        found = list(known)
        for kind, pattern in self.classes:
            for m in pattern.finditer(text):
                for a, b in random_spans(m.group().encode("ascii"), kind.window, kind.bits):
                    start, end = m.start() + a, m.start() + b
                    if not inside(covered, start, end) and not self.is_allowed(text, start, end):
                        found.append((kind.kind, start, end))
        return sorted(found, key=lambda s: (s[1], self.order[s[0]]))


def covers(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the joined spans; `spans` are sorted by start."""
    starts, ends = [], []
    for _, start, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def inside(covered: tuple[list[int], list[int]], start: int, end: int) -> bool:
    at = bisect_right(covered[0], start) - 1
    return at >= 0 and end <= covered[1][at]


def find_secrets(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    classes: tuple[CharacterClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
    with_text: bool = False,
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, spans array<struct<kind, start, end>>; with `with_text` also clean_text.

    One row per row of `docs`, repeated rows included. A null text counts as
    empty and has no spans; its clean_text is null. Null ids pass through. Other
    columns are not looked at, whatever their names. No rows give no rows. Work
    and memory grow with a text's length, also for one candidate as long as the
    text. A map over rows: nothing is shuffled.

    In clean_text each run of overlapping spans is replaced by the kind of the
    first in angle brackets.
    """
    fields = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", spans array<struct<kind: string, start: int, end: int>>"
    fields += ", clean_text string" if with_text else ""
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches):
        scanner = Scanner(classes, allowed)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column("text").to_pylist()
                spans = [scanner.spans(t) if t else [] for t in texts]
                columns = {"doc_id": part.column("doc_id")}
                for kind in BASE_KINDS:
                    columns[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in row) for row in spans], pa.int64())
                columns["spans"] = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in spans], spans_type)
                if with_text:
                    columns["clean_text"] = pa.array([redact(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(work, fields)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """`spans` are sorted by start."""
    parts, at, last = [], 0, -1
    for kind, start, end in spans:
        if start >= last:
            parts += [text[at:start], f"<{kind}>"]
        at = last = max(last, end)
    return "".join(parts) + text[at:] if parts else text


def joined(spans):
    """Column: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of `find_secrets`' rows: base_sha256, and spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[f"n_{k}" for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
