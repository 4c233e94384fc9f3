"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs,
digits, plus signs, URL schemes and the cue words of identifiers. From each
anchor a small deterministic parser expands to both sides, stops at the first
character that cannot belong, and validates what it has (label structure, octet
range, digit counts, Luhn and mod-97 checksums). No pattern runs over whole text.

Kinds, in report order:

email    local part @ domain with at least one dot
ip       four dotted numbers of at most 255
card     16 to 19 digits, single spaces or hyphens between, passing Luhn
phone    + and 8 to 15 digits, with spaces, dots, brackets and hyphens
account  an IBAN passing mod 97, or an access key id (AKIA or ASIA and 16 capitals or digits)
secret   the value after a cue such as password and = or :, with blanks and quotes around the sign, of 6 characters or more
login    user:password of a URL that carries one
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "account", "secret", "login")
BASE_KINDS = KINDS[:4]

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = frozenset("0123456789")
_ALNUM = frozenset(_LETTERS + _LETTERS.lower()) | _DIGITS
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_CAPITAL = frozenset(_LETTERS) | _DIGITS
_STOP = frozenset(" \t\n\x0b\x0c\r\"'<>,;")
_BLANK = frozenset(" \t")
_AROUND = _BLANK | frozenset("\"'\\")

# Cue words before a secret, access key prefixes, country codes and lengths of account numbers.
SECRET_CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey")
KEY_CUES = ("AKIA", "ASIA")
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def automaton() -> ahocorasick.Automaton:
    """Anchor text to (class, length)."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for digit in _DIGITS:
        found.add_word(digit, ("digit", 1))
    for cue in SECRET_CUES:
        for spelled in (cue, cue.upper(), cue.capitalize()):
            found.add_word(spelled, ("secret", len(cue)))
    for cue in KEY_CUES:
        found.add_word(cue, ("key", 4))
    for country in IBAN_LENGTHS:
        for tens in "0123456789":
            found.add_word(country + tens, ("iban", 3))
    found.make_automaton()
    return found


def run_right(text: str, at: int, allowed: frozenset, limit: int | None = None) -> int:
    """The end of the run of allowed characters that starts at `at`, not after `limit`."""
    end = len(text) if limit is None else min(limit, len(text))
    while at < end and text[at] in allowed:
        at += 1
    return at


def run_left(text: str, at: int, allowed: frozenset, floor: int) -> int:
    """The start of the run of allowed characters that ends before `at`, not before `floor`."""
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    found, floor = [], 0
    for at in anchors:
        if at < floor:
            continue
        start = run_left(text, at, _LOCAL, floor)
        end = run_right(text, at + 1, _LABEL)
        if start == at or end == at + 1:
            continue
        dots = 0
        while end < len(text) and text[end] == ".":
            after = run_right(text, end + 1, _LABEL)
            if after == end + 1:
                break
            end, dots = after, dots + 1
        if dots:
            found.append((start, end))
            floor = end
    return found


def number_runs(anchors: list[int]) -> list[tuple[int, int]]:
    """Digit positions as maximal runs (start, end)."""
    runs = []
    for at in anchors:
        if runs and runs[-1][1] == at:
            runs[-1][1] = at + 1
        else:
            runs.append([at, at + 1])
    return [(a, b) for a, b in runs]


def addresses(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Four runs joined by single dots, taken from the left; a match with a part above 255 is dropped."""
    found, chain = [], []
    for run in runs:
        if chain and not (run[0] == chain[-1][1] + 1 and text[run[0] - 1] == "."):
            chain = []
        chain.append(run)
        if len(chain) == 4:
            parts = [text[a:b].lstrip("0") for a, b in chain]
            if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
                found.append((chain[0][0], chain[3][1]))
            chain = []
    return found


def cards(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal chains of runs with one space or hyphen between."""
    found, start, end, count = [], 0, -2, 0

    def close():
        if 16 <= count <= 19 and luhn("".join(c for c in text[start:end] if c in _DIGITS)):
            found.append((start, end))

    for a, b in runs:
        if a == end + 1 and text[end] in " -":
            end, count = b, count + b - a
        else:
            close()
            start, end, count = a, b, b - a
    close()
    return found


def phones(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    found, floor = [], 0
    for at in anchors:
        if at < floor or at + 1 >= len(text) or text[at + 1] not in _DIGITS:
            continue
        end = run_right(text, at + 2, _PHONE)
        while text[end - 1] not in _DIGITS:
            end -= 1
        if end < at + 4:
            continue
        floor = end
        if 8 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
            found.append((at, end))
    return found


def accounts(text: str, keys: list[int], ibans: list[int]) -> list[tuple[int, int]]:
    """Anchors are the starts of the cues; the boundaries on both sides must not be letters or digits."""
    found = []
    for at in keys:
        end = run_right(text, at + 4, _CAPITAL, at + 21)
        if end - at == 20 and not (at and text[at - 1] in _ALNUM) and not (end < len(text) and text[end] in _ALNUM):
            found.append((at, end))
    for at in ibans:
        if at and text[at - 1] in _ALNUM:
            continue
        wanted, end, kept = IBAN_LENGTHS[text[at : at + 2]], at, []
        while end < len(text) and len(kept) < wanted:
            if text[end] in _CAPITAL:
                kept.append(text[end])
            elif not (text[end] == " " and len(kept) % 4 == 0 and kept):
                break
            end += 1
        if len(kept) == wanted and not (end < len(text) and text[end] in _ALNUM):
            if int("".join(str(int(c, 36)) for c in kept[4:] + kept[:4])) % 97 == 1:
                found.append((at, end))
    return sorted(found)


def secrets(text: str, ends: list[int]) -> list[tuple[int, int]]:
    """`ends` are the positions after a cue; blanks and quotes may stand around its sign. A value in quotes runs to the closing one, another to white space or a quote."""
    found, floor = [], 0
    for at in ends:
        at = run_right(text, at, _AROUND)
        if at < floor or at == len(text) or text[at] not in "=:":
            continue
        start = run_right(text, at + 1, _BLANK)
        end = -1
        opens = run_right(text, start, frozenset("\\"))
        if opens < len(text) and text[opens] in "\"'":  # escaped quotes, as in JSON inside JSON, are closed by such
            closing, start = text[start : opens + 1], opens + 1
            end = quoted(text, start, closing)
        if end < 0:
            end = start
            while end < len(text) and text[end] not in _STOP:
                end += 1
        if end - start >= 6:
            found.append((start, end))
            floor = end
    return found


def quoted(text: str, at: int, closing: str) -> int:
    """Where the quote that opened before `at` is closed on its line; -1 if it is not."""
    while at < len(text) and text[at] not in "\r\n":
        if text.startswith(closing, at):
            return at
        at += 2 if text[at] == "\\" else 1
    return -1


def logins(text: str, ends: list[int]) -> list[tuple[int, int]]:
    """user:password between a scheme and an at-sign."""
    found = []
    for at in ends:
        end, colon = at, False
        while end < len(text) and text[end] not in _STOP and text[end] not in "/@":
            colon = colon or text[end] == ":"
            end += 1
        if colon and end < len(text) and text[end] == "@" and end > at:
            found.append((at, end))
    return found


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text in code points, by kind as listed, then start."""
    at = {"at": [], "plus": [], "scheme": [], "digit": [], "secret": [], "key": [], "iban": []}
    for last, (kind, length) in anchors.iter(text):
        at[kind].append(last + 1 if kind in ("scheme", "secret") else last + 1 - length)
    runs = number_runs(at["digit"])
    spans = {
        "email": emails(text, at["at"]), "ip": addresses(text, runs), "card": cards(text, runs), "phone": phones(text, at["plus"]),
        "account": accounts(text, at["key"], at["iban"]), "secret": secrets(text, at["secret"]), "login": logins(text, at["scheme"]),
    }
    return [(kind, start, end) for kind in KINDS for start, end in spans[kind]]


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans in text order; where some overlap, one that covers them all under the first one's kind."""
    out = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), -s[2])):
        if out and start < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(end, out[-1][2]))
        else:
            out.append((kind, start, end))
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    parts, at = [], 0
    for kind, start, end in merged(spans):
        parts += [text[at:start], f"<{kind}>"]
        at = end
    return "".join(parts) + text[at:]


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, spans array<struct<kind, start, end>>; with `with_text` also clean_text.

    One row per row of `docs`, repeated rows included. A null text counts as
    empty and has no spans; its clean_text is null. Null ids pass through. Other
    columns are not looked at. A map over rows: nothing is shuffled.
    """
    fields = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", spans array<struct<kind: string, start: int, end: int>>"
    fields += ", clean_text string" if with_text else ""
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches):
        anchors = automaton()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column("text").to_pylist()
                spans = [find_spans(t, anchors) if t else [] for t in texts]
                columns = {"doc_id": part.column("doc_id")}
                for kind in BASE_KINDS:
                    columns[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in row) for row in spans], pa.int64())
                columns["spans"] = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in spans], spans_type)
                if with_text:
                    columns["clean_text"] = pa.array(
                        [redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string()
                    )
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(work, fields)


def span_list(spans, kinds: tuple[str, ...]):
    """Column: kind:start:end of the given kinds, comma-joined."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with every span of personal data replaced in the text; all columns and rows stay.

    The columns besides the text travel through the Python workers unread.
    Rows with a null text pass unchanged.
    """
    at = docs.columns.index(text_column)

    def work(batches):
        anchors = automaton()
        for batch in batches:
            texts = [redact(t, find_spans(t, anchors)) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(work, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of `personal_data`'s rows: base_sha256 and spans as text."""
    base, every = span_list(F.col("spans"), BASE_KINDS), span_list(F.col("spans"), KINDS)
    return found.select("doc_id", *[f"n_{k}" for k in BASE_KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))

