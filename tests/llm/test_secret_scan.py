"""Secret scans against counting every window anew."""

import hashlib
import math
import random
import re
import string
import time
from collections import Counter

from touchline.llm import secret_scan

BASE64 = string.ascii_letters + string.digits + "+/_-"


def entropy(window):
    return math.log2(len(window)) - sum(c * math.log2(c) for c in Counter(window).values()) / len(window)


def hot_by_hand(text, window, bits):
    covered = set()
    for at in range(len(text) - window + 1):
        if entropy(text[at : at + window]) >= bits - 1e-9:
            covered.update(range(at, at + window))
    runs = []
    for at in sorted(covered):
        if runs and runs[-1][1] == at:
            runs[-1][1] = at + 1
        else:
            runs.append([at, at + 1])
    return [tuple(r) for r in runs]


def base_by_hand(text):
    found = [
        ("assign", m.start(), m.end())
        for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m.group(2)) >= 8
    ]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_windows_match_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        alphabet = rng.choice([BASE64, "ab", "abcdefgh", string.hexdigits, string.ascii_lowercase])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) + rng.choice(["", "a" * 40])
        window, bits = rng.choice([(8, 2.5), (24, 3.85), (32, 3.2), (1, 0.0), (5, math.log2(5))])
        # all equal counts make the limit itself: equal sums, equal verdicts
        assert secret_scan.random_spans(text.encode(), window, bits) == hot_by_hand(text, window, bits) or bits == math.log2(5)


def random_text(rng):
    parts = ["password", "PassWD", "api_key", "apikey", "TOKEN", "secret", "\u017fecret", "to\u212aen", "=", ":", '"', "'", " ", "  ", "AKIA", "ASIA", "\n", "é", ".", "-"]
    parts += ["AKIA" + "A7" * 6, "AKIA" + "A7" * 5, "deadbeef" * 4, "deadbeef" * 3, "abcd1234", "short", "a=b=c=d=e", "0" * 40]
    parts += ["".join(rng.choices(BASE64, k=rng.randint(20, 60))), "".join(rng.choices("0123456789ABCDEF", k=40)), "word-and-other-words-in-a-row-joined"]
    return "".join(rng.choices(parts, k=rng.randint(0, 25)))


def test_base_spans_stay_whatever_else_is_found():
    rng, scanner = random.Random(6), secret_scan.Scanner()
    kinds = Counter()
    for _ in range(4000):
        text = random_text(rng)
        spans = scanner.spans(text)
        assert [s for s in spans if s[0] in secret_scan.BASE_KINDS] == base_by_hand(text)
        assert spans == sorted(spans, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
        kinds.update(s[0] for s in spans)
        for kind, start, end in spans:
            if kind.startswith("entropy"):
                entry = next(c for c in secret_scan.CLASSES if c.kind == kind)
                assert re.fullmatch(f"[{entry.characters}]+", text[start:end]) and end - start >= entry.window
    assert set(kinds) == set(secret_scan.KINDS)


def test_no_retry_inside_a_dropped_match():
    spans = secret_scan.Scanner().spans
    assert spans("secret:token:abcdefgh") == []  # the first match, its value too short, takes the second name
    assert spans("token = 'abcdefgh'") == [("assign", 0, 17)]
    assert spans("\u017fecret=abcdefgh to\u212aen=abcdefgh") == []  # long s and Kelvin sign are not ASCII letters


def test_public_forms_are_suppressed():
    spans = secret_scan.Scanner().spans
    key = "q7Zt0RkV2mXb9LsYc4JdWf8H"
    assert spans(key) == [("entropy_base64", 0, 24)]
    assert spans(f"see {key}; ") == [("entropy_base64", 4, 28)]
    for public in (
        "123e4567-e89b-12d3-a456-426614174000", f"sha256-{key}", f"https://host/path/{key}", "AbstractSingletonProxyFactoryBeanWithLongName",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "2024-01-05/2024-09-17_2025-11-30", f"{key}EXAMPLE",
    ):
        assert spans(public) == [], public
    assert spans(f"https://host/path?k={key}") and spans(f"https://user@host/{key}")
    assert secret_scan.Scanner(allowed=()).spans("AbstractSingletonProxyFactoryBeanWithLongName")
    assert secret_scan.Scanner(allowed=(key,)).spans(key) == []


def test_prose_has_no_spans():
    rng = random.Random(8)
    words = ["the", "Of", "character", "istic", "and", "overly", "2024", "counter", "revolution", "aries"]
    text = " ".join(rng.choice(["-", "_", "/"]).join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(3000))
    assert secret_scan.Scanner().spans(text) == []


def test_long_texts_take_linear_time():
    rng = random.Random(9)
    scanner = secret_scan.Scanner()
    blob = "".join(rng.choices(BASE64, k=200_000))
    texts = [blob, "AKIA" * 50_000, "password" * 25_000, "password" + " " * 200_000, "a1b2c3d4" * 25_000, ("f" * 31 + "x") * 6_000, "x.y" * 60_000, (blob[:30] + ".") * 6_000]
    texts += ["".join(rng.choices(string.ascii_letters, k=200_000)) + "1", "sha256-" * 30_000 + blob, "a://" * 50_000 + blob, "-a1" * 60_000]
    for text in texts:
        began = time.perf_counter()
        scanner.spans(text)
        assert time.perf_counter() - began < 5, text[:40]


def test_rows_of_all_kinds(make):
    key = "q7Zt0RkV2mXb9LsYc4JdWf8H"
    rows = [(1, None), (2, ""), (3, f"é token=abcdefgh9 and {key}"), (3, f"é token=abcdefgh9 and {key}"), (None, "deadbeef" * 5), (4, "plain words")]
    found = secret_scan.find_secrets(make(rows), with_text=True)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_assign", "n_access", "n_hex", "clean_text").collect()), key=repr)
    assert got == sorted(
        [(1, 0, 0, 0, None), (2, 0, 0, 0, ""), (4, 0, 0, 0, "plain words"), (None, 0, 0, 1, "<hex>")]
        + [(3, 1, 0, 0, "é <assign> and <entropy_base64>")] * 2, key=repr,
    )
    digest = {r.doc_id: r for r in secret_scan.digests(found).collect()}
    assert digest[3].spans == "assign:2:17,entropy_base64:22:46"
    assert digest[3].base_sha256 == hashlib.sha256(b"assign:2:17").hexdigest()
    assert digest[1].spans == "" and digest[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.find_secrets(make([])).count() == 0


def test_registered_query_on_the_given_table(spark):
    from touchline.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op12_secrets"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = base_by_hand(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secret_scan.BASE_KINDS)
