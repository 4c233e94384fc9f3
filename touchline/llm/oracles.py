"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations


def field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def merkle_levels(name: str, count: int, fanout: int = 16) -> str:
    """CTEs name0 ... name<count>: t, node, n, digest, and the joined siblings of each node; name0's own columns come from name."""
    siblings = f"""
        CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(digest, '') OVER (PARTITION BY t, node // {fanout} ORDER BY node
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS before,
        CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(digest, '') OVER (PARTITION BY t, node // {fanout} ORDER BY node
            ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS after"""
    parts = [f"{name}0 AS (SELECT t, node, n, digest, {siblings} FROM {name})"]
    for k in range(1, count + 1):
        parts.append(
            f"""{name}{k} AS (SELECT t, node, n, digest, {siblings} FROM (
                SELECT t, node // {fanout} AS node, any_value((n + {fanout - 1}) // {fanout}) AS n,
                    CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY node)) END AS digest
                FROM {name}{k - 1} GROUP BY t, node // {fanout}))"""
        )
    return ",\n".join(parts)


def manifest(levels: int = 7, group_levels: int = 4) -> str:
    """Trees of up to 16**levels leaves under 16**group_levels sources."""
    names = ("doc_id", "source", "lang", "n_chars", "text")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = " || ".join(field(c) for c in names)
    changed = " || ".join(field(lower if c == "text" else c) for c in names)
    steps = [("a", k, f"leaf_row.place // {16**k}", "leaf_row.t") for k in range(levels)] + [("b", k, f"g.node // {16**k}", "''") for k in range(group_levels)]
    joins = "\n".join(f"JOIN {s}{k} AS {s}_{k} ON {s}_{k}.t = {t} AND {s}_{k}.node = {node}" for s, k, node, t in steps)
    folds, value = [], "leaf_row.claim"
    for s, k, _, _ in steps:
        folds.append(f"CASE WHEN {s}_{k}.n = 1 THEN {value} ELSE sha256({s}_{k}.before || {value} || {s}_{k}.after) END AS f_{s}{k}")
        value = f"f_{s}{k}"
    proof = " || ".join(f"{s}_{k}.before || {s}_{k}.after" for s, k, _, _ in steps)
    return f"""
    WITH crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps
    ), flagged AS (
        SELECT d.*, coalesce('+' || source, '-') AS t,
            xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda b: ascii(b)::BIGINT)),
                lambda c, b: xor(crc.steps[(xor(c, b) & 255) + 1], c >> 8))) % 5 = 0 AS tampered
        FROM documents AS d, crc
    ), hashed AS (
        SELECT doc_id, source, t, sha256({leaf}) AS leaf, CASE WHEN tampered THEN sha256({changed}) ELSE sha256({leaf}) END AS claim FROM flagged
    ), leaves AS (
        SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY t) AS n FROM hashed
    ), a AS (SELECT t, place AS node, n, leaf AS digest FROM leaves),
    {merkle_levels("a", levels)},
    sources AS (SELECT DISTINCT t, source FROM hashed),
    g AS (
        SELECT s.t, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS node, count(*) OVER () AS n, digest
        FROM sources AS s JOIN a{levels} AS r ON r.t = s.t
    ), b AS (SELECT '' AS t, node, n, digest FROM g),
    {merkle_levels("b", group_levels)},
    folded AS (
        SELECT leaf_row.doc_id, leaf_row.leaf, g.digest AS subroot, top.digest AS root, sha256({proof}) AS proof_sha256,
            {", ".join(folds)}
        FROM leaves AS leaf_row JOIN g ON g.t = leaf_row.t
        {joins}
        CROSS JOIN b{group_levels} AS top
    )
    SELECT doc_id, leaf, subroot, root, proof_sha256, {value} AS folded_root, {value} = root AS verified FROM folded
    """


WARC = """
    WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    hashed AS (
        SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS first FROM payloads
    ), fives AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, (5 * i + 1)::BIGINT, 5))::BIGINT) AS five FROM hashed)
    SELECT page_id, payload_bytes,
        array_to_string(list_transform(five, lambda v: array_to_string(list_transform([15, 10, 5, 0],
            lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to
    FROM fives
"""

# Sources in turn weigh 1, 2, 3; levels of filling; then size-proportional inclusion and the prefix by rank nearest to what lacks.
MIX = """
    WITH sizes AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
    ), totals AS (
        SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sizes GROUP BY source
    ), levels AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM totals WINDOW f AS (ORDER BY source_size * 3 / w, source NULLS LAST)
    ), targets AS (
        SELECT source, source_size, least(source_size * 3.0::DOUBLE, max(level) OVER () * w) AS target FROM levels
    ), plans AS (
        SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM targets
    ), lacking AS (
        SELECT *, CASE WHEN whole < 3 THEN target - whole * source_size ELSE 0 END AS lack FROM plans
    ), counts AS (SELECT source, size, size * count(*) AS words FROM sizes WHERE size > 0 GROUP BY source, size
    ), tried AS (
        SELECT p.source, p.lack, c.size, sum(c.size::DOUBLE * c.words) OVER (s ROWS UNBOUNDED PRECEDING) AS squares,
            coalesce(sum(c.words) OVER (s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS sure, lead(c.size) OVER s AS next
        FROM counts AS c JOIN lacking AS p ON c.source IS NOT DISTINCT FROM p.source AND p.lack > 0
        WINDOW s AS (PARTITION BY p.source ORDER BY c.size)
    ), scales AS (
        SELECT source, arg_min(squares / (lack - sure), size) AS scale, arg_min(sure, size) AS sure, any_value(lack) AS lack
        FROM tried WHERE lack > sure AND (next IS NULL OR squares / (lack - sure) <= next) GROUP BY source
    ), drawn AS (
        SELECT z.doc_id, z.source, z.size, s.lack - s.sure AS lack, z.size / s.scale AS p,
            (('0x' || substr(md5('3:' || coalesce(z.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
        FROM sizes AS z JOIN scales AS s ON z.source IS NOT DISTINCT FROM s.source AND z.size > 0 AND z.size < s.scale
    ), ranked AS (
        SELECT *, (u / (1 - u)) / (p / (1 - p)) AS rank FROM drawn
    ), summed AS (
        SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST, size) AS upto FROM ranked
    ), ends AS (
        SELECT DISTINCT source, upto, abs(upto - lack) AS miss FROM summed UNION ALL SELECT source, 0, any_value(lack) FROM summed GROUP BY source
    ), cuts AS (SELECT source, upto FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss, (upto = 0), upto) AS k FROM ends) WHERE k = 1
    ), taken AS (
        SELECT DISTINCT s.doc_id, s.source, s.size FROM summed AS s JOIN cuts AS c ON s.source IS NOT DISTINCT FROM c.source AND s.upto <= c.upto
    )
    SELECT z.doc_id, z.size, p.source_size, p.target,
        (z.size * (p.whole + CASE WHEN z.size > 0 AND (z.size >= s.scale OR t.size IS NOT NULL) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM sizes AS z JOIN plans AS p ON z.source IS NOT DISTINCT FROM p.source
    LEFT JOIN scales AS s ON z.source IS NOT DISTINCT FROM s.source
    LEFT JOIN taken AS t ON z.source IS NOT DISTINCT FROM t.source AND z.doc_id IS NOT DISTINCT FROM t.doc_id AND z.size = t.size
"""

QUALITY = r"""
    WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents
    ), worded AS (SELECT *, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM rows
    ), windows AS (
        SELECT r, place, count(*) OVER (PARTITION BY r, five) AS n FROM (
            SELECT r, unnest(range(1, len(words) - 3)) AS place, array_to_string(list_slice(words, place, place + 4), ' ') AS five FROM worded WHERE len(words) > 4)
    ), repeats AS (
        SELECT r, sum(least(5, next - place))::BIGINT AS n_repeat_words FROM (
            SELECT r, place, coalesce(lead(place) OVER (PARTITION BY r ORDER BY place), place + 5) AS next FROM windows WHERE n > 1) GROUP BY r
    ), split AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM rows
    ), lines AS (
        SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D0-9]+', ' ', 'g'), ' ') AS key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
        FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    ), hosts AS (SELECT source, count(DISTINCT coalesce(text, chr(0))) AS docs FROM rows GROUP BY source
    ), common AS (
        SELECT c.source, c.key FROM (SELECT source, key, count(DISTINCT text) AS n FROM lines GROUP BY source, key) AS c
        JOIN hosts AS h ON c.source IS NOT DISTINCT FROM h.source WHERE c.n >= 20 OR (c.n >= 3 AND c.n > 0.1 * h.docs)
    ), lined AS (
        SELECT l.r, count(*) - count(DISTINCT l.line) AS n_dup_lines, coalesce(sum(l.n) FILTER (c.key IS NOT NULL), 0)::BIGINT AS gone
        FROM lines AS l LEFT JOIN common AS c ON l.source IS NOT DISTINCT FROM c.source AND l.key = c.key GROUP BY l.r
    ), counted AS (
        SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
            coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(words) - coalesce(gone, 0)::BIGINT AS words_left
        FROM worded LEFT JOIN repeats USING (r) LEFT JOIN lined USING (r)
    )
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_left >= 10 AND words_left >= 0.5 * n_words AS kept
    FROM counted
"""

ORACLE_SQL = {"op1_quality": QUALITY, "op2_warc": WARC, "op6_mix": MIX, "op13_manifest": manifest()}
