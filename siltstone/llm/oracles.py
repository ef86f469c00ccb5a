"""DuckDB SQL that computes the rows of queries by other means: joins of all shingles, windows and words.

Written for tables whose doc_id and item_id are unique and not null.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def near_duplicates(width: int, percent: int) -> str:
    """Components by a join of all sets on every shingle they share."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, {shingle} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM t WHERE len(w) >= {width})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND {width - 1}),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (SELECT g.doc_id, g, n FROM g JOIN n USING (doc_id)),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def contamination(width: int) -> str:
    """Windows of every length that items have, of all documents, joined with those of the items."""
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{WORD}') AS w, regexp_split_to_array({FOLDED}, '{WORD}') AS gaps FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({FOLDED}, '{WORD}') AS w FROM benchmark),
p AS (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT item, w, least({width}, len(w)) AS k, unnest(range(1, greatest(1, len(w) - {width - 1}) + 1)) AS s FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT k FROM p),
d AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM t, z WHERE len(w) >= k)),
h AS (SELECT doc_id, d.k, s, item FROM d JOIN p ON d.k = p.k AND d.win = p.win),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
q AS (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS pos FROM (SELECT DISTINCT doc_id, k, s FROM h)),
o AS (SELECT doc_id, min(pos) AS a, max(pos) AS b, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM q) GROUP BY doc_id, run),
f AS (SELECT doc_id, n, a, list_sum(list_transform(gaps[1:a], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:a - 1], lambda x: length(x))), 0) AS first,
  list_sum(list_transform(gaps[1:b], lambda x: length(x))) + list_sum(list_transform(w[1:b], lambda x: length(x))) AS last FROM o JOIN t USING (doc_id)),
u AS (SELECT doc_id, sum(n)::BIGINT AS n_hit, string_agg(first::BIGINT || ':' || last::BIGINT, ',' ORDER BY a) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(spans, '') AS hit_spans
FROM t LEFT JOIN m USING (doc_id) LEFT JOIN u USING (doc_id)
"""


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        out.append(n)
    return out


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, from its hexadecimal digits two by two."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, (({_crc_table()})::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"


def hilbert_shards(shards: int, bits: int) -> str:
    """Cells by running counts, the curve by one statement a bit, runs of equal counts of the sorted rows."""
    dims = ("lang", "source", "size")
    cells = ", ".join(
        f"q{k} AS (SELECT v{k}, ((sum(n) OVER (ORDER BY v{k}) - n) * {1 << bits} // (SELECT count(*) FROM t))::BIGINT AS x{k} FROM (SELECT v{k}, count(*) AS n FROM t GROUP BY v{k}))"
        for k in range(len(dims))
    )
    steps, last = [], "c0"
    number = 0
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for d in range(len(dims)):
            swap = f"CASE WHEN x{d} & {q} <> 0 THEN 0 ELSE xor(x0, x{d}) & {low} END"
            first = f"xor(x0, CASE WHEN x{d} & {q} <> 0 THEN {low} ELSE xor(x0, x{d}) & {low} END)"
            columns = [f"{first} AS x0", *(f"xor(x{k}, {swap}) AS x{k}" if k == d else f"x{k}" for k in range(1, len(dims)))]
            number += 1
            steps.append(f"c{number} AS MATERIALIZED (SELECT * EXCLUDE ({', '.join(f'x{k}' for k in range(len(dims)))}), {', '.join(columns)} FROM {last})")
            last = f"c{number}"
    gray = ["x0"]
    for k in range(1, len(dims)):
        gray.append(f"xor(x{k}, {gray[-1]})")
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN y{len(dims) - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    curve = " + ".join(f"(((xor(y{d}, flip) >> {b}) & 1) << {b * len(dims) + len(dims) - 1 - d})" for b in range(bits) for d in range(len(dims)))
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS v0, coalesce(source, '') AS v1, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS v2 FROM documents),
k AS (SELECT doc_id, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
{cells},
c0 AS (SELECT doc_id, v2 AS size, x0, x1, x2 FROM t JOIN q0 USING (v0) JOIN q1 USING (v1) JOIN q2 USING (v2)),
{', '.join(steps)},
g AS (SELECT doc_id, size, {', '.join(f'{e} AS y{k}' for k, e in enumerate(gray))} FROM {last}),
f AS (SELECT *, {flip} AS flip FROM g),
h AS (SELECT doc_id, size, ({curve})::BIGINT AS curve FROM f),
r AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id) - 1 AS rank, count(*) OVER () // {shards} AS s, count(*) OVER () % {shards} AS m FROM h)
SELECT doc_id, size, text_crc32, 'rows' AS law, (CASE WHEN rank < m * (s + 1) THEN rank // (s + 1) ELSE m + (rank - m * (s + 1)) // greatest(s, 1) END)::INT AS shard,
  (CASE WHEN rank < m * (s + 1) THEN rank % (s + 1) ELSE (rank - m * (s + 1)) % greatest(s, 1) END)::BIGINT AS slot, NULL::INT AS grown_shard, curve FROM r JOIN k USING (doc_id)
"""
