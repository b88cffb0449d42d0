"""What SQL can say of the queries, for DuckDB over the tables as they are."""

from __future__ import annotations

import string

#: Records by the hashes of whole payloads, the first of equal ones being the response.
WARC = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS t FROM pages), f AS (SELECT t, min(page_id) AS first FROM p WHERE strlen(t) >= 100 GROUP BY t)
SELECT page_id, url, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, sha256(p.t) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON p.t = f.t"""

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

#: Windows of items met with the documents' runs of as many words, written out.
DECONTAMINATE = f"""WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
runs AS (SELECT u, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT u, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT u, item, s, n FROM runs JOIN win USING (n, g)),
places AS (SELECT u, count(DISTINCT p) AS n_hit FROM (SELECT u, unnest(range(s, s + n)) AS p FROM hits) GROUP BY u),
items AS (SELECT u, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT u, item FROM hits) GROUP BY u)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN places USING (u) LEFT JOIN items USING (u)"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"


def _tree(name: str, levels: int) -> str:
    """Tables {name}1..{levels}: nodes (g, p, n, h) of name0 level by level, with the digests of their runs in whole."""
    out = ""
    for k in range(1, levels + 1):
        out += f""", {name}{k} AS (SELECT g, p // 16 AS p, CAST(ceil(max(n) / 16) AS BIGINT) AS n, CASE WHEN max(n) > 1 THEN string_agg(h, '' ORDER BY p) END AS whole, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h FROM {name}{k - 1} GROUP BY g, p // 16)"""
    return out


def _merkle(inner: int = 6, outer: int = 4) -> str:
    """Unrolled for 16 ** inner documents of a source and 16 ** outer sources."""
    crc_table = "list_transform(range(256), lambda k: list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k))"
    bytes_ = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    crc = f"xor(list_reduce({bytes_}, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295)"
    later = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    ids = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    sides, joins, fold, proof = "", "", "SELECT *, own AS up FROM sides", []
    for k in range(inner + outer):
        side, j, p = ("i", k + 1, "d.p") if k < inner else ("o", k - inner + 1, "s.p")
        at = f"({p} // {16 ** (j - 1)} % 16)"
        joins += f" JOIN {side}{j} ON {side}{j}.p = {p} // {16**j}" + (f" AND {side}{j}.g = d.g" if k < inner else "")
        sides += f", left({side}{j}.whole, CAST(64 * {at} AS INTEGER)) AS a{k}, substr({side}{j}.whole, CAST(64 * {at} + 65 AS INTEGER)) AS b{k}"
        fold = f"SELECT * REPLACE (coalesce(sha256(a{k} || up || b{k}), up) AS up) FROM ({fold})"
        proof.append(f"coalesce(a{k}, '') || coalesce(b{k}, '')")
    return f"""WITH c AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256({ids} || {_field("text")}) AS h, CASE WHEN {crc} % 5 = 0 THEN sha256({ids} || {_field(later)}) END AS found FROM documents, (SELECT {crc_table} AS t)),
d AS (SELECT doc_id, g, h, coalesce(found, h) AS own, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM c),
i0 AS (SELECT g, p, n, h FROM d){_tree("i", inner)},
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM i{inner}),
o0 AS (SELECT 0 AS g, p, n, h FROM s){_tree("o", outer)},
sides AS (SELECT doc_id, d.h AS leaf, own, s.h AS subroot{sides} FROM d JOIN s ON s.g = d.g{joins})
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(proof)}) AS proof_sha256, up AS folded_root, up = root AS verified FROM ({fold}), (SELECT h AS root FROM o{outer})"""


MERKLE = _merkle()
