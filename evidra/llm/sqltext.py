"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The reversed polynomial of zlib's crc32.
_POLYNOMIAL = 0xEDB88320


def lower_sql(text: str) -> str:
    """`text` with A-Z lower-cased; null is empty."""
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of the UTF-8 bytes of `text`, byte by byte with a table made from the polynomial."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = (k >> 1) ^ (_POLYNOMIAL if k & 1 else 0)
        table.append(k)
    codes = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    step = f"xor(c >> 8, ([{', '.join(map(str, table))}]::BIGINT[])[CAST(xor(c, b) & 255 AS BIGINT) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {step}), 4294967295)"


def similarity_sql(size: int, percent: int, extra: str = "") -> str:
    """Groups of similar documents: pairs with a common shingle of `size` words, then the least id reachable."""
    words = rf"regexp_extract_all({lower_sql('text')}, '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, {words} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + {size - 1}], ' ') FOR i IN range(1, len(w) - {size - 2})] END) AS g FROM docs
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id AND nb.n * 100 >= na.n * {percent} AND na.n * 100 >= nb.n * {percent}
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {percent} * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS root FROM docs
  UNION
  SELECT links.y, reach.root FROM reach JOIN links ON reach.x = links.x WHERE reach.root < links.y
), least AS (SELECT x, min(root) AS component_id FROM reach GROUP BY x)
SELECT docs.doc_id, coalesce(sizes.n, 0) AS n_shingles, least.component_id{extra}
FROM docs JOIN least ON least.x = docs.doc_id LEFT JOIN sizes ON sizes.doc_id = docs.doc_id
"""
