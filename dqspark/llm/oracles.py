"""DuckDB SQL for the operators that SQL can express.

The others are held against plain versions in tests/llm: SimHash (no xxHash64 in
SQL), BPE, packing (dynamic programming), and the trained models.
"""

from __future__ import annotations

from dqspark.llm.pii import IBAN_PATTERN

_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: kind, pattern, test of a match v, score, context words
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.9,
     "mail|contact|address|kontakt|adresse|correo|courriel"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", rf"regexp_full_match(v, '{_PART}\.{_PART}\.{_PART}\.{_PART}')", 0.6,
     r"\bip\b|host|server|login|client|addr"),
    ("card", r"[0-9](?:[ -]?[0-9])+", """
        length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i:
            CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(d), i, 1) AS INT)
                 ELSE 2 * CAST(substr(reverse(d), i, 1) AS INT)
                      - CASE WHEN substr(reverse(d), i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0""", 0.8,
     "card|visa|credit|pay|karte|carte|tarjeta"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15", 0.7,
     "phone|call|tel|mobile|fax|anruf|appel|llam"),
    ("iban", IBAN_PATTERN, """
        list_reduce(list_concat([0], list_transform(
            range(1, length(replace(v, ' ', '')) + 1),
            lambda i: ascii(substr(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), i, 1)))),
            lambda a, c: CASE WHEN c < 58 THEN a * 10 + c - 48 ELSE a * 100 + c - 55 END % 97) = 1""", 0.9,
     "iban|bank|account|konto|compte|cuenta"),
)


def _spans(n: int) -> str:
    kind, pattern, test, score, context = _KINDS[n]
    return f"""
    SELECT doc_id, {n} AS rank, '{kind}' AS kind, s AS span_start, s + length(v) AS span_end,
           round(CAST({score} AS DOUBLE) + CASE WHEN regexp_matches(lower(right(gap, 40)), '{context}') THEN 0.1 ELSE 0 END, 2) AS score
    FROM (
      SELECT doc_id, v, gap, regexp_replace(v, '[^0-9]', '', 'g') AS d,
             CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS INT) AS s
      FROM (SELECT doc_id, found, gaps, k, found[k] AS v, gaps[k] AS gap
            FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found,
                         string_split_regex(text, '{pattern}') AS gaps
                  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
                 unnest(range(1, len(found) + 1)) AS u(k))
    ) WHERE {test}"""


_PII = f"""
WITH spans AS ({" UNION ALL ".join(_spans(n) for n in range(len(_KINDS)))})
SELECT d.doc_id,
       count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
       count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       count(*) FILTER (kind = 'iban') AS n_iban,
       sha256(coalesce(string_agg(kind || ':' || span_start || ':' || span_end, ',' ORDER BY rank, span_start)
                       FILTER (rank < 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || span_start || ':' || span_end, ',' ORDER BY rank, span_start), '') AS spans,
       coalesce(max(score), CAST(0 AS DOUBLE)) AS top_score
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id
GROUP BY d.doc_id"""

_PAIRS = """
usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)"""

_VECTORS = f"""
WITH RECURSIVE {_PAIRS}
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) l ON l.a = e.vec_id"""

#: crc32 of a decimal number's text, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

_SCORES = f"""
WITH docs AS (
  SELECT doc_id, {_CRC} % 7 = 2 AS held_out,
         list_append(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x20\\x09-\\x0D]+'), chr(10)) AS words
  FROM documents),
tokens AS (
  SELECT doc_id, held_out, k, words[k] AS w, CASE WHEN k > 1 THEN words[k - 1] END AS before
  FROM docs, unnest(range(1, len(words) + 1)) AS u(k)),
counts AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
whole AS (SELECT sum(c) AS n, count(*) AS v FROM counts),
arcs AS (SELECT before, w, count(*) AS n FROM tokens WHERE NOT held_out AND before IS NOT NULL GROUP BY before, w),
placed AS (
  SELECT t.*, c.c, h.n, (coalesce(c.c, 0) + 1) / (h.n + 1.0 * (h.v + 1)) AS single
  FROM tokens t CROSS JOIN whole h LEFT JOIN counts c ON c.w = t.w)
SELECT t.doc_id, any_value(t.held_out) AS held_out, count(*) AS n_tokens, count(t.c) AS n_known,
       CAST(any_value(t.n) AS BIGINT) AS train_tokens, sum(log10(t.single)) AS base_score,
       sum(CASE WHEN t.before IS NULL THEN log10(t.single)
           ELSE log10((coalesce(a.n, 0) + 300 * t.single) / (coalesce(b.c, 0) + 300)) END) AS score
FROM placed t
LEFT JOIN counts b ON b.w = t.before
LEFT JOIN arcs a ON a.before = t.before AND a.w = t.w
GROUP BY t.doc_id"""


_WARC = """
WITH own AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
  FROM pages)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(5 * i // 4 + 1 AS BIGINT), 2) AS BIGINT) >> (3 - 5 * i % 4)) & 31 AS BIGINT) + 1, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM own"""

_NEGATIVES = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS alike,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM own a JOIN own c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS place
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike
    AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE place <= 5"""


def _written(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _levels(table: str, levels: int) -> list[str]:
    """Nodes of level j (key, pos, node) as {table}{j}, their runs (key, pos, n, nodes) as {table}_runs{j}."""
    parts = []
    for j in range(levels):
        parts.append(f"""
{table}_runs{j} AS (
  SELECT key, pos // 3 AS pos, any_value(n) AS n, list(node ORDER BY pos) AS nodes
  FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {table}{j}) GROUP BY key, pos // 3)""")
        parts.append(f"""
{table}{j + 1} AS (
  SELECT key, pos, CASE WHEN n = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node
  FROM {table}_runs{j})""")
    return parts


def _folds(rows: str, table: str, levels: int) -> list[str]:
    """Climb with (key, pos, node, proof) in {rows}0 through the runs of ``table``."""
    return [f"""
{rows}{j + 1} AS (
  SELECT f.* REPLACE (f.pos // 3 AS pos,
    CASE WHEN r.n = 1 THEN f.node ELSE sha256(array_to_string(r.nodes[1:f.pos % 3], '') || f.node
      || array_to_string(r.nodes[f.pos % 3 + 2:], '')) END AS node,
    CASE WHEN r.n = 1 THEN f.proof ELSE f.proof || array_to_string(r.nodes[1:f.pos % 3], '')
      || array_to_string(r.nodes[f.pos % 3 + 2:], '') END AS proof)
  FROM {rows}{j} f JOIN {table}_runs{j} r ON r.key = f.key AND r.pos = f.pos // 3)""" for j in range(levels)]


#: Levels that the SQL climbs: 3**14 documents of a source, 3**7 sources.
_DEEP, _WIDE = 14, 7
_FIELDS = " || ".join(_written(c) for c in ("doc_id", "source", "lang", "n_chars"))
_MERKLE = "WITH" + ",".join([f"""
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS key, sha256({_FIELDS} || {_written("text")}) AS node,
         sha256({_FIELDS} || {_written(f"CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS altered
  FROM documents)""", """
leaf0 AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM leaves)""",
    *_levels("leaf", _DEEP), f"""
top0 AS (
  SELECT 'all' AS key, key AS source, row_number() OVER (ORDER BY key) - 1 AS pos, node FROM leaf{_DEEP})""",
    *_levels("top", _WIDE), """
fold0 AS (SELECT doc_id, key, pos, node AS leaf, altered AS node, '' AS proof FROM leaf0)""",
    *_folds("fold", "leaf", _DEEP), f"""
up0 AS (
  SELECT f.doc_id, f.leaf, t.node AS subroot, 'all' AS key, t.pos, f.node, f.proof
  FROM fold{_DEEP} f JOIN top0 t ON t.source = f.key)""", *_folds("up", "top", _WIDE)]) + f"""
SELECT f.doc_id, f.leaf, f.subroot, t.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root,
       f.node = t.node AS verified
FROM up{_WIDE} f JOIN top{_WIDE} t ON t.key = f.key"""


def sql() -> dict[str, str]:
    return {"op1_pii": _PII, "op8_embedding_dedup": _VECTORS, "op9_lm_score": _SCORES,
            "op11_warc": _WARC, "op12_hard_negatives": _NEGATIVES, "op13_merkle": _MERKLE}
