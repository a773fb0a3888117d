"""SQL twins of the operators that SQL can express."""

from __future__ import annotations

from caseflow.llm import conversation_trie as trie
from caseflow.llm import license_scan as scan
from caseflow.llm import sharding
from caseflow.llm import vector_codes as codes

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_scan() -> str:
    rows = [
        *((label, text, 1.0, "true") for label, text in scan.PHRASES.items()),
        *((label, text, scan.THRESHOLD, "false") for label, text in scan.TEMPLATES.items()),
    ]
    values = ", ".join(f"('{label}', '{text}', {share}, {phrase})" for label, text, share, phrase in rows)
    return f"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
templates AS (
  SELECT label, string_split(t, ' ') AS phrase, list_distinct(string_split(t, ' ')) AS tokens, share, is_phrase
  FROM (VALUES {values}) v(label, t, share, is_phrase)),
starts AS (
  SELECT rid, w, b,
         list_distinct(w[b * {scan.STRIDE_WORDS} + 1 : b * {scan.STRIDE_WORDS} + {scan.BLOCK_WORDS}]) AS block
  FROM texts, unnest(range((len(w) + {scan.STRIDE_WORDS - 1}) // {scan.STRIDE_WORDS})) u(b)),
met AS (
  SELECT rid, label, max(len(list_intersect(block, tokens)) / len(tokens)) AS held
  FROM starts, templates
  WHERE NOT is_phrase AND len(list_intersect(block, tokens)) >= share * len(tokens) - 1e-9
  GROUP BY ALL),
places AS (
  SELECT rid, label, i
  FROM texts, templates, unnest(range(len(w))) u(i)
  WHERE is_phrase AND w[i + 1] = phrase[1] AND w[i + 1 : i + len(phrase)] = phrase),
base AS (
  SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS names
  FROM places GROUP BY rid),
named AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS names, max(held) AS score
  FROM (SELECT rid, label, held FROM met UNION ALL SELECT rid, label, 1.0 FROM places) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base,
       CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(base.names, '') AS base_labels, coalesce(named.names, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM texts LEFT JOIN base USING (rid) LEFT JOIN named USING (rid)"""


def _network(source: str, column: str) -> str:
    """One pass of ``column`` of ``source`` through the permutation, as nested selects."""
    m, n = sharding.MULTIPLIERS
    word = sharding.WORD + 1
    sql = f"SELECT rn, rows, b, {column} >> b AS l, {column} % (1::UBIGINT << b) AS r FROM {source}"
    for key in sharding.round_keys(sharding.SEED):
        sql = f"SELECT *, ((r + {key}) % {word}) * {m} % {word} AS t FROM ({sql})"
        sql = f"SELECT *, xor(t, t >> 15) * {n} % {word} AS u FROM ({sql})"
        sql = f"SELECT rn, rows, b, r AS l, xor(l, xor(u, u >> 13) % (1::UBIGINT << b)) AS r FROM ({sql})"
    return f"SELECT rn, rows, b, (l << b) + r AS p FROM ({sql})"


#: CTEs ending in ``checked``: doc_id, size and CRC-32 (four bits at a time) of every text.
CHECKED = """steps AS (
  SELECT list_transform(range(16), lambda i: list_reduce([i] || range(4), lambda a, k:
    CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END)) AS step),
hexed AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h
  FROM documents),
halves AS (
  SELECT doc_id, size, CASE WHEN size = 1 THEN []::BIGINT[] ELSE
    list_transform(range(len(h)), lambda i: instr('0123456789ABCDEF', h[xor(i, 1) + 1]) - 1) END AS n FROM hexed),
checked AS (
  SELECT doc_id, size, xor(4294967295, list_reduce([4294967295::BIGINT] || n,
    lambda a, b: xor(step[xor(a % 16, b) + 1], a // 16))) AS text_crc32 FROM halves, steps)"""


def _sharding() -> str:
    return f"""
WITH RECURSIVE {CHECKED},
numbered AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS n0, size, text_crc32,
         count(*) OVER () AS rows FROM checked),
bits AS (
  SELECT n0::UBIGINT AS rn, rows::UBIGINT AS rows,
         greatest(1, (length(bin(rows - 1)) + 1) // 2)::UBIGINT AS b FROM numbered),
walk AS (
  {_network('bits', 'rn')}
  UNION ALL
  SELECT rn, rows, b, p FROM ({_network('(SELECT * FROM walk WHERE p >= rows)', 'p')}))
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(p % 8 AS INTEGER) AS shard,
       CAST(p // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk ON n0 = rn WHERE p < walk.rows"""


EXACT_DEDUP = f"""
WITH hashed AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)"""

NEAR_DEDUP = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s
  FROM words),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
items AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT node, least(node, min(other)) AS component_id FROM reach GROUP BY node)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
       coalesce(component_id, rep, sets.doc_id) AS component_id,
       sets.doc_id = coalesce(component_id, rep, sets.doc_id) AS kept
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN least ON rep = node"""



def _vector_codes() -> str:
    near = """
{name} AS (
  SELECT p.rid, p.p, p.x, min(struct_pack(d := list_sum(list_transform(range(1, len(p.x) + 1),
           lambda i: (p.x[i] - b.c[i]) * (p.x[i] - b.c[i]))), e := b.e)) AS best
  FROM parts p JOIN {book} b USING (p) GROUP BY p.rid, p.p, p.x)"""
    moved = """
{name} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN (
    SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS c FROM (
      SELECT p, best.e AS e, i, sum(x[i]) AS total, count(*) AS n
      FROM {assigned}, unnest(range(1, len(x) + 1)) u(i) GROUP BY ALL) GROUP BY p, e) m USING (p, e))"""
    steps = []
    for k in range(codes.ROUNDS):
        steps.append(near.format(name=f"near{k}", book=f"book{k}"))
        steps.append(moved.format(name=f"book{k + 1}", book=f"book{k}", assigned=f"near{k}"))
    steps.append(near.format(name="final", book=f"book{codes.ROUNDS}"))
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding,
         list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT rid, p, v[p * (len(v) // {codes.PARTS}) + 1 : (p + 1) * (len(v) // {codes.PARTS})] AS x
  FROM kept, unnest(range({codes.PARTS})) u(p)),
seeds AS (
  SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding, label NULLS LAST) - 1 AS e FROM kept),
book0 AS (SELECT p, e, x AS c FROM parts JOIN seeds USING (rid) WHERE e < {codes.ENTRIES}),
{",".join(steps)},
sha AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{codes.ROUNDS}),
coded AS (
  SELECT rid, string_agg(lower(lpad(hex(best.e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM final GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), sha"""


def _conversation_trie() -> str:
    return f"""
WITH steps AS (
  SELECT list_transform(range(16), lambda i: list_reduce([i] || range(4), lambda a, k:
    CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END)) AS step),
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % {trie.FAMILY} AS base, xor(4294967295, list_reduce([4294967295::BIGINT] ||
    list_transform(range(len(h)), lambda i: instr('0123456789ABCDEF', h[xor(i, 1) + 1]) - 1),
    lambda a, b: xor(step[xor(a % 16, b) + 1], a // 16))) % {trie.HEADS} AS h
  FROM (SELECT c, string_split(hex(encode(CAST(c AS VARCHAR))), '') AS h FROM (SELECT DISTINCT c FROM turns)), steps),
rebuilt AS (
  SELECT convs.c, 0 AS own, n, role, text FROM convs JOIN turns ON turns.c = base WHERE n <= h
  UNION ALL SELECT convs.c, 1, n, role, text FROM convs JOIN turns ON turns.c = convs.c WHERE n > h),
paths AS (
  SELECT c, row_number() OVER w AS depth, list(struct_pack(role := role, text := text)) OVER w AS path,
         strlen(text) AS size
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, n)
  UNION ALL SELECT c, 0, [], 0 FROM convs),
nodes AS (SELECT path, depth, min(c) AS rep, count(*) AS n_convs, max(size) AS size FROM paths GROUP BY path, depth),
named AS (SELECT c, depth, rep, n_convs, size FROM paths JOIN nodes USING (path, depth, size)),
linked AS (
  SELECT n.rep, n.depth, n.n_convs, n.size, p.rep AS up
  FROM (SELECT * FROM named WHERE c = rep) n LEFT JOIN named p ON p.c = n.rep AND p.depth = n.depth - 1),
kids AS (SELECT up AS rep, depth - 1 AS depth, count(*) AS children FROM linked WHERE depth > 0 GROUP BY ALL),
own AS (
  SELECT rep, linked.depth, up, n_convs, coalesce(children, 0) AS children, (n_convs - 1) * size AS saved
  FROM linked LEFT JOIN kids USING (rep, depth)),
rolled AS (
  SELECT a.rep, a.depth, count(*) FILTER (o.children = 0) AS leaves, sum(o.saved) AS saved
  FROM own o JOIN named a ON a.c = o.rep AND a.depth <= o.depth GROUP BY a.rep, a.depth),
ends AS (
  SELECT rep, depth, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha
  FROM (SELECT *, max(depth) OVER (PARTITION BY c) AS last FROM named) WHERE depth = last GROUP BY rep, depth)
SELECT rep AS conv_id, CAST(depth AS BIGINT) AS depth, up AS parent_conv_id, n_convs, children AS n_children,
       leaves AS n_leaves, CAST(rolled.saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM own JOIN rolled USING (rep, depth) LEFT JOIN ends USING (rep, depth)"""


ORACLES = {
    "op1_license_scan": _license_scan(),
    "op3_sharding": _sharding(),
    "op5_exact_dedup": EXACT_DEDUP,
    "op9_near_dedup": NEAR_DEDUP,
    "op11_vector_codes": _vector_codes(),
    "op13_conversation_trie": _conversation_trie(),
}
