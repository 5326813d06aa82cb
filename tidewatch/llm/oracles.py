"""DuckDB SQL for the queries that SQL can express, written from the definitions."""

from __future__ import annotations

from tidewatch.llm import sharding

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "'[\\x20\\x09-\\x0D]+'"


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; needs ``crc_table`` in scope."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)"
    step = "xor(a >> 8, crc_table.t[(xor(a & 255, b) + 1)::BIGINT])"
    return f"xor(list_reduce([4294967295::BIGINT] || {data}, lambda a, b: {step}), 4294967295::BIGINT)"


CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8)::BIGINT[],
           lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
)"""

ORACLES: dict[str, str] = {}

ORACLES["op4_near_duplicates"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, {_SPACE}), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
      WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * i >= 85 * (nx.n + ny.n - i)
), both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (
  SELECT x AS doc_id, x AS other FROM both_ways
  UNION
  SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other
), c AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.other, d.doc_id) AS component_id,
       coalesce(c.other, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLES["op1_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, {_LOWER} AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256
FROM t JOIN g USING (x)
"""

# The formatted length counts the template's own characters and a backslash before each control string.
ORACLES["op2_chat_format"] = """
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations
  UNION ALL
  SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT *, length(x) + len(regexp_extract_all(x, '<s>|</s>|\\[/?INST\\]|\\[ANS\\]|<<SYS:|>>|<</SYS>>'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE 19 + length(role) END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(x)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_SHARDS = sharding.SHARDS
ORACLES["op11_jump_shards"] = f"""
WITH RECURSIVE {CRC_TABLE}, t AS (
  SELECT doc_id, coalesce(doc_id, 0) AS k, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size,
         {crc32("coalesce(text, '')")} AS text_crc32
  FROM documents, crc_table
), j AS (
  SELECT DISTINCT k, (k::HUGEINT + CASE WHEN k < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END)::UHUGEINT AS s,
         0::BIGINT AS place, 0::BIGINT AS next
  FROM t
  UNION ALL
  SELECT k, s2, next, floor((next + 1)::DOUBLE * (2147483648::DOUBLE / ((s2 >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (s * {sharding.MULTIPLIER}::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS s2
        FROM j WHERE next <= {_SHARDS})
), p AS (
  SELECT k, max(place) FILTER (place < {_SHARDS}) AS shard, max(place) AS grown FROM j GROUP BY k
), n AS (SELECT greatest(ceil(count(*) / {sharding.PER_PIECE}), 1)::BIGINT AS pieces FROM documents)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown::INTEGER AS grown_shard,
       row_number() OVER (
         PARTITION BY shard
         ORDER BY ((k % pieces + pieces) % pieces + text_crc32 % pieces) % pieces, doc_id NULLS FIRST, size, text_crc32
       ) - 1 AS slot
FROM t JOIN p USING (k), n
"""


def _tree(name: str, nodes: str, depth: int) -> str:
    """Levels of all trees of ``nodes (tree, p, h, n)``, each node with its run's others left and right."""
    run = "PARTITION BY tree, p // 8 ORDER BY p ROWS BETWEEN"
    parts = []
    for level in range(depth + 1):
        below = nodes if level == 0 else f"{name}{level - 1}"
        rows = f"SELECT tree, p, h, n FROM {below}"
        if level:
            parent = "CASE WHEN min(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END"
            rows = f"SELECT tree, p // 8 AS p, {parent} AS h, (min(n) + 7) // 8 AS n FROM {below} GROUP BY tree, p // 8"
        parts.append(f"""{name}{level} AS (
  SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM ({rows}))""")
    return ", ".join(parts)


def _folded(name: str, frame: str, depth: int) -> str:
    """Rows of ``frame (tree, p, f, s)`` brought to the top: ``f`` folded, ``s`` the siblings passed."""
    parts = []
    for level in range(depth):
        below = frame if level == 0 else f"{name}_up{level - 1}"
        parts.append(f"""{name}_up{level} AS (
  SELECT b.* REPLACE (CASE WHEN n > 1 THEN sha256(l || f || r) ELSE f END AS f, s || l || r AS s)
  FROM {below} b JOIN {name}{level} v ON v.tree = b.tree AND v.p = b.p // {8**level}::BIGINT)""")
    return ", ".join(parts)


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({value}))::VARCHAR || ':' || {value} END"


def _row(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text])) + ")"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# Trees of up to 8 ** 8 documents and 8 ** 3 languages.
ORACLES["op13_merkle_manifest"] = f"""
WITH {CRC_TABLE}, d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_row("text")} AS leaf,
         CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_row(_LOWERED)} ELSE {_row("text")} END AS f
  FROM documents, crc_table
), leaves AS (
  SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
         count(*) OVER (PARTITION BY tree) AS n, '' AS s
  FROM d
), {_tree("a", "leaves", 8)}, {_folded("a", "(SELECT tree, p, doc_id, leaf, f, s FROM leaves)", 8)},
groups AS (
  SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM a8
), {_tree("b", "groups", 3)}, met AS (
  SELECT '' AS tree, g.p, doc_id, leaf, f, s, g.h AS subroot FROM a_up7 u JOIN groups g ON g.name = u.tree
), {_folded("b", "met", 3)}
SELECT doc_id, leaf, subroot, b3.h AS root, sha256(s) AS proof_sha256, f AS folded_root, f = b3.h AS verified
FROM b_up2, b3
"""

_TERM = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"
ORACLES["op12_ranked_search"] = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, len(ws) AS n, ws
  FROM (SELECT doc_id, regexp_extract_all({_LOWER}, {_TERM}) AS ws FROM documents) WHERE len(ws) > 0
), s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS every FROM d),
f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ws) AS t FROM d) GROUP BY ALL),
w AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT t, count(*) AS df FROM f GROUP BY t), s
), q AS (
  SELECT i, item_id, t, count(*) AS q
  FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({_LOWER}, {_TERM})) AS t FROM benchmark)
  GROUP BY ALL
), scored AS (
  SELECT i, item_id, r, doc_id,
         sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // every))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN f USING (t), s GROUP BY i, item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
